"""Operators over texts against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from meldspark.llm import decontaminate, mixing, sharding, simhash
from meldspark.operators.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp int, size int, part int, row int"
ODD = [None, "", " \t\n ", "One", "one two", "ÀÉ É à ÀÉ", "x" * 200_000, "word " * 30_000, "a b c\x0bd\x1ce"]


def texts(n, seed=0, vocabulary=200):
    rnd = random.Random(seed)
    words = [f"w{i}" if i % 3 else f"W{i}É" for i in range(vocabulary)]
    out = [" ".join(rnd.choices(words, k=rnd.randint(1, 120))) for _ in range(n)]
    for i in range(0, n, 5):  # near and exact copies
        w = out[i].split()
        if i % 10:
            w[rnd.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def frame(spark, rows):
    full = [(i, t, "en", s, 0, 1, 2, 3, 4) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 4}" if i % 4 else None) for i, t in enumerate(texts(200) + ODD)]
    rows += [rows[3], rows[3], (None, "no id at all", "src1")]
    return rows, frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- SimHash


def brute_print(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, prints, radius):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, p in zip(ids, prints, strict=True):
        for y, q in zip(ids, prints, strict=True):
            if x < y and (p ^ q).bit_count() <= radius:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(docs):
    rows, df = docs
    known = [(i, brute_print(t)) for i, t, _ in dict.fromkeys(r for r in rows if r[0] is not None)]
    comp = brute_components([i for i, _ in known], [p for _, p in known], 3)
    want = sorted((i, f"{dict(known)[i]:016x}", comp[i]) for i, _, _ in rows if i is not None)
    got = sorted(tuple(r) for r in simhash.simhash_components(df).where("doc_id is not null").collect())
    assert got == want
    assert df.count() == simhash.simhash_components(df).count()


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("block", [16, 4096])
def test_bit_sliced_comparison_is_exact(monkeypatch, radius, block):
    import numpy as np

    monkeypatch.setattr(simhash, "BLOCK", block)
    rnd = np.random.default_rng(radius)
    base = rnd.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) ^ sum(1 << int(i) for i in rnd.choice(64, rnd.integers(0, 5), replace=False)) for b in base for _ in range(60)}
    fps = np.array(sorted(fps), np.uint64)
    out = []
    for mask in simhash._choices(len(fps), radius):
        key = fps & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        simhash._link(fps[order], key[order], np.arange(len(fps))[order], radius, ~mask & (1 << 64) - 1, out)
    want = brute_components(range(len(fps)), [int(x) for x in fps], radius)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in out:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = sorted((find(x), find(y)))
            parent[q] = p
    assert {i: find(i) for i in range(len(fps))} == want


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7), (None, 1)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_runs(text, n=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(texts, similarity=0.8):
    """Components of texts by the similarity of their sets of word runs, all pairs that share one."""
    sets, where, parent = [word_runs(t) for t in texts], {}, list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, runs in enumerate(sets):
        others = Counter(j for r in runs for j in where.get(r, ()))
        for j, both in others.items():
            if both >= similarity * (len(runs) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
        for r in runs:
            where.setdefault(r, []).append(i)
    empty = [i for i, r in enumerate(sets) if not r]
    for i in empty[1:]:
        parent[find(i)] = find(empty[0])
    return [find(i) for i in range(len(texts))]


def test_signatures_tell_similarity():
    known, rnd = simhash._Hashes(), random.Random(4)
    caught = {0.8: [0, 0], 0.9: [0, 0]}
    for _ in range(400):
        w = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 400))]
        v = list(w)
        for _ in range(rnd.randint(1, max(2, len(w) // 25))):
            v[rnd.randrange(len(v))] = "changed"
        a, b = word_runs(" ".join(w)), word_runs(" ".join(v))
        real = len(a & b) / len(a | b)
        fp, low = simhash.signatures([simhash.shingles(" ".join(x).encode(), 5, known) for x in (w, v)])
        assert (fp[0] != 0).any() and len(simhash.shingles(" ".join(w).encode(), 5, known)) == len(a)
        distance, (sure, most) = int(np.bitwise_count(fp[0] ^ fp[1]).sum()), simhash.similarity_radii(0.8)
        near = (low[0] == low[1]).any() and distance <= most
        assert distance > sure or real >= 0.8
        for least in caught:
            if real >= least:
                caught[least][0] += near
                caught[least][1] += 1
    assert caught[0.8][1] > 100 and caught[0.8][0] / caught[0.8][1] > 0.98
    assert caught[0.9][0] == caught[0.9][1] > 50


@pytest.mark.parametrize("block", [8, 4096])
def test_simhash_dedup(spark, docs, empty, block):
    rows, df = docs
    rnd = random.Random(5)
    base = " ".join(f"v{rnd.randrange(300)}" for _ in range(150)).split()
    rows = [r for r in rows if r[0] is not None]
    for i in range(60):  # a large group of near copies
        w = list(base)
        w[rnd.randrange(150)] = f"new{i}"
        rows.append((1000 + i, " ".join(w), "s"))
    rows += [(5, "wholly another text under an id in use " * 3, "s"), (None, rows[0][1], "s"), (None, "no id, twice", "s"), (None, "no id, twice", "t")]
    before = simhash.BLOCK
    simhash.BLOCK = block
    try:
        got = simhash.simhash_dedup(frame(spark, rows))
        assert got.columns == df.columns
        got = [(r.doc_id, r.text) for r in got.collect()]
    finally:
        simhash.BLOCK = before
    first = {}
    for (i, t, _), c in zip(rows, brute_near([t for _, t, _ in rows]), strict=True):
        key = (i is None, i or 0)
        if c not in first or key < first[c][0]:
            first[c] = (key, (i, t))
    assert sorted(map(str, got)) == sorted(str(x) for _, x in first.values())
    assert sum(i is not None and i >= 1000 for i, _ in got) == 1
    assert simhash.simhash_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0


def test_large_buckets_are_divided(monkeypatch):
    """What one bucket links, whatever the size of a block: all that all pairs link, led groups whole."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, (12, simhash.WORDS), dtype=np.uint64)
    lows = rng.integers(0, 1 << 62, (12, simhash.MINIMA))
    fp, low = [], []
    for k in range(600):
        x, y = base[k % 12].copy(), lows[k % 12].copy()
        for bit in rng.choice(256, 9, replace=False):
            x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        y[rng.integers(1, simhash.MINIMA)] = rng.integers(0, 1 << 62)
        y[0] = 7
        fp.append(x)
        low.append(y)
    fp, low, ids = np.array(fp), np.array(low), np.arange(600)
    want = {tuple(i for i in range(600) if i % 12 == g) for g in range(12)}
    for block in (8, 64, 4096):
        monkeypatch.setattr(simhash, "BLOCK", block)
        links = simhash._Links(*simhash.similarity_radii(0.8))
        simhash._similar(fp, low, ids, low[:, 0], links, frozenset([0]))
        a, b = simhash._forest(links.certain)
        groups = {}
        for x in range(600):
            groups.setdefault(dict(zip(a.tolist(), b.tolist(), strict=True)).get(x, x), []).append(x)
        assert {tuple(g) for g in groups.values()} == want


@pytest.mark.parametrize("by", ["_block", "_leaders"])
def test_no_close_rows_are_left_out(by):
    """Rows within reach are in one group of certain links, or their groups have a link to be checked."""
    rng = np.random.default_rng(8)
    near, far = simhash.similarity_radii(0.8)
    base = rng.integers(0, 1 << 63, simhash.WORDS, dtype=np.uint64)
    fp = [base]
    for k in range(1, 120):
        x = (base if k % 3 else fp[-1]).copy()
        for bit in rng.choice(256, 24 if k % 3 else 8, replace=False):
            x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        fp.append(x)
    fp, ids, links = np.array(fp), np.arange(120), simhash._Links(near, far)
    simhash._block(fp, np.zeros(120, np.int64), ids, links) if by == "_block" else simhash._leaders(fp, ids, links)
    group = np.arange(120)
    for x, y in zip(*simhash._forest(links.certain), strict=True):
        group[x] = y
    told = {frozenset((group[x], group[y])) for pairs in links.open + getattr(links, "spare", []) for x, y in zip(*pairs, strict=True)}
    close = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None]).sum(axis=2) <= far)
    apart = {frozenset((group[x], group[y])) for x, y in close if group[x] != group[y]}
    assert len(apart) > 200 and not apart - told


def test_groups_whose_closest_rows_are_not_similar(spark):
    """One text is similar to one of two near copies, and closer by its fingerprint to the other."""
    for seed in range(100):
        rnd = random.Random(seed)
        one = [f"w{rnd.randrange(10**6)}" for _ in range(400)]
        two, other = list(one), list(one)
        two[30] = "changed"
        for i in (*range(60, 200, 20), *range(300, 305)):  # 44 of 396 runs
            other[i] = f"new{i}"
        texts = [" ".join(x) for x in (one, two, other)]
        fp, low = simhash.signatures([simhash.shingles(t.encode(), 5, simhash._Hashes()) for t in texts])
        d = lambda x, y: int(np.bitwise_count(fp[x] ^ fp[y]).sum())
        near, far = simhash.similarity_radii(0.8)
        if d(0, 1) <= near < d(1, 2) < d(0, 2) <= far and (low[0] == low[1]).any() and ((low[0] == low[2]) & (low[1] == low[2])).any():
            break
    assert brute_near(texts) == [0, 0, 0]
    got = simhash.simhash_dedup(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert [r.doc_id for r in got] == [0]


def test_links_within_reach_grow_with_rows():
    """Rows that are all within reach, and none surely similar, give a forest of links, not all pairs."""
    rng = np.random.default_rng(9)
    near, far = simhash.similarity_radii(0.8)
    base, n = rng.integers(0, 1 << 63, simhash.WORDS, dtype=np.uint64), 300
    fp = np.tile(base, (n, 1))
    for x in fp:
        for bit in rng.choice(256, far // 2, replace=False):
            x[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    columns = {"which": pa.array(np.zeros(n, np.int32)), "key": pa.array(np.full(n, 7)), "fp": pa.array([x.tobytes() for x in fp]), "low": pa.array([[7] * simhash.MINIMA] * n), "number": pa.array(np.arange(n))}
    links = pa.Table.from_batches(simhash._similar_batches(near, far)([pa.RecordBatch.from_pydict(columns)]))
    assert n - 1 == simhash._forest([(links["a"].to_numpy(), links["b"].to_numpy())])[0].size <= links.num_rows < 2 * n


@pytest.mark.parametrize("size", [1 << 9, 1 << 19])
def test_rows_of_failed_links_are_compared_block_by_block(spark, monkeypatch, size):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", size)
    monkeypatch.setattr(simhash, "COLUMNS", 64)
    rnd = random.Random(11)
    base, texts = [f"w{rnd.randrange(10**6)}" for _ in range(120)], []
    for i in range(80):
        w = list(base)
        for at in rnd.sample(range(0, 120, 6), rnd.randrange(4)):
            w[at] = f"new{i}"
        texts.append(" ".join(w))
    known = simhash._Hashes()
    sets, words = [simhash.shingles(t.encode(), 5, known) for t in texts], [word_runs(t) for t in texts]
    assert simhash._alike(sets, 0.8).tolist() == [[len(a & b) >= 0.8 * len(a | b) for b in words] for a in words]
    got = {r.doc_id for r in simhash.simhash_dedup(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == set(brute_near(texts))


# --- Decontamination


def brute_hits(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, hit, found = find(text), set(), set()
    for i, t in items:
        w = find(t)
        if not w:
            continue
        m = min(10, len(w))
        for s in range(len(w) - m + 1):
            for at in range(len(words) - m + 1):
                if words[at : at + m] == w[s : s + m]:
                    hit.update(range(at, at + m))
                    found.update({i} - {None})
    sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(words), len(hit), len(found), sha, bool(hit)


def test_decontaminate_matches_brute_force(spark, empty):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choices(words, k=n))) for i, n in enumerate([1, 2, 3, 5, 9, 10, 11, 14, 30, 30])]
    items += [(2, items[3][1]), (20, None), (21, "..."), (None, "w1 w2 w3"), (5, items[5][1])]
    items = [(i, (t or "").replace("w0", "É0").replace(" ", "-") if t and i == 4 else t) for i, t in items]
    rows = []
    for i in range(80):
        t = " ".join(rnd.choices([*words, "Zz", "q"], k=rnd.randint(0, 60)))
        if i % 3 == 0:
            t += " " + rnd.choice([x for _, x in items if x]).upper().replace(" ", ", ") + " tail"
        rows.append((i, t, "s"))
    rows += [(100 + i, t, "s") for i, t in enumerate(ODD[:6])] + [rows[0], (None, "w1 w2", None)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    df = frame(spark, rows)
    got = sorted((tuple(r)[:6] for r in decontaminate.benchmark_hits(df, bench).collect()), key=str)
    want = sorted(((i, *brute_hits(t, items)) for i, t, _ in rows), key=str)
    assert got == want
    assert sum(r[5] for r in got) > 20
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not w[5] for w in want)
    assert decontaminate.benchmark_hits(empty, bench).count() == 0
    assert not decontaminate.benchmark_hits(df, bench.limit(0)).where("contaminated").count()


def test_decontaminate_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"t{i}x{j}" for j in range(12))) for i in range(20)]
    rows = [(i, f"a b {t} c {items[(i + 1) % 20][1]}", "s") for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.benchmark_hits(frame(spark, rows), bench).collect()
    monkeypatch.setattr(decontaminate, "TABLE_BYTES", 300)
    assert sorted(map(str, decontaminate.benchmark_hits(frame(spark, rows), bench).collect())) == sorted(map(str, one))
    assert {r.n_items for r in one} == {2}
    kept = decontaminate.decontaminate(frame(spark, [*rows, (99, "a b c", "s")]), bench).collect()
    assert [r.doc_id for r in kept] == [99]


def test_search_table_is_small():
    import pickle

    rnd = random.Random(9)
    items = [(i, " ".join(f"w{int(rnd.paretovariate(0.5))}" for _ in range(200)).encode()) for i in range(600)]
    text = sum(len(t) for _, t in items)
    assert len(pickle.dumps(decontaminate.Searcher(items))) < 25 * text


# --- Mixing


def brute_targets(totals):
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(totals.values()), dict.fromkeys(order, 0.0), set(order)
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * totals[s]}
        if not over:
            target.update({s: left * weight[s] / w for s in free})
            break
        for s in over:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= over
    return target


def test_mix(docs, empty):
    rows, df = docs
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = mixing.mix_plan(df).collect()
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, _ in rows)
    totals = {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    target = brute_targets(totals)
    for s in totals:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == totals[s] for r in own)
        assert all(abs(r.target - target[s]) < 1e-6 * target[s] for r in own)
        spare = max(r.size for r in own)  # what is left over when one document is most of the source
        assert abs(sum(r.taken for r in own) - target[s]) <= (20 if spare < 1000 else spare / 3)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(str, mixing.mix_plan(df.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix_plan(empty).count() == 0


def test_pareto_ranks_follow_odds(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("one").alias("source"), (F.col("id") % 2).alias("h"))
    plan = mixing.mix_plan(df, share=0.5, odds=F.when(F.col("h") == 0, 3.0).otherwise(1.0)).withColumn("h", F.col("doc_id") % 2)
    n = {r.h: r.n for r in plan.where("copies > 0").groupBy("h").agg(F.count("*").alias("n")).collect()}
    assert abs(sum(n.values()) - 3000) <= 1 and 1.4 < n[0] / n[1] < 2.2


def brute_mix(rows, weights=(5, 2, 1)):
    """Words that a plain walk through all rows in order of rank takes of each source."""
    import hashlib
    import math

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    totals, taken = {}, {}
    for _, t, s in rows:
        totals[s] = totals.get(s, 0) + size(t)
    targets = brute_targets(totals)
    for s, total in totals.items():
        own = [(i, size(t), t) for i, t, x in rows if x == s]
        whole = int(targets[s] / total) if total else 0
        p = targets[s] / total - whole if total else 0
        taken[s] = whole * total
        if p <= 0:
            continue
        mean = sum(math.sqrt(max(n, 1)) for _, n, _ in own) / len(own)
        ranked = []
        for i, n, t in own:
            u = (int(hashlib.md5(f"42:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
            q = u / (1 - u) / (p / (1 - p) * math.sqrt(max(n, 1)) / mean)
            if n:
                ranked.append((int(q / (1 + q) * (1 << 30)), n))
        gap, rest = targets[s] - taken[s], []
        ranked.sort()
        for k, (_, n) in enumerate(ranked):
            if n > gap:
                rest = [n for _, n in ranked[k:]]
                break
            gap -= n
        best = min(rest, key=lambda n: abs(gap - n), default=None)
        if best is not None and abs(gap - best) < gap:
            gap -= best
        taken[s] = targets[s] - gap
    return taken


def test_mix_draws_in_order_of_rank(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * int(rnd.paretovariate(1.1) * 9 + 1)), rnd.choice(["a", "b", "c", "d", None])) for i in range(1500)]
    got = mixing.mix_plan(frame(spark, rows)).collect()
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_mix(rows)
    assert taken.keys() == want.keys() and all(abs(taken[s] - want[s]) < 1e-6 * want[s] + 1e-6 for s in want)
    target = {r.source: r.target for r in got}
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in taken)


def test_mix_equal_rows_one_by_one(spark):
    rows = [(7, "a b c d e f g h i j k l", "z")] * 1000 + [(i, "x " * 40, "a") for i in range(10, 300)] + [(i, "x " * 35, "b") for i in range(300, 900)]
    got = mixing.mix_plan(frame(spark, rows).repartition(3)).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert len({r.copies for r in got if r.source == "z"}) == 2
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    mixed = mixing.mix(frame(spark, rows)).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in mixed} == {s: sum(r.copies for r in got if r.source == s) for s in taken}


def test_longer_documents_are_drawn_more_often(spark):
    rows = [(i, "w " * (100 if i % 2 else 400), "one") for i in range(4000)]
    got = mixing.mix_plan(frame(spark, rows), share=0.4).collect()
    drawn = [sum(r.copies for r in got if r.size == n) for n in (100, 400)]
    odds = [d / (2000 - d) for d in drawn]
    assert 1.6 < odds[1] / odds[0] < 2.5


# --- Sharding


def test_shards_match_brute_force(docs, empty):
    rows, df = docs
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1))
    sizes = [len((t or "").encode()) + 1 for _, t, _ in order]
    total, upto, want, slots = sum(sizes), 0, [], {}
    for (i, t, _), s in zip(order, sizes, strict=True):
        shard = min(15, (2 * upto + s) * 16 // (2 * total))
        want.append((i, s, zlib.crc32((t or "").encode()), "bytes", shard, slots.get(shard, 0), None))
        slots[shard] = slots.get(shard, 0) + 1
        upto += s
    got = [tuple(r) for r in sharding.shards(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sharding.shards(empty).count() == 0
    carried = sharding.shards(df, carry=True).select("shard", "row.*")
    assert carried.columns == ["shard", *df.columns] and carried.count() == len(rows)
