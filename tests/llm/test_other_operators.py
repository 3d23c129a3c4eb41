"""Passages, filters, scorers and search against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meldspark.llm import linededup, lmscore, neighbours, passages, quality, urlfilter

# --- Passages


def random_words(rnd, n):
    return [f"v{rnd.randrange(5000)}" for _ in range(n)]


def test_chains_match_quadratic_dp():
    rnd = random.Random(0)
    for _ in range(60):
        boxes = []
        for _ in range(rnd.randint(2, 14)):
            a, b, n = rnd.randrange(200), rnd.randrange(200), rnd.randint(5, 20)
            boxes.append((a, a + n, b, b + n, n))
        boxes = np.array(boxes)
        best = [0.0] * len(boxes)
        for i in sorted(range(len(boxes)), key=lambda i: (boxes[i][0], boxes[i][2])):
            a0, _, b0, _, cover = boxes[i]
            follow = [best[j] - 0.1 * (a0 - boxes[j][1] + b0 - boxes[j][3]) for j in range(len(boxes)) if boxes[j][1] <= a0 and boxes[j][3] <= b0]
            best[i] = cover + max([0.0, *follow])
        first = passages.chains(boxes)[0]
        got = boxes[first, 4].sum() - 0.1 * sum(boxes[y][0] - boxes[x][1] + boxes[y][2] - boxes[x][3] for x, y in zip(first, first[1:], strict=False))
        assert abs(got - max(best)) < 1e-9
        assert sorted(i for c in passages.chains(boxes) for i in c) == list(range(len(boxes)))


def test_common_subsequence():
    rnd = random.Random(1)
    for _ in range(100):
        a, b = ([rnd.randrange(4) for _ in range(rnd.randint(0, 15))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert passages._common(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_winnow_shares_seeds():
    rnd = random.Random(2)
    for _ in range(50):
        shared = random_words(rnd, 14)
        x, y = (passages.word_hashes(" ".join(random_words(rnd, 9) + shared + random_words(rnd, 9)).encode(), passages._Hashes()) for _ in range(2))
        assert set(passages.winnow(x)[0]) & set(passages.winnow(y)[0])


def test_planted_passages(spark):
    rnd = random.Random(3)
    docs, planted = {}, []
    for i in range(120):
        docs[i] = random_words(rnd, rnd.randint(20, 400))
    exact, fuzzy = random_words(rnd, 55), random_words(rnd, 90)
    for i in range(0, 60):  # a passage that many share
        docs[i][10:10] = exact
    for i in (70, 75, 80):  # one word in 17 differs, in different places
        copy = [w if j % 17 != i % 7 + 1 else f"other{i}x{j}" for j, w in enumerate(fuzzy)]
        docs[i] = docs[i] + copy
    short = random_words(rnd, 30)  # under the least length
    for i in (90, 91):
        docs[i] = docs[i] + short
    docs[100] = list(docs[101])
    rows = [(i, " ".join(w), 1) for i, w in docs.items()] + [(200, None, 1), (201, "", 1), (None, " ".join(exact), 1), (202, "word " * 3000, 1), (5, " ".join(docs[5]), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chain int")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert set(got) == {*range(60), 70, 75, 80} | ({100, 101} if len(docs[100]) >= 50 else set())
    assert {got[i].class_id for i in range(60)} == {0}
    assert {got[i].class_id for i in (70, 75, 80)} == {70}
    for i in range(60):
        assert any(p.start <= 10 and p.end >= 65 and p.end - p.start < 75 for p in got[i].passages)
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_links_across_partition_borders(spark):
    words = [f"u{i}" for i in range(200)]
    df = spark.createDataFrame([(i, " ".join(words), 0) for i in range(40)], "doc long, text string, x int").select("doc", "text")
    links = passages.seed_links(df.selectExpr("doc", "cast(text as binary) text"), 5, 6)
    seeds = len(passages.winnow(passages.word_hashes(" ".join(words).encode(), passages._Hashes()))[0])
    assert links.count() == 39 * seeds
    assert links.where("b <> a + 1 or ap <> bp").count() == 0


def test_texts_that_repeat_inside(spark):
    rnd = random.Random(7)
    block, line = random_words(rnd, 48), random_words(rnd, 20)
    own = [random_words(rnd, 30) for _ in range(4)]
    twice = block * 3 + block[:24]  # equal texts of 168 words
    docs = {1: twice, 2: random_words(rnd, 80), 3: twice, 5: own[0] + line * 4 + own[1], 6: own[2] + line * 4 + own[3]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 3: 1, 5: 5, 6: 5}
    assert [(p.start, p.end, p.n_match) for p in got[1].passages] == [(0, 168, 168)]
    assert (30, 110, 30, 110, 80) in {(p.start, p.end, p.partner_start, p.partner_end, p.n_match) for p in got[5].passages}


def test_passages_held_apart_by_third_documents(spark):
    rnd = random.Random(9)
    shared, lines = random_words(rnd, 60), [random_words(rnd, 18) for _ in range(4)]
    own = lambda n: random_words(rnd, n)
    docs = {10: own(40) + shared + own(40), 11: own(40) + shared[:42] + own(40), 12: own(40) + shared + own(40)}
    docs |= {i: own(30) + lines[i % 4] + own(30) for i in range(20, 400)}
    for i in (25, 300):
        docs[i] = own(30) + sum(lines, []) + own(30)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == {10: 10, 12: 10, 25: 25, 300: 25}
    assert [(p.start, p.end, p.partner_start, p.partner_end) for p in got[10].passages] == [(40, 100, 40, 100)]
    assert [(p.start, p.end, p.partner_start, p.partner_end) for p in got[25].passages] == [(30, 102, 30, 102)]


def longest_common_runs(texts, least):
    """Pairs of texts that share ``least`` or more words in a row, by all their runs of that length."""
    where = {}
    for i, t in enumerate(texts):
        w = t.split()
        for j in range(len(w) - least + 1):
            where.setdefault(tuple(w[j : j + least]), set()).add(i)
    return {(a, b) for docs in where.values() for a in docs for b in docs if a < b}


def reachable(pairs, n):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in {x for p in pairs for x in p}}


@pytest.mark.parametrize("seed", range(3))
def test_classes_are_those_of_all_shared_runs(spark, seed):
    """Passages of 50 to 70 words, held apart by documents with parts of them of any length."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(12):
        passage = [f"p{rnd.randrange(10**9)}" for _ in range(rnd.randint(50, 70))]
        for _ in range(40):
            n = rnd.choice([12, 30, 44, 45, 46, 47, 48, 49, 49, 49, len(passage), 50])
            at = rnd.randrange(len(passage) - n + 1)
            own = lambda k: [f"o{rnd.randrange(10**9)}" for _ in range(k)]
            texts.append(" ".join(own(rnd.randint(0, 30)) + passage[at : at + n] + own(rnd.randint(0, 30))))
    rnd.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
    want = reachable(longest_common_runs(texts, 50), len(texts))
    assert {i: c for i, c in got.items() if i in want} == want
    # What is found beyond is similar, with a word or two changed at an end.
    assert len(set(got) - set(want)) <= 0.05 * len(texts)


def test_passage_behind_many_fragments(spark):
    passage = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(passage)), (1000, " ".join(["x", *passage]))] + [(i, " ".join([f"a{i}", *passage[i : i + 12], f"b{i}"])) for i in range(1, 49)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id) for r in got} == {(0, 0), (1000, 0)}


def test_changed_passages_held_apart_by_third_documents(spark):
    """A passage with every twelfth word changed has no whole stretch, and each document between
    holds one of its seeds."""
    rnd = random.Random(11)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(4):
        passage = own(72)
        changed = [f"c{k}" if i % 12 == 11 else w for i, w in enumerate(passage)]
        rows += [(100 * k + 1, own(20) + passage), (100 * k + 99, own(9) + changed + own(3)), (100 * k + 98, own(9) + changed + own(3))]
        rows += [(100 * k + 2 + i, own(60) + passage[12 * i : 12 * i + 11] + own(60)) for i in range(6)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == {100 * k + j: 100 * k + 1 for k in range(4) for j in (1, 98, 99)}
    assert all(any(p.start == 20 and p.end == 91 for p in got[100 * k + 1].passages) for k in range(4))


def test_pairs_between_classes_are_all_that_chain(spark):
    """Fragments of one passage in disorder: documents are in one class exactly if all their seeds,
    compared pair by pair, say so."""
    rnd = random.Random(12)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    texts = []
    for _ in range(3):
        pieces = [own(11) for _ in range(7)]
        for _ in range(25):
            chosen = [pieces[i] for i in sorted(rnd.sample(range(7), rnd.randint(1, 7)))]
            texts.append(own(30) + [w for p in chosen for w in p + own(rnd.choice([0, 1, 2, 5, 30]))] + own(30))
    rnd.shuffle(texts)
    known = passages._Hashes()
    words = [passages.word_hashes(" ".join(t).encode(), known) for t in texts]
    seeds = [dict(zip(*(x.tolist() for x in passages.winnow(w)), strict=True)) for w in words]
    pairs = []
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            if len(both := sorted(seeds[i].keys() & seeds[j].keys(), key=seeds[i].get)) < 2:
                continue
            boxes = passages.diagonal_runs(np.array([seeds[i][h] for h in both]), np.array([seeds[j][h] for h in both]), 5, 11)
            for chain in passages.chains(boxes):
                if boxes[chain, 4].sum() >= 10 and boxes[chain[-1], 1] - boxes[chain[0], 0] >= 25:
                    low_a, high_a, low_b, high_b = (max(0, boxes[chain[0], 0] - 32), boxes[chain[-1], 1] + 32, max(0, boxes[chain[0], 2] - 32), boxes[chain[-1], 3] + 32)
                    at = boxes[chain][:, :4] - np.array([low_a, low_a, low_b, low_b])
                    if passages.similar_parts(words[i][low_a:high_a], words[j][low_b:high_b], at, 50, 0.8):
                        pairs.append((i, j))
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
    want = reachable(pairs, len(texts))
    assert len(want) > 20 and {i: c for i, c in got.items() if i in want} == want


def test_stretches_are_the_same_anywhere():
    rnd = np.random.default_rng(0)
    a, b = rnd.integers(0, 1 << 63, 300, np.uint64), rnd.integers(0, 1 << 63, 90, np.uint64)
    b[20:80] = a[200:260]
    h, g = passages.stretches(a, np.arange(300), 45), passages.stretches(b, np.arange(90), 45)
    assert (h[200:216] == g[20:36]).all() and len(np.intersect1d(h[h > 0], g[g > 0])) == 16
    assert (h[256:] == 0).all() and (h[:256] > 0).all() and len(np.unique(h)) == 257


def test_chains_are_split_at_gaps(spark):
    rnd = random.Random(8)
    p, q, stock = random_words(rnd, 60), random_words(rnd, 60), random_words(rnd, 25)
    own = [random_words(rnd, 100) for _ in range(4)]
    docs = {1: p + own[0] + q, 2: p + own[1] + q, 11: q[::-1] + own[2][:50] + stock, 12: q[::-1] + own[3][:50] + stock}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.end, x.partner, x.partner_start, x.partner_end, x.n_match) for x in r.passages] for r in passages.repeated_passages(df).collect()}
    assert got[1] == [(0, 60, 2, 0, 60, 60), (160, 220, 2, 160, 220, 60)]
    assert got[11] == [(0, 60, 12, 0, 60, 60)]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_places_are_linked_in_turn(monkeypatch, size):
    import pyarrow as pa

    rnd = random.Random(size)
    seeds = sorted({(rnd.randrange(4), rnd.randrange(5), rnd.randrange(30)) for _ in range(150)})
    monkeypatch.setattr(passages, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    doubled = [x for x in seeds for _ in range(2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*doubled[i : i + size], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["h", "d", "p"]) for i in range(0, len(doubled), size)]
    got = Counter(tuple(r[c] for c in ("h", "a", "ap", "b", "bp")) for b in passages._neighbour_links(batches) for r in b.to_pylist() if r["kind"] == 0)
    want = Counter()
    for h in range(4):
        lists = [(d, [p for x, y, p in seeds if (x, y) == (h, d)]) for d in range(5)]
        lists = [x for x in lists if x[1]]
        for d, places in lists:
            want.update((h, d, p, d, q) for p, q in zip(places, places[1:], strict=False))
        for (a, p), (b, q) in zip(lists, lists[1:], strict=False):
            want.update((h, a, x, b, y) for x, y in zip(p, q, strict=False))
            want.update([(h, a, p[-1], b, q[-1])] if len(p) != len(q) else [])
    assert got == want


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_stretches_of_shared_seeds(monkeypatch, size):
    import pyarrow as pa

    rnd = random.Random(size)
    seeds = sorted({(rnd.randrange(60), rnd.randrange(5), rnd.randrange(30)) for _ in range(110)})
    rows = [(*x, 0 if rnd.random() < 0.2 else 1000 + i) for i, x in enumerate(seeds)]
    monkeypatch.setattr(passages, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["h", "d", "p", "s"]) for i in range(0, len(rows), size)]
    key = lambda h, s: int((np.array([h], np.uint64) * passages._MULT ^ np.array([s], np.uint64) * passages._MULT).view(np.int64)[0])
    got = Counter((r["h"], r["a"], r["ap"]) for b in passages._neighbour_links(batches) for r in b.to_pylist() if r["kind"] == 3)
    docs = {}
    for h, d, *_ in rows:
        docs.setdefault(h, set()).add(d)
    ends = {rows[0][:2], rows[-1][:2]}  # the partitions beside may have more of these
    assert got == Counter((key(h, s), d, p) for h, d, p, s in rows if s and (len(docs[h]) > 1 or (h, d) in ends))


# --- URL filter


def test_url_parts_and_rules(spark, tmp_path):
    urls = [
        "http://A.example.com/en/71?x#y", "https://example.com/en/8", "http://b.example.net/de/81", "net://x.net/de/", "http://org/es/?q", "ftp://u@W.COM:80/en/a://b/c",
        "http://host?x=/en/", "http://Ünï.com/en/#f", "no scheme", None, "", "://", "x://y://z/en/", "http://notcom/en/1", "http://a\nb.com/en/1", "http://s.co.uk/fr/",
    ]
    df = spark.createDataFrame([(i, u, "h", 0) for i, u in enumerate(urls)], "page_id long, url string, host string, bad int")
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]
    for r in urlfilter.url_verdicts(df).collect():
        u = urls[r.page_id]
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = max((x for x in rules if (host == x[1] or host.endswith("." + x[1])) and path.startswith(x[2])), key=lambda x: len(x[1] + x[2]), default=None)
        assert (r.host, r.path) == (host, path)
        assert r.rule == (fit[1] + fit[2] if fit else None)
        assert r.verdict in ("allow", "block") and (not fit or r.verdict == fit[0])
    assert urlfilter.url_verdicts(df.limit(0)).count() == 0


def test_url_query_takes_the_rules_of_its_contract(spark, tmp_path):
    from meldspark.llm.queries import op6_url_filter

    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/71": ("example.com/en/7", "allow"), "http://b.net/de/81": ("net/de/", "allow"),
        "http://example.net/de/7": ("net/de/", "allow"), "http://m.example.net/de/81": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in op6_url_filter(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))


def test_reputation_shrinks(spark):
    rows = [("a.bad.com", 1)] * 40 + [("b.bad.com", None)] * 3 + [("c.bad.com", 0)] * 2 + [("d.good.com", 0)] * 60 + [("e.good.com", 1)] + [("x.other.net", None)]
    rep = {r.host: r for r in urlfilter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert rep["a.bad.com"].mean > rep["b.bad.com"].mean > rep["c.bad.com"].mean
    assert rep["b.bad.com"].mean > rep["e.good.com"].mean - 0.5 and rep["d.good.com"].mean < 0.1
    assert rep["a.bad.com"].lower > 0.5 and all(r.lower < r.mean for r in rep.values())
    assert 0.2 < rep["x.other.net"].mean < 0.8


def test_suffixes(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "x.y.example.com", "example.com", "localhost", "u@z.example.org:80", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(urlfilter.registered_domain(df.h), urlfilter.public_suffix(df.h)).collect()]
    assert got == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("example.com", "com"), ("example.com", "com"), ("localhost", "localhost"), ("example.org", "org"), ("", "")]


# --- Nearest neighbours


def test_nearest_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[200:350] = x[7]
    x[350:360] = x[7] + np.float32(1e-4)
    x[400:420] *= 1000
    rows = [(i, [float(v) for v in r], 0.0) for i, r in enumerate(x)]
    rows += [(1000, None, 0.0), (1100, [0.0] * 16, 0.0), (1200, [float("nan")] * 16, 0.0), (1300, [None] * 16, 0.0), (1400, [1.0, 2.0], 0.0), (1401, [1.0, 2.5], 0.0), (None, [1.0] * 16, 0.0), (1500, [], 0.0), (1600, [float("inf")] * 16, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double").repartition(5)
    d = np.sqrt(((x[:, None, :].astype(float) - x[None].astype(float)) ** 2).sum(-1))
    want = []
    for q in range(0, 900, 50):
        for rank, i in enumerate(sorted((i for i in range(900) if i != q), key=lambda i: (d[q, i], i))[:10]):
            want.append((q, rank + 1, i))
    want += [(1400, 1, 1401)]
    for size in (16 << 20, 500):
        monkeypatch.setattr(neighbours, "QUERY_BYTES", size)
        got = sorted(tuple(r) for r in neighbours.nearest(df, df.vec_id % 50 == 0).collect())
        assert [g[:3] for g in got] == want
        assert all(math.isclose(s, d[q, i] if q < 900 else 0.5, rel_tol=1e-12, abs_tol=1e-12) for q, _, i, s in got)
    assert neighbours.nearest(df.limit(0), df.vec_id % 50 == 0).count() == 0


@pytest.mark.parametrize("tile", [16, 4096])
def test_nearest_with_repeated_rows(spark, monkeypatch, tile):
    monkeypatch.setattr(neighbours, "TILE", tile)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    rows = [(i, x[i].tolist()) for i in range(60)]
    rows += [(0, x[0].tolist())] * 14 + [(7, x[7].tolist())] * 12  # the query itself, and another row
    rows += [(20, x[20].tolist())] * 11 + [(61, x[20].tolist())]  # two ids with one vector
    rows += [(40, (x[40] + 1e-3 * j).tolist()) for j in range(1, 25)]  # one id with many vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    want = []
    for q in (0, 20):
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x[q], v, strict=True)))), i) for i, v in rows if i != q)
        want += [(q, rank + 1, i) for rank, (_, i) in enumerate(near[:10])]
    for parts in (df, df.repartition(3)):
        assert sorted(tuple(r)[:3] for r in neighbours.nearest(parts, df.vec_id.isin(0, 20)).collect()) == want


# --- Lines


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(5)
    pages, text = [], {}
    for i in range(120):
        host = rnd.choice(["A.com", "b.com", "c.com", "d.com"]) if i < 110 else None
        lines = [f"line {rnd.randrange(40)}" for _ in range(6)] + (["menu", "menu"] if host == "A.com" else []) + ([f"foot {host}"] if rnd.random() < 0.35 else [])
        text[i] = lines
        html = "<html><!-- x --><script>var t='</p>';</script><body>" + "".join(f"<p class='q'>{x.replace(' ', '  <b>')}</b></p>" if k % 2 else f"<li>{x}<br/>" for k, x in enumerate(lines)) + "</body>"
        pages.append((i, f"http://{host}/p{i}" if host else None, html, 0))
    pages += [(200, "http://a.com/", None, 0), (201, "http://a.com/", "", 0), (202, "http://lone.org/", "<p>menu</p>", 0), (None, "http://b.com/z", "<p>z</p>", 0)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, salt int")
    text |= {200: [], 201: [], 202: ["menu"], None: ["z"]}
    hosts = {i: (u or "").split("/")[2].lower() if u else "" for i, u, _, _ in pages}
    total = Counter(h for h in hosts.values() if h)
    seen = Counter((hosts[i], x) for i, v in text.items() for x in set(v))
    got = {r.page_id: r for r in linededup.dedup_lines(df).collect()}
    for i, v in text.items():
        h = hosts[i]
        kept = [x for x in v if not (h and seen[h, x] >= 3 and seen[h, x] > 0.3 * total[h])]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(v), len(v) - len(kept), "\n".join(kept))
    assert sum(r.n_dropped for r in got.values()) > 30
    assert linededup.dedup_lines(df.limit(0)).count() == 0


# --- Language models


def brute_losses(texts, corpora, mu=50):
    """Losses of each text under the models of the corpora, on words themselves."""
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    words, pairs = [Counter() for _ in corpora], [Counter() for _ in corpora]
    for w, p, corpus in zip(words, pairs, corpora, strict=True):
        for t in map(split, corpus):
            if t:
                w.update(["", *t])
                p.update(zip(["", *t], t, strict=False))
    vocabulary = len({x for w in words for x in w if x})
    out = []
    for t in map(split, texts):
        row = []
        for w, p in zip(words, pairs, strict=True):
            all_ = sum(w.values()) - w[""]
            row.append(-sum(math.log((p[v, x] + mu * (w[x] + 1) / (all_ + vocabulary)) / (w[v] + mu)) for v, x in zip(["", *t], t, strict=False)) / len(t) if t else None)
        out.append((len(t), *row))
    return out


@pytest.mark.parametrize("chunk_bytes", [200, 1 << 23])
def test_cross_entropy_difference(spark, chunk_bytes):
    rnd = random.Random(6)
    good = [" ".join(rnd.choices(["alpha", "beta", "gamma", "Delta"], k=rnd.randint(1, 60))) for _ in range(30)]
    rest = [" ".join(rnd.choices(["one", "two", "alpha", "É"], k=rnd.randint(1, 60))) for _ in range(60)]
    rows = [(i, t, 1.0) for i, t in enumerate(good + rest)]
    rows += [(500, None, 1.0), (501, " ", 1.0), (None, "one", 1.0), (None, "one", 2.0), (0, good[0], 1.0), (0, "another text", 1.0), (600, "the " * 40_000, 1.0), (601, "x" * 500_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(5)
    ids = spark.createDataFrame([(i, 0) for i in range(30)] * 2 + [(None, 1), (9999, 1)], "doc_id long, chunk int")
    in_target = [t for i, t, _ in rows if i is not None and i < 30]
    every = [t for _, t, _ in rows]

    def same(got, corpora):
        want = [(-1 if i is None else i, *x) for (i, _, _), x in zip(rows, brute_losses([t for _, t, _ in rows], corpora), strict=True)]
        for g, w in zip(sorted(got, key=str), sorted([(*w, None if w[2] is None else w[2] - w[3]) for w in want], key=str), strict=True):
            assert g[:2] == w[:2] and all((x is None and y is None) or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(g[2:], w[2:], strict=True))

    run = lambda *a, **k: [(r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.target_loss, r.background_loss, r.score) for r in lmscore.cross_entropy_difference(*a, chunk_bytes=chunk_bytes, **k).collect()]
    got = run(df, target_ids=ids)
    same(got, [in_target, every])
    other = spark.createDataFrame([("alpha two new",), (None,)], "text string")
    same(run(df, target=other, background=df.where("doc_id > 40")), [["alpha two new"], [t for i, t, _ in rows if (i or 0) > 40]])
    same(run(df, target_ids=ids.limit(0)), [[], every])
    mean = lambda rows: sum(r[4] for r in rows) / len(rows)
    assert mean([r for r in got if 0 < r[0] < 30]) < 0 < mean([r for r in got if 30 <= r[0] < 500])
    assert lmscore.cross_entropy_difference(df.limit(0), target_ids=ids).count() == 0


def test_counts_and_hashes_pack():
    rng = np.random.default_rng(3)
    for n in (0, 1, 500):
        counts = rng.choice([0, 1, 254, 255, 256, 1 << 40], n).astype(np.int64)
        assert lmscore._wide(lmscore._narrow(counts), n).tolist() == counts.tolist()
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        assert lmscore._unpack(lmscore._pack(keys)).tolist() == keys.tolist()


# --- Quality


def test_weak_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n, accuracy = 20_000, [0.95, 0.85, 0.7, 0.6]
    truth = rng.random(n) < 0.3
    votes = np.stack([np.where(rng.random(n) < 0.25, quality.NONE, np.where(rng.random(n) < a, truth, ~truth)) for a in accuracy], axis=1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    bad, tables = quality.weak_label_model(patterns, counts.astype(float))
    for j, a in enumerate(accuracy):
        assert abs(tables[j, 1, quality.BAD] / 0.75 - a) < 0.06
    of = {tuple(p): b for p, b in zip(patterns.tolist(), bad, strict=True)}
    assert np.mean([(of[tuple(v)] > 0.5) == t for v, t in zip(votes.tolist(), truth, strict=True)]) > 0.9


def test_quality_on_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels = spark.read.parquet(f"{base}/labels.parquet").where("doc_id is not null")
    train = labels.where("pmod(xxhash64(doc_id), 4) > 0")
    test = labels.where("pmod(xxhash64(doc_id), 4) = 0").join(quality.quality_scores(docs, train), "doc_id").toPandas()
    bad = (test.quality == 0) | (test.toxic == 1)
    kept = test.score >= quality.THRESHOLD
    assert (kept[~bad]).mean() > 0.97
    assert (~kept[test.toxic == 1]).mean() > 0.9  # fitted on under a thousand labels


def plain_em(votes, held, rounds=100):
    """Expectation-maximisation document by document, without patterns."""
    bad = [0.9 if quality.BAD in v else 0.05 for v in votes]
    for _ in range(rounds):
        prior = [sum(1 - b for b in bad) + 1, sum(bad) + 1]
        tables = []
        for j in range(len(votes[0])):
            rows = []
            for y in (0, 1):
                tally = [0.5 + sum((b if y else 1 - b) for v, b in zip(votes, bad, strict=True) if v[j] == x) for x in range(3)]
                if j in held:
                    voted = tally[0] + tally[1]
                    tally[y] = min(max(tally[y], held[j][0] * voted), held[j][1] * voted)
                    tally[1 - y] = voted - tally[y]
                rows.append([t / sum(tally) for t in tally])
            tables.append(rows)
        new = []
        for v in votes:
            p = [prior[y] / sum(prior) * math.prod(tables[j][y][x] for j, x in enumerate(v)) for y in (0, 1)]
            new.append(p[1] / sum(p))
        done = max(abs(a - b) for a, b in zip(new, bad, strict=True)) < 1e-9
        bad = new
        if done:
            break
    return bad


@pytest.fixture(scope="module")
def looks(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet").where("doc_id is not null")
    return quality.looked(spark.read.parquet(f"{base}/documents.parquet"), "doc_id", "text"), labels


def test_training_labels_are_plain_em(looks):
    table, labels = looks
    soft, _ = next(quality.fit_rounds(table, labels))
    marks = {r.doc_id: r.bad for r in quality.gold_marks(labels).collect()}
    rows = sorted((r.doc_id, bytes(r.features), r.votes) for r in table.collect())
    features = [quality.unpack(f) for _, f, _ in rows]
    known = [i for i, r in enumerate(rows) if r[0] in marks]
    flags = np.zeros(1 << quality.FEATURE_BITS, bool)
    flags[quality._lexicon([features[i] for i in known], np.array([marks[rows[i][0]] for i in known]))] = True
    votes = [[*(v // 3**i % 3 for i in range(4)), quality._lexicon_vote(f, flags), quality.NONE, marks.get(d, quality.NONE)] for (d, _, v), f in zip(rows, features, strict=True)]
    want = plain_em(votes, {6: quality.ANNOTATOR})
    assert len(soft) == len(rows) and len(known) < len(rows)  # annotated and other documents
    assert np.abs(soft - np.array(want)).max() < 1e-6


def test_each_labeller_counts(looks):
    table, labels = looks
    before = [soft for soft, _ in quality.fit_rounds(table, labels)]
    turned = table.withColumn("votes", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.col("votes") - F.col("votes") % 3 + 1).otherwise(F.col("votes")))
    after = [soft for soft, _ in quality.fit_rounds(turned, labels)]
    for x, y in zip(before, after, strict=True):
        assert (np.abs(x - y) > 1e-3).any()


def test_features_pack():
    rng = np.random.default_rng(2)
    for some in ([], [5], [65535], [65536, 131070, 196605, 4_000_000], np.unique(rng.integers(0, 1 << 22, 500))):
        some = np.array(some, np.int32)
        assert quality.unpack(quality.pack(some)).tolist() == some.tolist()


def test_look_on_long_and_odd_texts():
    known = quality._Words()
    assert quality.look("word " * 300_000, known)[0][2:] == [quality.BAD, quality.BAD]
    votes, features = quality.look(" ".join(f"w{i}" for i in range(400_000)), known)
    assert votes[2:] == [quality.GOOD, quality.GOOD] and len(features) > 300_000
    assert quality.look("x" * 1_000_000, known)[1].size and quality.look("??!!", known)[0] == [quality.NONE] * 4


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "fine words here", "x"), (None, "no id", "x"), (3, "fine words here", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        assert quality.quality_scores(docs, some).count() == 5
        kept = quality.quality_filter(docs, some)
        assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


# --- Edge cases of several operators


def test_urls_that_repeat_and_long_ones(spark):
    long = "http://l.net/" + "p/" * 300_000
    urls = ["http://a.com/en/x"] * 3 + [long, long + "?q", "http://" + "h" * 200_000 + ".com/en/", None, None]
    df = spark.createDataFrame([(i % 5, u, "r") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = urlfilter.url_verdicts(df).collect()
    assert len(got) == len(urls)
    assert sorted(r.rule or "" for r in got) == ["", "", "", "", "com/en/", "com/en/", "com/en/", "com/en/"]
    assert max(len(r.path) for r in got) == len(long) - len("http://l.net")


def test_lines_that_repeat_and_long_ones(spark):
    long = "x" * 400_000
    pages = [(i, f"http://a.com/{i}", f"<p>{long}</p><p>own {i}</p><p>again</p><p>again</p>", "h") for i in range(6)]
    pages += [(0, "http://a.com/0", f"<p>{long}</p>", "h")] * 2 + [(9, "http://b.com/", "<p>" + "line</p><p>" * 20_000, "h"), (None, None, None, None)]
    got = linededup.dedup_lines(spark.createDataFrame(pages, "page_id long, url string, html string, host string")).collect()
    assert len(got) == len(pages)
    assert sorted(r.text for r in got if r.host == "a.com") == ["", "", *(f"own {i}" for i in range(6))]
    assert next(r for r in got if r.page_id == 9).n_dropped == 0  # one page is no boilerplate


def test_a_chance_of_exactly_the_threshold_stays(spark):
    texts = ["plain words here", None, "", "plain words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert scores[0] == scores[3]
    kept = quality.quality_filter(docs, labels, threshold=scores[0]).collect()
    assert {r.doc_id for r in kept} == {i for i, s in scores.items() if s >= scores[0]} >= {0, 3}


def test_repeated_words_of_a_pair_meet_at_their_ends(spark):
    """Runs of one word are linked where both begin and where both end, whatever their lengths; other
    places, of both documents, each with each."""
    places = [(1, 7, p) for p in range(100, 600)] + [(1, 8, 5), (1, 8, 90)] + [(2, 7, p) for p in range(30, 70)] + [(2, 8, 3), (2, 9, 1)]
    runs = passages._place_runs(spark.createDataFrame(places, "doc long, h long, pos int"))
    for a, b in ((1, 2), (2, 1)):
        links = passages._pair_links(spark.createDataFrame([(a, b)], "a long, b long"), runs, 5).collect()
        assert {(r.a, r.b) for r in links} == {(a, b)}
        turned = {(r.ap, r.bp, r.n) if a == 1 else (r.bp, r.ap, r.n) for r in links}
        assert len(links) == len(turned) and turned == {(100, 30, 44), (560, 30, 44), (5, 3, 5), (90, 3, 5)}


def test_passages_between_classes_across_repeated_words(spark):
    """A changed passage with a repeated word in it, held apart by documents with its fragments."""
    own = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    one, two = own("p", 24), own("q", 24)
    rows = [(1, own("a", 40) + one + ["it"] * 20 + two + own("b", 40)), (9, own("c", 40) + one[:12] + ["x"] + one[13:] + ["it"] * 20 + two[:12] + ["y"] + two[13:] + own("d", 40))]
    rows += [(2 + i, own(f"e{i}", 60) + piece + own(f"f{i}", 60)) for i, piece in enumerate((one, two, ["it"] * 26, one, two, ["it"] * 40))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == {1: 1, 9: 1}
    assert [(p.start, p.end, p.partner) for p in got[1].passages] == [(40, 108, 9)]


def test_a_passage_in_a_class_held_apart_by_its_other_documents(spark):
    """All documents share a heading, so they are one class. Two share a changed passage as well, and
    each of the others holds a piece of it."""
    rnd = random.Random(13)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    heading, passage = own(60), own(72)
    changed = ["c" if i % 12 == 11 else w for i, w in enumerate(passage)]
    rows = [(1, heading + own(40) + passage), (9, heading + own(50) + changed + own(3))]
    rows += [(2 + i, heading + own(60) + passage[12 * i : 12 * i + 11] + own(60)) for i in range(6)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in passages.repeated_passages(df).collect()}
    assert {i: r.class_id for i, r in got.items()} == dict.fromkeys(range(1, 8), 1) | {9: 1}
    assert [(p.start, p.end, p.partner_start, p.partner_end) for p in got[1].passages if p.partner == 9 and p.start > 0] == [(100, 171, 110, 181)]
    assert [p.partner for p in got[9].passages if p.start == 110] == [1]


def test_documents_under_crowded_keys_meet_where_they_go_on_alike(spark, monkeypatch):
    """A line and a repeated word, both shorter than a passage, are in many documents. Only those are
    compared that agree beyond, and none of the passages is lost by that."""
    rnd = random.Random(14)
    own = lambda n: [f"o{rnd.randrange(10**9)}" for _ in range(n)]
    line, after, before = own(46), own(9), own(9)
    texts = [own(30) + line + own(30) for _ in range(40)] + [own(30) + ["it"] * rnd.randint(26, 48) + own(30) for _ in range(40)]
    texts += [own(20) + line + own(1) + after + own(20) for _ in range(2)] + [own(20) + before + own(1) + line + own(20) for _ in range(2)]
    texts += [own(20) + before[:5] + own(1) + line + after[:4] + own(20) for _ in range(2)]
    texts += [own(20) + ["it"] * n + own(1) + after + own(20) for n in (45, 45)] + [own(20) + before + own(1) + ["it"] * n + own(20) for n in (46, 44)]
    texts += [own(20) + ["it"] * 47 + ["x", "it", "it", "it", "it"] + own(20), own(20) + ["it"] * 200 + own(20)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(passages, "materialize", lambda t, name, m=passages.materialize: seen.append((name, m(t, name))) or seen[-1][1])
    monkeypatch.setattr(passages, "discard", lambda *tables: None)

    def classes(crowd):
        monkeypatch.setattr(passages, "CROWD", crowd)
        seen.clear()
        got = {r.doc_id: r.class_id for r in passages.repeated_passages(df).collect()}
        return got, dict(seen)["open-document-pairs"].count()

    (all_, pairs), (got, fewer) = classes(10**6), classes(8)
    assert got == all_ and {80, 81, 82, 83} <= set(got) and len(got) >= 8
    assert pairs > 1500 and fewer < 200


def test_words_in_turn_meet_at_their_ends(spark):
    """Places of one step are one run; two runs of unequal steps are linked at all places."""
    places = [(1, 7, p) for p in range(100, 600, 2)] + [(1, 7, 700), (2, 7, 5)] + [(2, 7, p) for p in range(30, 70, 2)] + [(3, 7, p) for p in (10, 13, 16)]
    runs = passages._place_runs(spark.createDataFrame(places, "doc long, h long, pos int"))
    assert {tuple(r) for r in runs.select("doc", "pos", "len", "step").collect()} == {(1, 100, 250, 2), (1, 700, 1, 0), (2, 5, 1, 0), (2, 30, 20, 2), (3, 10, 3, 3)}
    links = lambda a, b: sorted((r.ap, r.bp, r.n) for r in passages._pair_links(spark.createDataFrame([(a, b)], "a long, b long"), runs, 5).collect())
    assert links(1, 2) == sorted([(100, 30, 43), (560, 30, 43), (100, 5, 5), (598, 5, 5), (700, 5, 5), (700, 30, 5), (700, 68, 5)])
    assert links(2, 3) == sorted([(5, 10, 5), (5, 16, 5)] + [(p, q, 5) for p in range(30, 70, 2) for q in (10, 13, 16)])
