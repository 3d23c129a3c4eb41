"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from test_text_operators import brute_hits, brute_near, brute_targets

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, kept[-1], SF), f"test-{name}")
        assert name == "shard" or out.columns == columns
        kept.append(out)
    first, good, single, clean, mixed, last = [df.collect() for df in kept]

    # Quality: a filter that keeps rows as they are, and the clean ones above all.
    assert not Counter(tuple(r) for r in good) - Counter(tuple(r) for r in first)
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id for r in good}
    fine = [r.doc_id for r in first if labels.get(r.doc_id) == (1, 0)]
    assert sum(i in left for i in fine) >= 0.97 * len(fine)

    # Near copies: the smallest doc_id of each component.
    rows = sorted(good, key=lambda r: r.doc_id)
    assert sorted(map(tuple, single)) == sorted(tuple(rows[i]) for i in set(brute_near([r.text for r in rows])))

    # Decontamination: documents without a hit stay.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, clean)) == sorted(tuple(r) for r in single if not brute_hits(r.text, items)[4])

    # Mix: whole copies, up to two; each source's words near its target.
    copies, known = Counter(map(tuple, mixed)), {tuple(r) for r in clean}
    assert set(copies) <= known and max(copies.values()) <= 2
    size, took = Counter(), Counter()
    for r in clean:
        size[r.source] += words(r.text)
    for r in mixed:
        took[r.source] += words(r.text)
    for source, target in brute_targets(size).items():
        longest = max(words(r.text) for r in clean if r.source == source)
        assert abs(took[source] - target) <= max(20, longest)

    # Shards: every row once, gapless slots, cuts at equal bytes in order of doc_id.
    assert Counter(tuple(r[c] for c in columns) for r in last) == copies
    order = sorted(last, key=lambda r: (r.shard, r.slot))
    total, upto, slots = sum(r.size for r in last), 0, Counter()
    assert [r.doc_id for r in order] == sorted(r.doc_id for r in last)
    for r in order:
        assert r.size == len((r.text or "").encode()) + 1
        assert (r.shard, r.slot) == (min(15, (2 * upto + r.size) * 16 // (2 * total)), slots[r.shard])
        slots[r.shard] += 1
        upto += r.size

    # The whole run gives the same rows.
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, last))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, slot double, row int, number long"
CLASHING = (1, "x", 2.0, 3, 4)


def through(spark, rows):
    """What the stages keep of rows (doc_id, text, source) in a table with clashing names."""
    docs = spark.createDataFrame([(i, t, None, s, None, *CLASHING) for i, t, s in rows], SCHEMA)
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), f"odd-{name}")
        kept.append([r.asDict() for r in out.collect()])
        assert out.columns[: len(docs.columns)] == docs.columns
        docs = out if name != "shard" else docs
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], kept, strict=True)), out


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like the stages' own."""
    plain = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    long = " ".join(f"{a} {i}" for i in range(300) for a in (plain[0] or "").split())
    rows = [(i, t, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(plain)]
    rows += [rows[3], rows[3], (None, plain[5], "s1"), (None, None, None), (50, None, "s1"), (51, "", "s2"), (52, " \t\n", "s2"), (53, long, "s0"), (5, plain[6], "s0")]
    kept, last = through(spark, rows)
    assert last.columns[-3:] == ["size_", "shard_", "slot_"]
    left = kept["quality_classifier"]
    texts = [r["text"] for r in left]
    assert len(kept["near_dedup"]) == len(set(brute_near(texts)))
    # Null ids come last in their group, and wordless texts are one group.
    assert sum(not (r["text"] or "").split() for r in kept["near_dedup"]) == any(not (t or "").split() for t in texts)
    assert {r["doc_id"] for r in kept["near_dedup"]} <= {i for i, _, _ in rows}
    assert all(r["size"] == 1 and r["row"] == 3 for stage in kept.values() for r in stage)
    shards = sorted((r["shard_"], r["slot_"]) for r in kept["shard"])
    assert len(shards) == len(kept["mix_sources"]) == len(set(shards))
    assert sum(r["size_"] for r in kept["shard"]) == sum(len((r["text"] or "").encode()) + 1 for r in kept["mix_sources"])


def test_stages_on_an_empty_table(spark):
    kept, _ = through(spark, [])
    assert not any(kept.values())


def test_runs_do_not_meet(spark):
    one = corpus_pipeline.run(spark, SF)
    two = corpus_pipeline.run(spark, SF)
    corpus_pipeline.STAGES[2][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert two.count() == one.count() > 0
