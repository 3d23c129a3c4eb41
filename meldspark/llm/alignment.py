"""Alignment of two tokenizers over a corpus, from the alignments of its distinct segments.

Texts are cut into segments over which neither vocabulary merges (see ``segments``). Documents are
taken in chunks, each with a dictionary of its own: a document is a sequence of numbers in its
chunk's dictionary (in Simple-8b, commoner segments first), and a dictionary entry is a segment with
its occurrences. The dictionaries meet by segment, so that each distinct segment of the corpus is
tokenised and aligned once; weighted by occurrences, its links add up to the corpus' counts of id
pairs. Alignments and what the counts make of them go back to the entries, those for one chunk in
packed letters, and each chunk composes its documents.

What is shuffled is a row for each segment and chunk, not for each word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import materialize
from . import simple8b
from ._common import hot_keys, join_dealt, runs
from .segments import byte_level, number, pieces

#: Text of the documents of a chunk, about; a longer document is a chunk by itself.
CHUNK_BYTES = 32 << 20
#: Segments that are aligned side by side, and whose letters are written together.
TOGETHER, LETTERS = 20_000, 100_000
#: Entries of a segment in a row; a segment of more entries has several rows.
ENTRIES = 1000
#: Distinct pairs of ids, by 17 bytes each, that tasks hold at once; the counts of more are joined.
PAIRS = 2_000_000
#: A pair of ids is one number, that of A in the upper half; so is an entry, with its chunk in the upper half.
_LOW = (1 << 32) - 1

_PARTS = pa.schema([("chunk", pa.int32()), ("doc_id", pa.int64()), ("length", pa.int32()), ("sequence", pa.binary()), ("entry", pa.int64()), ("segment", pa.string()), ("n", pa.int64())])
_PARTS_SQL = "chunk int, doc_id long, length int, sequence binary, entry long, segment string, n long"


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as one text of bytes: words of Simple-8b, in one block."""
    return simple8b.encode(numbers, max(1, len(numbers)))[0].astype("<u8").tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    words = np.frombuffer(raw, "<u8")
    return simple8b.decode(words, np.array([len(words)]), n, n).astype(np.int64) if n else np.zeros(0, np.int64)


def _chunk(docs: pa.Array, texts: pa.Array, chunk: int, joined: tuple[bytes, ...], divisible: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of a chunk, then of its dictionary, in order of the segments."""
    has = pc.greater(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())), 0)
    parts, at, sizes = number(texts.filter(has), joined, divisible)
    counts = np.bincount(at, minlength=len(parts))
    rank = np.empty(len(parts), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(parts))
    at, sequences, lengths, place = rank[at], [], [], 0
    for n in iter(sizes.tolist()):
        sequences.append(packed(at[place : place + n]))
        place += n
    found = zip(sequences, sizes.tolist(), strict=True)
    for h in has.to_pylist():
        lengths.append(next(found) if h else (None, 0))
    rows = len(docs)
    columns = [pa.array(np.full(rows, chunk, np.int32)), docs, pa.array([n for _, n in lengths], pa.int32()), pa.array([s for s, _ in lengths], pa.binary())]
    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(rows, f.type) for f in list(_PARTS)[4:])], schema=_PARTS)
    order = pc.sort_indices(parts)
    rank, counts, parts = rank[order.to_numpy()], counts[order.to_numpy()], parts.take(order)
    for lo in range(0, len(parts), 50_000):
        some = parts.slice(lo, 50_000)
        columns = [pa.array(np.full(len(some), chunk, np.int32)), *(pa.nulls(len(some), f.type) for f in list(_PARTS)[1:4])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array((chunk << 32) + rank[lo : lo + 50_000]), some, pa.array(counts[lo : lo + 50_000])], schema=_PARTS)


def _divide(a: str, b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(a, True), pieces(b)
        how = (one.joined + two.joined, one.divisible and two.divisible)
        chunk, size, held = TaskContext.get().partitionId() << 12, 0, []  # 4,096 chunks in a partition

        def flush():
            docs, texts = (pa.concat_arrays([x[i] for x in held]) for i in range(2))
            return _chunk(docs, texts, chunk, *how)

        for batch in batches:
            docs, texts = batch.column(0), batch.column(1)
            weight = np.cumsum(pc.coalesce(pc.binary_length(texts), pa.scalar(0, pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(docs):
                before = int(weight[lo - 1]) if lo else 0
                hi = max(lo + (not held), int(np.searchsorted(weight, before + CHUNK_BYTES - size, "right")))
                if hi > lo:
                    held.append((docs.slice(lo, hi - lo), texts.slice(lo, hi - lo)))
                    size += int(weight[hi - 1]) - before
                if hi < len(docs):
                    yield from flush()
                    chunk, size, held = chunk + 1, 0, []
                lo = hi
        if held:
            yield from flush()

    return run


def _overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens of A and of B that share bytes, in order of A, then B; both end at the same byte."""
    begins_a, begins_b = np.concatenate([[0], ends_a[:-1]]), np.concatenate([[0], ends_b[:-1]])
    first = np.searchsorted(ends_b, begins_a, "right")
    n = np.searchsorted(begins_b, ends_a, "left") - first
    of_a = np.repeat(np.arange(len(ends_a)), n)
    return of_a, np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n, n) + first[of_a]


def align(segments: list[str], a, b) -> tuple[np.ndarray, ...]:
    """For each segment: whether its tokens of both spell it, the numbers of its tokens of A and of B and
    of its groups; the groups of those that do as texts, and the pairs of their links with the number
    of links of each."""
    ids, counts = zip(*(v.many(segments) for v in (a, b)), strict=True)
    raw = [s.encode() for s in segments]
    good = np.ones(len(segments), bool)
    whole = np.frombuffer(b"".join(raw), np.uint8)
    for v, i, n in zip((a, b), ids, counts, strict=True):
        if not np.array_equal(np.frombuffer(b"".join(map(v.entries.__getitem__, i.tolist())), np.uint8), whole):
            at = np.concatenate([[0], np.cumsum(n)]).tolist()
            good &= np.array([b"".join(v.entries[x] for x in i[lo:hi]) == r for lo, hi, r in zip(at, at[1:], raw, strict=False)], bool)
    # Good segments have the same bytes in both, so all of them can be laid end to end.
    flat = [i[np.repeat(good, n)] for i, n in zip(ids, counts, strict=True)]
    counts = [np.where(good, n, 0) for n in counts]
    ends = [np.cumsum(v.sizes[f]) for v, f in zip((a, b), flat, strict=True)]
    place_a, place_b = _overlaps(*ends)
    pairs = (flat[0][place_a] << 32) | flat[1][place_b]
    _, *shut = np.intersect1d(*ends, assume_unique=True, return_indices=True)
    texts = [list(map(str, f.tolist())) for f in flat]
    (shut_a, shut_b), (text_a, text_b) = ([0, *(x + 1).tolist()] for x in shut), texts
    groups = [f"{','.join(text_a[p:q])}|{','.join(text_b[r:s])}" for p, q, r, s in zip(shut_a, shut_a[1:], shut_b, shut_b[1:], strict=False)]
    upto = np.cumsum(counts[0])
    n_groups = np.diff(np.searchsorted(shut_a, upto), prepend=0)
    n_links = np.diff(np.searchsorted(place_a, upto), prepend=0)
    at = np.concatenate([[0], np.cumsum(n_groups)]).tolist()
    return good, *counts, n_groups, [";".join(groups[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)], pairs, n_links


_ALIGNED_SQL = "sid long, n long, ok boolean, n_a int, n_b int, n_groups int, groups string, pairs array<long>, entries array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _align(a: str, b: str):
    """Entries (segment, entry, n) in order of the segments, to a row of each segment, or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(a, True), pieces(b)
        sid = TaskContext.get().partitionId() << 40
        for table in runs(batches, 1):
            coded = pc.run_end_encode(table.column(0).combine_chunks())
            words, ends = coded.values, coded.run_ends.to_numpy().astype(np.int64)
            entries, n = (table.column(i).to_numpy() for i in (1, 2))
            begins = np.concatenate([[0], ends[:-1]])
            for lo in range(0, len(words), TOGETHER):
                hi = min(len(words), lo + TOGETHER)
                ok, n_a, n_b, n_groups, groups, pairs, n_links = align([f" {w}" for w in words.slice(lo, hi - lo).to_pylist()], one, two)
                rows = -(-(ends[lo:hi] - begins[lo:hi]) // ENTRIES)  # of each segment; the further ones without weight
                of = np.repeat(np.arange(hi - lo), rows)
                first = np.concatenate([[True], of[1:] != of[:-1]])
                start = begins[lo:hi][of] + ENTRIES * (np.arange(len(of)) - np.flatnonzero(first)[of])
                stop = np.minimum(start + ENTRIES, ends[lo:hi][of])
                weight = np.where(first, np.add.reduceat(n[: ends[hi - 1]], begins[lo:hi])[of], 0)
                linked = _lists(pairs, n_links).take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid + of), pa.array(weight), pa.array(ok[of]), *(pa.array(x[of].astype(np.int32)) for x in (n_a, n_b, n_groups)), pa.array(groups).take(pa.array(of)), linked, _lists(entries[start[0] : stop[-1]], stop - start)],
                    names=["sid", "n", "ok", "n_a", "n_b", "n_groups", "groups", "pairs", "entries"],
                )
                sid += hi - lo

    return run


def _bad_occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (chunk, length, sequence, bad) to the entries of those that hold a bad one, with their occurrences there."""
    for b in batches:
        for chunk, length, raw, bad in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            local, n = np.unique(unpacked(raw, length), return_counts=True)
            entries = (chunk << 32) + local
            if len(np.intersect1d(entries, bad)):
                yield pa.RecordBatch.from_arrays([pa.array(entries), pa.array(n.astype(np.int64))], names=["entry", "n"])


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_DOCS_SQL = "doc_id long, " + ", ".join(f"{c} long" for c in _NUMBERS) + ", groups string"


def _scored(batches: Iterator[pa.RecordBatch], counts) -> Iterator[pa.RecordBatch]:
    """Adds n_links, n_best and count_sum to aligned segments."""
    pairs, c, best = counts.value
    for b in batches:
        lists = b.column(b.schema.names.index("pairs"))
        size, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
        known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)  # those of valid documents are
        b = b.append_column("n_links", pa.array(size))
        for name, values in (("n_best", best), ("count_sum", c)):
            each = np.zeros(len(flat), np.int64)
            each[known] = values[at[known]]
            sums = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(size)])]
            b = b.append_column(name, pa.array(np.diff(sums)))
        yield b


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scored segments to letters (chunk, n, body, raw) with what the entries of a chunk are told."""
    held, rows = [], 0

    def written(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lists = table.column("entries").combine_chunks()
        of, entries = lists.value_parent_indices().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        order = np.argsort(entries)
        of, entries = of[order], entries[order]
        ok = table.column("ok").to_numpy()
        numbers = np.stack([table.column(c).to_numpy().astype(np.int64) for c in _NUMBERS], axis=1)
        groups = np.array([g.encode() for g in table.column("groups").to_pylist()], object)
        chunks, first = np.unique(entries >> 32, return_index=True)
        out = []
        for chunk, lo, hi in zip(chunks.tolist(), first.tolist(), [*first[1:].tolist(), len(of)], strict=True):
            some = of[lo:hi]
            columns = np.concatenate([entries[lo:hi, None] & _LOW, ok[some, None].astype(np.int64), numbers[some]], axis=1)
            planes = np.ascontiguousarray(columns.astype("<i8").view(np.uint8).reshape(hi - lo, -1).T)  # equal bytes side by side
            raw = planes.tobytes() + b"\n".join(groups[some].tolist())
            out.append((chunk, hi - lo, pa.compress(raw, codec="zstd", asbytes=True), len(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.int64()), strict=True)], names=["chunk", "n", "body", "raw"])

    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= LETTERS:
            yield from written(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield from written(pa.Table.from_batches(held))


def _compose(documents: pa.Table, letters: pa.Table) -> pa.Table:
    """The documents of a chunk from what its dictionary is told."""
    told, words = [np.zeros((0, 2 + len(_NUMBERS)), np.int64)], []
    for n, body, raw in zip(*(letters.column(c).to_pylist() for c in ("n", "body", "raw")), strict=True):
        said = pa.decompress(body, decompressed_size=raw, codec="zstd", asbytes=True)
        planes = 8 * (2 + len(_NUMBERS)) * n
        told.append(np.ascontiguousarray(np.frombuffer(said, np.uint8, planes).reshape(-1, n).T).view("<i8"))
        words += said[planes:].split(b"\n")
    told = np.concatenate(told)
    order = np.argsort(told[:, 0])  # the dictionary is complete, so this is the place of each entry
    told, words = told[order], np.array(words, object)[order].tolist() if len(order) else []
    ok, numbers = told[:, 1] != 0, told[:, 2:].T
    sums, texts = [], []
    for raw, length in zip(documents.column("sequence").to_pylist(), documents.column("length").to_pylist(), strict=True):
        s = unpacked(raw or b"", length)
        if len(s) and ok[s].all():
            sums.append(numbers[:, s].sum(axis=1))
            texts.append(b";".join([words[i] for i in s.tolist()]))
        else:
            sums.append(np.zeros(len(_NUMBERS), np.int64))
            texts.append(b"")
    sums = np.array(sums, np.int64).reshape(-1, len(_NUMBERS))
    return pa.table({"doc_id": documents.column("doc_id"), **{c: pa.array(sums[:, i]) for i, c in enumerate(_NUMBERS)}, "groups": pa.array(texts, pa.binary())})


def _whole(documents: pa.Table, letters: pa.Table) -> pa.Table:
    made = _compose(documents, letters)
    return made.set_column(len(_NUMBERS) + 1, "groups", made.column("groups").cast(pa.string()))


def _digest(documents: pa.Table, letters: pa.Table) -> pa.Table:
    made = _compose(documents, letters)
    said = [hashlib.sha256(g).hexdigest() if g else "" for g in made.column("groups").to_pylist()]
    return made.set_column(len(_NUMBERS) + 1, "groups_sha256", pa.array(said, pa.string()))


def alignments(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id; n_a, n_b (tokens of a space and the text by the byte-level
    file ``a``, and of the text by the sentencepiece model ``b``, which adds the space); n_groups (cuts
    where tokens of both end); n_links (pairs of tokens that share bytes); n_best (links whose pair of
    ids is its B id's commonest in the corpus, ties included); count_sum (the corpus' counts of the
    links' pairs); groups (``a1,a2|b1;...``, ids in order), or with ``digest`` groups_sha256.

    Special tokens in a text are plain text. A text that is null or empty, or whose tokens of either
    do not spell a space and the text, has no tokens: zeros and '' (and, as digest, ''); it counts
    for nothing in the corpus. Repeated rows count each. An empty table gives an empty result. Other
    columns are not read. Where the vocabularies do not allow cuts, whole texts are the segments.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = materialize(rows.mapInArrow(_divide(a, b), _PARTS_SQL), "segments", "zstd")
    documents = parts.where("segment is null").select("chunk", "doc_id", "length", "sequence")
    entries = parts.where("segment is not null").select("segment", "entry", "n")
    aligned = materialize(entries.repartition("segment").sortWithinPartitions("segment").mapInArrow(_align(a, b), _ALIGNED_SQL), "aligned", "zstd")

    weights = aligned.where("ok and n > 0").select("sid", "n", "pairs")
    wrong = aligned.where("not ok").select(F.explode("entries").alias("entry"))
    if not wrong.isEmpty():  # their documents count for nothing
        bad = wrong.groupBy(F.shiftright("entry", 32).cast("int").alias("of_chunk")).agg(F.collect_set("entry").alias("bad"))
        seen = documents.where("length > 0").join(bad, F.col("chunk") == F.col("of_chunk")).select("chunk", "length", "sequence", "bad").mapInArrow(_bad_occurrences, "entry long, n long")
        owners = aligned.select("sid", F.explode("entries").alias("entry"))
        less = materialize(owners.join(seen.groupBy("entry").agg(F.sum("n").alias("less")), "entry").groupBy("sid").agg(F.sum("less").alias("less")), "less")
        weights = weights.join(less, "sid", "left").select("sid", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), "pairs").where("n > 0")

    # The corpus' counts of pairs, and which are the commonest of their B id; there are no more of these than ids.
    counts = materialize(weights.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("c"), F.count("*").alias("count")), "pairs")
    b_id = F.col("pair").bitwiseAND(F.lit(_LOW)).alias("b")
    most = counts.groupBy(b_id).agg(F.max("c").alias("most"))
    ranked = counts.select("pair", "c", b_id).join(F.broadcast(most), "b").select("pair", "c", (F.col("c") == F.col("most")).cast("long").alias("best"))
    distinct, links = counts.agg(F.count("*"), F.sum("count")).first()
    if distinct <= PAIRS:
        table = ranked.orderBy("pair").toArrow()
        held = docs.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "c", "best")))
        told = aligned.mapInArrow(lambda batches: _letters(_scored(batches, held)), "chunk int, n int, body binary, raw long")
    else:
        linked = aligned.where("n > 0").select("sid", F.explode("pairs").alias("pair"))
        dealt = join_dealt(linked, ranked, "pair", hot_keys(counts, "pair", links), ["sid"])
        scores = dealt.groupBy("sid").agg(F.count("*").alias("n_links"), F.coalesce(F.sum("best"), F.lit(0)).alias("n_best"), F.coalesce(F.sum("c"), F.lit(0)).alias("count_sum"))
        told = aligned.join(scores, "sid", "left").fillna(0, ["n_links", "n_best", "count_sum"]).mapInArrow(_letters, "chunk int, n int, body binary, raw long")
    schema = _DOCS_SQL if not digest else _DOCS_SQL.replace("groups string", "groups_sha256 string")
    letters = told.withColumnRenamed("chunk", "of_chunk")
    return documents.groupBy("chunk").cogroup(letters.groupBy("of_chunk")).applyInArrow(_digest if digest else _whole, schema)
