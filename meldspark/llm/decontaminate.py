"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of every benchmark text: each run of ``window`` words, or the whole
text where it is shorter. Windows of one length form one search table: a shift table over blocks
of two words tells how far the search may jump from a block that cannot end a window, and where
it cannot jump, the block (the window's suffix) selects a bucket of windows that are compared
word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scratch import materialize

#: Benchmark text held in one search table, which takes up to some 25 times as much memory; more
#: text is searched for in further tables, one after the other.
TABLE_BYTES = 8 << 20
NO_ID = -(1 << 63)

# A-Z become a-z; 0-9, a-z and all bytes beyond ASCII stay; all else separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class _Table:
    """Search table of the different windows of ``m`` words, in arrays of numbers: windows in order of
    their suffix block, the items of each, and shifts by block."""

    def __init__(self, m: int, base: int, windows: np.ndarray, items: np.ndarray) -> None:
        self.m, self.base = m, base
        windows, which = np.unique(windows, axis=0, return_inverse=True)
        order = np.argsort(self.block(windows, m - 1), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.windows = windows[order]
        self.suffix = self.block(self.windows, m - 1)
        owned = np.unique(np.stack([place[which.ravel()], items]), axis=1)
        self.items, self.first = owned[1], np.searchsorted(owned[0], np.arange(len(windows) + 1))
        # Shifts of the blocks that end a window early; those of the suffix come first and are 0.
        self.blocks, self.shifts = np.unique(self.suffix), np.zeros(0, np.uint8)
        self.shifts = np.zeros(len(self.blocks), np.uint8)
        for end in range(m - 2, min(2, m) - 2, -1):
            new = np.setdiff1d(self.block(self.windows, end), self.blocks)
            self.blocks = np.concatenate([self.blocks, new])
            self.shifts = np.concatenate([self.shifts, np.full(len(new), m - 1 - end, np.uint8)])
            order = np.argsort(self.blocks, kind="stable")
            self.blocks, self.shifts = self.blocks[order], self.shifts[order]

    def block(self, words: np.ndarray, end: int) -> np.ndarray:
        """The block of two words (of one, where m is 1) that ends at a place of each row."""
        last = words[:, end].astype(np.int64)
        return last if self.m == 1 else words[:, end - 1] * np.int64(self.base) + last

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        m, n = self.m, len(ids)
        if n < m:
            return
        if m == 1:
            block = ids
        else:
            block = np.concatenate([[0], ids[:-1] * np.int64(self.base) + ids[1:]])
        at = np.searchsorted(self.blocks, block)
        at[at == len(self.blocks)] = 0
        shift = np.where(self.blocks[at] == block, self.shifts[at], max(1, m - 1)).tolist()
        i = m - 1
        while i < n:
            if step := shift[i]:
                i += step
                continue
            lo, hi = np.searchsorted(self.suffix, [block[i], block[i] + 1])
            same = np.flatnonzero((self.windows[lo:hi] == ids[i - m + 1 : i + 1]).all(axis=1))
            if len(same):
                w = int(lo + same[0])
                yield i - m + 1, i + 1, self.items[self.first[w] : self.first[w + 1]].tolist()
            i += 1


class Searcher:
    """Finds all windows of ``items`` (id, text) in word sequences. Null ids have the number NO_ID."""

    def __init__(self, items: Iterable[tuple[int, bytes | None]], window: int = 10) -> None:
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if not len(ids):
                continue
            m = min(window, len(ids))
            windows.setdefault(m, []).append(np.lib.stride_tricks.sliding_window_view(ids, m))
            owners.setdefault(m, []).append(np.full(len(ids) - m + 1, NO_ID if item is None else item, np.int64))
        base = len(self.vocabulary) + 1
        self.tables = [_Table(m, base, np.concatenate(windows[m]), np.concatenate(owners[m])) for m in sorted(windows)]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, items) of every occurrence."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))
        for table in self.tables:
            yield from table.find(ids)


def _covered(spans: list[list[int]]) -> int:
    total = end = 0
    for lo, hi in sorted(spans):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def _scan(table, at: int, names: list[str]):
    """Columns ``at``: text, found item ids, found word spans; the others pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = table.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                found, spans, lengths = [], [], []
                for text, had, were in zip(part.column(at), part.column(at + 1), part.column(at + 2), strict=True):
                    words = words_of(text.as_py())
                    items, hits = set(had.as_py() or ()), were.as_py() or []
                    for lo_, hi_, which in search.find(words):
                        items.update(which)
                        hits.append([lo_, hi_])
                    found.append(sorted(items - {NO_ID}, key=str))
                    spans.append(hits)
                    lengths.append(len(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(lengths, pa.int64())], names=names
                )

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = b.column(2).to_pylist()
        hit = [_covered(s) for s in b.column(3).to_pylist()]
        sha = [hashlib.sha256(",".join(map(str, f)).encode()).hexdigest() for f in found]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(4), pa.array(hit, pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(sha), pa.array([h > 0 for h in hit]), b.column(2)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"],
        )


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence), n_items,
    items_sha256 (of the sorted, comma-joined ids), contaminated, item_ids.

    Null texts have no words. Benchmark rows without words are left out; the windows of rows without
    an id count as hits, but name no item; repeated rows count once. Empty tables give an empty
    result, or one without hits. Other columns are not read. Documents are not shuffled. A benchmark
    beyond ``TABLE_BYTES`` is cut into several tables; between two of them the rows are written with
    what was found, so that one table is held at a time.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.withColumns({"items": F.lit(None).cast("array<long>"), "spans": F.lit(None).cast("array<array<long>>")})
    schema = "doc_id long, text binary, items array<long>, spans array<array<long>>, n_words long"
    scan = lambda df, table: df.select("doc_id", "text", "items", "spans").mapInArrow(_scan(table, 1, ["doc_id", "text", "items", "spans", "n_words"]), schema)
    rows = _each_table(rows, scan, benchmark, item_col, item_text_col, window)
    return rows.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<long>")


def _each_table(rows: DataFrame, apply, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> DataFrame:
    """``apply(rows, table)`` for a broadcast searcher over each ``TABLE_BYTES`` of benchmark text."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // TABLE_BYTES
    if blocks > 1:
        items = materialize(items, "benchmark")
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about TABLE_BYTES
        table = rows.sparkSession.sparkContext.broadcast(Searcher(((r.item_id, bytes(r.text) if r.text is not None else None) for r in part), window))
        rows = apply(rows, table)
        if k + 1 < blocks:
            rows = materialize(rows, "searched")
            table.destroy()
    return rows


def _keep_clean(table, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = table.value
        for b in batches:
            texts = b.column(at).cast(pa.binary())
            yield b.filter(pa.array([next(search.find(words_of(t.as_py())), None) is None for t in texts], pa.bool_()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs; columns as they were.

    Each row is judged by its own text, in place: documents are not shuffled. Null texts stay.
    Other cases as for ``benchmark_hits``.
    """
    keep = lambda df, table: df.mapInArrow(_keep_clean(table, df.columns.index(text_col)), df.schema)
    return _each_table(docs, keep, benchmark, item_col, item_text_col, window)
