"""Exact nearest neighbours by block matrix join.

Candidate rows are taken in tiles. Queries and tile are quantised to int8 with one scale per
vector; the product of the two int8 tiles (exact in float32, as sums stay below 2^24) gives every
distance of the quantised vectors, and the triangle inequality with the two quantisation errors
bounds the true one from both sides. Only pairs whose lower bound does not pass the query's
k-th smallest upper bound are recomputed in double precision, and a heap per query merges tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import materialize

#: Bytes of query vectors broadcast at once; more queries go in further passes over the table.
QUERY_BYTES = 16 << 20
TILE = 4096
QUERIES_AT_ONCE = 1024
_SLACK = 1e-6  # relative, far above the rounding of the bounds


def _quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes (as float32, for the product), scales, and errors |x - scale * code|."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None])
    return codes.astype(np.int8).astype(np.float32), scale, np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1))


def exact_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise Euclidean distance, summed in order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += (a[:, i] - b[:, i]) ** 2
    return np.sqrt(total)


def _clean(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and matrices of the usable vectors, one for each dimension that occurs."""
    lengths = np.nan_to_num(np.asarray(vectors.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
    known = ~np.asarray(ids.is_null())
    for dim in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero((lengths == dim) & known)
        if not len(rows):
            continue
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
        x = np.asarray(flat, float).reshape(len(rows), dim)
        good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        yield ids.take(pa.array(rows[good])).to_numpy().astype(np.int64), x[good]


class _Queries:
    """Distinct query vectors of one dimension, quantised, with the ids that have them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.x, inverse = np.unique(x, axis=0, return_inverse=True)
        self.owners: list[list[int]] = [[] for _ in self.x]
        for i, q in zip(ids.tolist(), inverse.ravel().tolist(), strict=True):
            self.owners[q].append(i)
        self.codes, self.scale, self.error = _quantise(self.x)
        self.norm = (self.scale * np.sqrt((self.codes.astype(float) ** 2).sum(axis=1))) ** 2


def _put(heap: list[tuple[float, int]], k: int, entry: tuple[float, int]) -> None:
    """Of one id only the ``k`` nearest rows can count, so 2 k entries hold k of other ids than any one."""
    if len(heap) == 2 * k and entry <= heap[0]:
        return
    same = [e for e in heap if e[1] == entry[1]]
    if len(same) == k:
        if entry > min(same):
            heap[heap.index(min(same))] = entry
            heapq.heapify(heap)
    elif len(heap) < 2 * k:
        heapq.heappush(heap, entry)
    else:
        heapq.heapreplace(heap, entry)


def _tile(q: _Queries, ids: np.ndarray, x: np.ndarray, k: int, heaps: list[list[tuple[float, int]]]) -> None:
    """Merge one tile into the heaps of (-distance, -id)."""
    # A query's own rows do not count, and no id has more rows here than ``most``.
    most = int(np.unique(ids, return_counts=True)[1].max())
    keep = k + most
    # Equal vectors: only the smallest ids can be among the nearest.
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    _, inverse = np.unique(x, axis=0, return_inverse=True)
    inverse = inverse.ravel()
    by = np.argsort(inverse, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(inverse[by]) != 0])
    rank = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    by = np.sort(by[rank < keep])
    x, ids = x[by], ids[by]
    codes, scale, error = _quantise(x)
    norm = (scale * np.sqrt((codes.astype(float) ** 2).sum(axis=1))) ** 2
    for lo in range(0, len(q.x), QUERIES_AT_ONCE):
        s = slice(lo, lo + QUERIES_AT_ONCE)
        product = (q.codes[s] @ codes.T).astype(float) * q.scale[s, None] * scale
        mid = np.sqrt(np.maximum(q.norm[s, None] + norm - 2 * product, 0))
        # Rounding under the root grows where the difference is small beside the norms.
        slack = _SLACK * (np.sqrt(q.norm[s])[:, None] + np.sqrt(norm) + q.error[s, None] + error)
        err = q.error[s, None] + error + slack
        upper = mid + err
        bound = np.partition(upper, keep - 1, axis=1)[:, keep - 1] if upper.shape[1] > keep else np.full(len(upper), np.inf)
        held = np.array([-h[0][0] if len(h) == 2 * k else np.inf for h in heaps[s]])
        row, col = np.nonzero(mid - err <= np.minimum(bound, held)[:, None])
        if not len(row):
            continue
        distance = exact_distance(q.x[lo + row], x[col])
        for r, d, i in zip((lo + row).tolist(), distance.tolist(), ids[col].tolist(), strict=True):
            _put(heaps[r], k, (-d, -i))


def _search(queries, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, _Queries] = queries.value
        heaps = {dim: [[] for _ in q.x] for dim, q in sets.items()}
        for b in batches:
            for lo in range(0, b.num_rows, TILE):
                part = b.slice(lo, TILE)
                for ids, x in _clean(part.column(0), part.column(1)):
                    if len(ids) and x.shape[1] in sets:
                        _tile(sets[x.shape[1]], ids, x, k, heaps[x.shape[1]])
        for dim, q in sets.items():
            out: list[tuple[int, int, float]] = []
            for owners, heap in zip(q.owners, heaps[dim], strict=True):
                near = sorted((-d, -i) for d, i in heap)
                for owner in owners:
                    out += [(owner, i, d) for d, i in [x for x in near if x[1] != owner][:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's ``k`` nearest other rows, nearest
    first, ties to the smaller id; all of them, if there are fewer.

    score: Euclidean distance in double precision, on the stored vectors. Null vectors, zero
    vectors, and those that hold a null or a non-finite component take no part, nor do rows
    without an id; vectors are compared with those of their own length. Rows that share an id are
    one query when their vectors are equal; none is its own candidate. An empty table gives an
    empty result. Other columns are not read.

    Queries are taken in blocks of about ``QUERY_BYTES``: a block is broadcast, passes over the
    table, writes at most k rows a query and partition, and is released before the next.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    asked = table.where(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).distinct()
    size = asked.agg(F.sum(F.size("v") * F.lit(8))).first()[0] or 0
    blocks = 1 + max(0, size) // QUERY_BYTES
    if blocks > 1:
        asked = materialize(asked, "queries")
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)) == b).toArrow().combine_chunks()  # about QUERY_BYTES
        sets = {}
        for c in block.to_batches():
            for ids, x in _clean(c.column(0), c.column(1)):
                if len(ids):
                    had = sets.get(x.shape[1])
                    sets[x.shape[1]] = (ids, x) if had is None else (np.r_[had[0], ids], np.r_[had[1], x])
        sent = spark.sparkContext.broadcast({dim: _Queries(*q) for dim, q in sets.items()})
        part = rows.mapInArrow(_search(sent, k), "query_id long, vec_id long, score double")
        if blocks > 1:
            part = materialize(part, "nearest")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
