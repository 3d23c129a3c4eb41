"""Shared helpers: lower-casing, Arrow batch plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


#: A key with more than one in so many rows is hot; so there are fewer hot keys than that.
SHARE = 1000
#: Parts into which the rows of a hot key are dealt.
SALTS = 64


def hot_keys(counts: DataFrame, key: str, total: int) -> list:
    """The keys of ``(key, count)`` with more than one in ``SHARE`` of ``total`` rows."""
    return [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("count") * SHARE > total)).select(key).collect()]


def join_dealt(rows: DataFrame, keyed: DataFrame, key: str, hot: list, by: list[str], how: str = "left") -> DataFrame:
    """``rows`` joined to ``keyed``, which has a row for each key. The rows of hot keys, and those without
    a key, are dealt by the columns ``by`` into parts, each of which meets the key."""
    is_hot = F.col(key).isin(hot)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = F.when(is_hot | F.col(key).isNull(), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    return rows.withColumn("__part", dealt).join(keyed.withColumn("__part", F.explode(parts)), [key, "__part"], how).drop("__part")


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Regroup sorted batches into tables that never split a run of equal leading ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i) for i in range(keys)]
        first = tuple(c[0].as_py() for c in cols)
        end = tuple(c[-1].as_py() for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        if first == end:
            held.append(b)
            last = end
            continue
        lo, hi = 0, b.num_rows - 1  # first row of the last run, by bisection
        while lo < hi:
            mid = (lo + hi) // 2
            if tuple(c[mid].as_py() for c in cols) == end:
                hi = mid
            else:
                lo = mid + 1
        yield pa.Table.from_batches([*held, b.slice(0, lo)])
        held, last = [b.slice(lo)], end
    if held:
        yield pa.Table.from_batches(held)
