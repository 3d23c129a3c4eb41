"""Peak concurrency: how many sales of each nation are open at any moment, and what they are worth.

A set of intervals is a step function of time for each key: at each moment the change of the count
and of the value. Any partition of the intervals, whatever rows it holds, becomes one compact
function (changes of one key and moment are added, changes of nothing vanish), cut into pieces of
one key and ``SPAN`` units of time. A piece has at most ``SPAN`` points, however many intervals it
stands for, so no key and no moment is hot. Pieces of one key and span are added pairwise, like a
tree, ``FAN`` of them in a task, until one is left. What the pieces before carry into each piece is
a running sum over a row per piece, with which the pieces are written out as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import discard, materialize
from ._common import hot_keys, join_dealt, runs

#: Units of time in a piece, which therefore has no more points than that.
SPAN = 1 << 16
#: Functions of one key and span that meet in a task.
FAN = 16
#: Rows of a partition that go into one function.
ROWS = 1 << 20
#: Points in a batch of pieces that is handed on.
POINTS = 1 << 20
#: The key that stands for all keys together, and the one of intervals whose key is not known.
EVERY, NONE = -2, -1

_LISTS = pa.list_(pa.int64())
_PIECE = pa.schema([("key", pa.int32()), ("span", pa.int64()), ("slot", pa.int64()), ("t", _LISTS), ("n", _LISTS), ("v", _LISTS)])
_PIECE_SQL = "key int, span long, slot long, t array<long>, n array<long>, v array<long>"


def utc_seconds(frame: DataFrame, name: str) -> Column:
    """Whole seconds since 1970, rounded down. A time without a zone is UTC, whatever the session's zone."""
    c = F.col(name)
    if frame.schema[name].dataType.typeName() == "timestamp":
        return F.unix_seconds(c)
    day = F.unix_date(c.cast("date")).cast("long")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _added(by: tuple[np.ndarray, ...], n: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Points in order of the columns ``by`` (first first); those equal in all are added, those of no change left out."""
    if not len(n):
        return (*by, n, v)
    order = np.lexsort(by[::-1])
    by = tuple(x[order] for x in by)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
    first = np.flatnonzero(new)
    n, v = np.add.reduceat(n[order], first), np.add.reduceat(v[order], first)
    keep = (n != 0) | (v != 0)
    return (*(x[first][keep] for x in by), n[keep], v[keep])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _pieces(key: np.ndarray, span: np.ndarray, slot: np.ndarray, t: np.ndarray, n: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Points in order to pieces, a batch for some ``POINTS`` of them."""
    if not len(t):
        return
    first = _starts(key, span, slot)
    ends = np.append(first, len(t))
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + POINTS, "right")) - 1)
        lo, hi, head = ends[at], ends[to], first[at:to]
        offsets = pa.array((ends[at : to + 1] - lo).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[lo:hi])) for x in (t, n, v)]
        yield pa.RecordBatch.from_arrays([pa.array(key[head].astype(np.int32)), pa.array(span[head]), pa.array(slot[head]), *lists], schema=_PIECE)
        at = to


def _function(parts: list[pa.RecordBatch], slot: int) -> Iterator[pa.RecordBatch]:
    """Intervals (key, start, stop or null, value) to the pieces of one function, all keys together included."""
    table = pa.Table.from_batches(parts)
    key, start, value = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "start", "value"))
    ends = table.column("stop").is_valid().to_numpy()
    stop = table.column("stop").fill_null(0).to_numpy()[ends]
    one = np.ones(len(key), np.int64)
    t, n, v = np.concatenate([start, stop]), np.concatenate([one, -one[ends]]), np.concatenate([value, -value[ends]])
    keys = np.concatenate([key, key[ends]])
    t, n, v = np.concatenate([t, t]), np.concatenate([n, n]), np.concatenate([v, v])
    keys, t, n, v = _added((np.concatenate([keys, np.full(len(keys), EVERY, np.int64)]), t), n, v)
    yield from _pieces(keys, t // SPAN, np.full(len(t), slot, np.int64), t, n, v)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, number = [], 0, 0
    part = TaskContext.get().partitionId()
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= ROWS:
            yield from _function(held, part + (number << 32))
            held, rows, number = [], 0, number + 1
    if rows:
        yield from _function(held, part + (number << 32))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in table.column(name).chunks]).to_numpy(zero_copy_only=False).astype(np.int64)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of key, span and slot, added pairwise until each of these has one."""
    for table in runs(batches, 3):
        size = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in table.column("t").chunks]).astype(np.int64)
        key, span, slot = (table.column(c).to_numpy().astype(np.int64) for c in ("key", "span", "slot"))
        first = _starts(key, span, slot)
        run = np.zeros(len(key), np.int64)
        run[first] = 1
        run = np.cumsum(run) - 1
        place = np.arange(len(key)) - first[run]
        run, place = np.repeat(run, size), np.repeat(place, size)
        t, n, v = (_flat(table, c) for c in ("t", "n", "v"))
        while len(place) and place.max():
            run, place, t, n, v = _added((run, place // 2, t), n, v)
        head = first[run]
        yield from _pieces(key[head], span[head], slot[head], t, n, v)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with what is carried into them, to rows."""
    for b in batches:
        for r in b.to_pylist():
            t = np.array(r["t"], np.int64)
            n, v = r["open_before"] + np.cumsum(r["n"]), r["value_before"] + np.cumsum(r["v"])
            high = np.maximum.accumulate(n if r["high_before"] is None else np.maximum(n, r["high_before"]))
            to = pa.array([*r["t"][1:], r["next"]], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(t), r["key"], np.int32)), pa.array(t), to, pa.array(n), pa.array(v), pa.array(high), pa.array(v == r["peak"])],
                names=["key", "from_s", "to_s", "n_open", "open_value", "high_open", "is_peak"],
            )


def concurrency(intervals: DataFrame) -> DataFrame:
    """Intervals ``(key int, start long, stop long, value long)`` to a row for each key, and for all of
    them as key -2, and moment at which their number or their value changes: key, from_s, to_s (the
    next of the key's moments, null for the last), n_open, open_value, high_open (the largest n_open
    so far) and is_peak (open_value is the key's largest).

    A null stop is open for ever. Intervals with a null start, or a stop not after it, take no part;
    a null key is -1, a null value 0; repeated rows count each. An empty table gives an empty
    result. Other columns are not read. Key -2 is not to be used otherwise.
    """
    key, value = F.coalesce(F.col("key").cast("int"), F.lit(NONE)).alias("key"), F.coalesce(F.col("value"), F.lit(0)).cast("long").alias("value")
    rows = intervals.where("start is not null and (stop is null or stop > start)").select(key, F.col("start").cast("long"), F.col("stop").cast("long"), value)
    pieces = materialize(rows.mapInArrow(_build, _PIECE_SQL), "steps")
    slots = pieces.agg(F.count_distinct("slot")).first()[0]
    while True:
        slots = -(-slots // FAN)
        dealt = pieces.withColumn("slot", F.pmod(F.xxhash64("slot"), F.lit(max(1, slots))))
        by = ["key", "span", "slot"]
        before, pieces = pieces, materialize(dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge, _PIECE_SQL), "steps")
        discard(before)
        if slots <= 1:
            break

    # A row for each piece: what it adds up to, and its largest running sums.
    add = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.greatest(acc["top"], acc["sum"] + x).alias("top"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("long").alias("top"))
    short = pieces.select("key", "span", F.col("t")[0].alias("first"), F.aggregate("n", start, add).alias("n"), F.aggregate("v", start, add).alias("v"))
    of_key = Window.partitionBy("key").orderBy("span")
    earlier = of_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = short.withColumns({"open_before": F.coalesce(F.sum("n.sum").over(earlier), F.lit(0)), "value_before": F.coalesce(F.sum("v.sum").over(earlier), F.lit(0)), "next": F.lead("first").over(of_key)})
    carried = carried.withColumns({"high_before": F.max(F.col("open_before") + F.col("n.top")).over(earlier), "peak": F.max(F.col("value_before") + F.col("v.top")).over(Window.partitionBy("key"))})
    whole = pieces.drop("slot").join(carried.drop("n", "v", "first"), ["key", "span"])
    return whole.mapInArrow(_rows, "key int, from_s long, to_s long, n_open long, open_value long, high_open long, is_peak boolean")


def sale_intervals(sales: DataFrame, lines: DataFrame, clients: DataFrame, unit: int = 1, days: int = 1) -> DataFrame:
    """``(key, start, stop, value)`` of each sale: its client's nation (the smallest, where a client is
    told of more than once; -1 without one), sold_at and the earliest shipped_at of its lines plus
    ``days`` in UTC seconds, rounded down to multiples of ``unit``, and its total in cents, rounded
    half up; a total that is null or no finite number is 0. A sale without shipped lines, or without
    an id, has no stop. A hot sale's lines are combined before they are shuffled; the sales of hot
    clients are dealt into parts, each of which meets the client.
    """
    ends = lines.where("sale_id is not null and shipped_at is not null").groupBy("sale_id").agg(F.min("shipped_at").alias("shipped"))
    ends = ends.select("sale_id", (utc_seconds(ends, "shipped") + days * 86400).alias("stop"))
    nations = clients.where("client_id is not null").groupBy("client_id").agg(F.min("nation_id").cast("int").alias("key"))
    hot = hot_keys(sales.groupBy("client_id").count(), "client_id", sales.count())
    cents = F.floor(100 * F.col("total") + 0.5).cast("long")
    cents = F.when(F.isnan("total") | (F.abs("total") == float("inf")), 0).otherwise(cents)
    sold = sales.select("sale_id", "client_id", utc_seconds(sales, "sold_at").alias("start"), F.coalesce(cents, F.lit(0)).alias("value")).where("start is not null")
    joined = join_dealt(sold, ends, "sale_id", [], ["client_id", "start"])
    joined = join_dealt(joined, nations, "client_id", hot, ["sale_id", "start"])
    down = lambda c: (F.col(c) - F.pmod(F.col(c), F.lit(unit))).alias(c)
    return joined.select("key", down("start"), down("stop"), "value")


def open_sales(sales: DataFrame, lines: DataFrame, clients: DataFrame, unit: int = 1, days: int = 1) -> DataFrame:
    """``concurrency`` of ``sale_intervals``, with the columns named for sales: nation_id, from_s, to_s,
    n_open, open_cents, high_open, is_peak."""
    return concurrency(sale_intervals(sales, lines, clients, unit, days)).withColumnsRenamed({"key": "nation_id", "open_value": "open_cents"})
