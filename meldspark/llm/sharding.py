"""Contiguous balanced shards from global byte-size prefix sums (DataFrame operations only).

Rows are ordered by id. Their sizes, without their texts, are dealt into ranges of similar row
counts; per-range totals of bytes and rows are summed up to offsets, and a running sum inside each
range completes the global prefix of a row. A row belongs to the shard in which the middle of its
bytes falls when the whole is cut at equal byte targets. The ranges only spread the work, and split
anywhere, also among rows of one id: the global order, and so the result, does not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import discard, materialize

#: Rows of a range, without their texts.
RANGE_ROWS = 500_000


def shards(docs: DataFrame, count: int = 16, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 1. shard: 0 to ``count`` - 1, contiguous in
    doc_id order (null ids first; equal ids by size, then checksum; rows equal in all three are
    interchangeable). slot: place within the shard, from 0. A null text has the checksum of the
    empty one. Equal texts stand where their ids put them: the law is equal bytes, and a group of
    copies may be larger than a shard. An empty table gives an empty result. With ``carry`` the row
    of ``docs`` comes along as column ``row``, joined to its place in one shuffle of the texts;
    other columns are not read otherwise.
    """
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))
    read = [F.col(id_col).cast("long").alias("doc_id"), (F.length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32")]
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = materialize(docs.select(*read, *row, F.monotonically_increasing_id().alias("number")), "shard-rows")
    order = ["doc_id", "size", "text_crc32", "number"]
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // RANGE_ROWS)
    slim = materialize(rows.select(*order).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "shard-ranges")

    # A row for each range: offsets, and the total.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slim.groupBy("part").agg(F.sum("size").alias("bytes")).select(
        "part", F.coalesce(F.sum("bytes").over(upto), F.lit(0)).alias("bytes_before"), F.sum("bytes").over(Window.partitionBy()).alias("bytes_all")
    )
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = slim.withColumns({"sum": F.sum("size").over(within), "place": F.row_number().over(within)}).join(offsets, "part")
    doubled = (2 * (F.col("bytes_before") + F.col("sum")) - F.col("size")) * count  # twice the middle, times count
    placed = placed.withColumn("shard", F.least(F.floor(doubled / (2 * F.col("bytes_all"))), F.lit(count - 1)).cast("int"))
    placed = materialize(placed.drop("sum", "bytes_before", "bytes_all"), "shard-places")
    discard(slim)

    # At most ranges + count rows: where each range's share of a shard begins in the range, and in the shard.
    cells = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("shard", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slots_before"))
    out = placed.join(cells, ["shard", "part"])
    slot = (F.col("slots_before") + F.col("place") - F.col("first")).cast("long").alias("slot")
    out = out.select(*order, F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
    return out.join(rows.select("number", "row"), "number").drop("number") if carry else out.drop("number")
