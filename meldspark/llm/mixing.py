"""Mixing sources to target weights by Pareto order sampling.

Every document of a source is to be taken target / size times on average. The whole part is
allocated as certain copies. For the fraction f, documents are ranked by the Pareto variable
q = (u / (1 - u)) / (p / (1 - p)): random odds over inclusion odds, u a hash of the id, and
p / (1 - p) = f / (1 - f) times the document's own odds. Those of lowest q are taken up to the last
that the source's remaining words hold, so the sample is of fixed size in words; the one document
that then fits the remainder best closes it.

The cut is found without sorting a source in one task: a rank is a number of six digits, and from
the first digit on, words are summed by digit (at most 1024 sums a source) among the rows that share
the digits before. Only rows equal in all digits are ordered one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scratch import materialize

#: Ranks are cut digit by digit, of this many bits; three digits rank by q, two by a hash of the
#: row's id, size and text, one by the row's number.
DIGIT, DIGITS = 10, 6


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text; null: 0."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    gaps = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" ")))
    full = F.length(F.trim(squeezed)) > 0
    edges = F.startswith(squeezed, F.lit(" ")).cast("int") + F.endswith(squeezed, F.lit(" ")).cast("int")
    return F.when(full, gaps - edges + 1).otherwise(0).cast("long")


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``(source, total)`` with targets: level * weight, at most ``most`` * total, summing to
    ``share`` of all. One row per source, so the windows here are over a small table."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(k)) + 1).cast("int"))
    s = sources.withColumn("weight", pick).withColumn("cap", F.lit(float(most)) * F.col("total"))
    # In the order in which rising levels meet the caps: those before a row are capped.
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("all", F.sum("total").over(everything))
    s = s.withColumn("level", (F.lit(float(share)) * F.col("all") - F.col("capped")) / F.col("open"))
    # The level is that of the first row whose cap it does not pass.
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"])
    return s.select("source", "total", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """A hash of key and seed in the open interval (0, 1), the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def by_length(size: Column) -> Column:
    """Odds that grow with the root of the length: of two documents of a source, the one of four
    times the words has twice the odds."""
    return F.sqrt(F.greatest(size, F.lit(1)).cast("double"))


def _small(df: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table with a row per source: written, counted, and broadcast if it has at most ``limit`` rows."""
    df = materialize(df, "mix")
    return F.broadcast(df) if df.count() <= limit else df


def _spread(x: Column, bits: int) -> Column:
    return F.shiftrightunsigned(x, 64 - bits)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 42, odds: Column | None = None, carry: bool = False) -> DataFrame:
    """A row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Sources are ordered by code point, nulls last as a source of their own, and given ``weights``
    in turn. ``odds`` (positive) multiplies a row's inclusion odds within its source, by default
    ``by_length``; the words taken do not depend on it. Empty texts have size 0 and only take words
    they do not have. Ranks equal in 30 bits fall by a hash of id, size and text; rows equal in all
    of these are alike, and as many of them are taken as fit. Whole documents are taken, so a source
    may miss its target by the size of a document where one makes up much of the source. An empty
    table gives an empty result. With ``carry`` the row of ``docs`` comes along as column ``row``.
    Texts are read once, and what the plan needs of them is written with the rows.
    """
    size = word_count(F.col(text_col))
    read = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
        F.xxhash64(F.col(text_col)).alias("hash"),
    ]
    if odds is not None:
        read.append(odds.cast("double").alias("tilt"))
    rows = docs.select(*read, *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []))
    if odds is None:
        rows = rows.withColumn("tilt", by_length(F.col("size")))
    rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "mix-rows")

    totals = rows.groupBy("source").agg(F.sum("size").alias("total"), F.avg("tilt").alias("mean"))
    plan = _targets(totals, weights, share, most).join(totals.select(F.col("source").alias("o"), "mean"), F.col("source").eqNullSafe(F.col("o"))).drop("o").withColumnRenamed("source", "s")
    plan = plan.withColumn("ratio", F.when(F.col("total") > 0, F.col("target") / F.col("total")).otherwise(0.0))
    plan = plan.withColumn("whole", F.floor("ratio")).withColumn("p", F.col("ratio") - F.col("whole"))
    # Words that remain to be sampled after the certain copies.
    plan = _small(plan.withColumn("gap", F.col("target") - F.col("whole") * F.col("total")))

    def ranked(df: DataFrame) -> DataFrame:
        df = df.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("u", uniform(F.col("doc_id"), seed))
        q = F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p")) * F.col("tilt") / F.col("mean"))
        most_ = float(1 << 3 * DIGIT)
        rank = F.when(F.col("p") > 0, F.least(F.floor(q / (1 + q) * most_), F.lit(most_ - 1)).cast("long"))
        tie = _spread(F.xxhash64("doc_id", "size", "hash"), 2 * DIGIT)
        number = _spread(F.xxhash64("number"), DIGIT)
        code = F.shiftleft(rank, 3 * DIGIT) + F.shiftleft(tie, DIGIT) + number
        return df.withColumn("code", code).drop("u")

    drawn = materialize(ranked(rows).where("code is not null and size > 0").select("source", "size", "code", "number"), "mix-drawn")
    state = plan.select(F.col("s"), "gap", F.lit(0).cast("long").alias("cut"))
    same = F.col("source").eqNullSafe(F.col("s"))
    for d in range(1, DIGITS + 1):
        # Rows that share the digits found so far, and their next digit.
        left = (DIGITS - d) * DIGIT
        next_ = F.shiftright(F.col("code"), left)
        open_ = drawn.join(state, same).where(F.shiftright(next_, DIGIT) == F.col("cut"))
        sums = open_.groupBy("s", next_.alias("next")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("next").rowsBetween(Window.unboundedPreceding, 0))).withColumnRenamed("s", "t")
        # The first digit whose words pass the gap; where all fit, the one after the last.
        found = state.join(sums, F.col("s").eqNullSafe(F.col("t")), "left").groupBy("s").agg(
            F.first("gap").alias("gap"),
            F.coalesce(F.min(F.when(F.col("upto") > F.col("gap"), F.col("next"))), F.max("next") + 1, F.shiftleft(F.first("cut"), DIGIT)).alias("cut"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))), F.lit(0)).alias("before"),
        )
        state = _small(found.select("s", (F.col("gap") - F.col("before")).alias("gap"), "cut"))
    # Rows equal in all digits: one by one.
    at_cut = drawn.join(state, same).where(F.col("code") == F.col("cut"))
    at_cut = at_cut.withColumn("upto", F.sum("size").over(Window.partitionBy("s").orderBy("size", "number").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= F.col("gap"))
    edge = at_cut.groupBy("s").agg(F.max("upto").alias("got"), F.max(F.struct("size", "number")).alias("last")).withColumnRenamed("s", "e")
    state = state.join(edge, F.col("s").eqNullSafe(F.col("e")), "left").drop("e")
    state = _small(state.withColumn("gap", F.col("gap") - F.coalesce("got", F.lit(0))).drop("got"))
    taken = (F.col("code") < F.col("cut")) | ((F.col("code") == F.col("cut")) & F.coalesce(F.struct("size", "number") <= F.col("last"), F.lit(False)))
    # One more row, of those not taken: the one that brings the words nearest to the target.
    miss = F.abs(F.col("gap") - F.col("size"))
    fit = drawn.join(state, same).where(~taken & (miss < F.col("gap"))).groupBy("s").agg(F.min_by("number", F.struct(miss, F.col("code"), F.col("number"))).alias("fit"))
    cut = state.join(fit.withColumnRenamed("s", "f"), F.col("s").eqNullSafe(F.col("f")), "left").drop("f")
    cut = _small(cut.select(F.col("s").alias("c"), F.col("gap").alias("rest"), "cut", "last", "fit"))

    out = ranked(rows).join(cut, F.col("source").eqNullSafe(F.col("c")), "left")
    chosen = F.col("code").isNotNull() & (F.col("size") > 0) & (taken | (F.col("number") == F.col("fit")))
    out = out.withColumn("copies", F.col("whole") + F.coalesce(chosen, F.lit(False)).cast("long"))
    return out.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if carry else []))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as the plan takes it, columns as they were."""
    plan = mix_plan(docs, carry=True, **settings).where("copies > 0")
    each = plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
