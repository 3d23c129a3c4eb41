"""Profiles and errors of several configs, written from the executors in the order of their candidates.

All configs are projected in one pass. The rows are dealt into ranges of config and order, so that
part after part and line after line of a config's folder stand in order, at any size; nothing goes
through the driver. Errors are counted while the rows are written, which gives the exit code, and are
told apart by what they say, in order of their first place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .operators.scratch import discard, materialize
from .plans.projection import project_many

#: Profiles of a file at most.
FILE_ROWS = 1_000_000


@dataclass
class Written:
    """What a sink wrote: ``errors`` (source, stage, error), each once, with ``place``, by which they are
    ordered; and the exit code, 1 where there are any."""

    errors: DataFrame
    exit_code: int


def distinct_errors(errors: DataFrame, *place: str) -> DataFrame:
    """Errors that say the same of the same source once: (source, stage, error, place), place being the
    least struct of the columns ``place``."""
    return errors.groupBy("source", "stage", "error").agg(F.min(F.struct(*place)).alias("place"))


def projected(people: DataFrame, configs: dict[str, dict], key: str = "candidate_id", vocabulary: dict[str, list[str]] | None = None) -> tuple[DataFrame, int]:
    """The profiles of all configs in one evaluation of ``people``, as a written table: config, number,
    key, profile, errors, position (the row's place among its config's, from 0); and the number of errors.

    Rows are in order of ``__order``, where people have it, then of the key; null keys come first."""
    rows = project_many(people, configs, key, vocabulary)
    order = ["number", *(c for c in ("__order",) if c in rows.columns), key]
    seen = Observation()
    rows = materialize(rows.observe(seen, F.coalesce(F.sum(F.size("errors")), F.lit(0)).alias("errors")), "profiles")
    ranged = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    # Rows of each range and config, and what stands before them: as many rows as ranges, not as profiles.
    counts = ranged.groupBy("number", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("number", "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__part", "number").orderBy(*order[1:])
    placed = ranged.withColumn("__at", F.row_number().over(within)).join(counts, ["number", "__part"])
    placed = placed.withColumn("position", F.col("__before") + F.col("__at") - 1)
    placed = materialize(placed.select("config", "number", key, "profile", "errors", "position"), "placed")
    discard(rows, ranged)
    return placed, seen.get["errors"]


def said(rows: DataFrame, key: str = "candidate_id", build: DataFrame | None = None) -> DataFrame:
    """The errors of ``projected`` rows after those of the build, each once (see ``distinct_errors``)."""
    each = rows.select("number", "position", F.col(key).cast("string").alias("source"), F.posexplode("errors").alias("at", "e"))
    each = each.select("number", "position", "at", "source", "e.stage", "e.error")
    if build is not None:
        first = build.select(F.lit(-1).alias("number"), F.lit(0).cast("long").alias("position"), F.lit(0).alias("at"), "source", "stage", "error")
        each = each.unionByName(first)
    return distinct_errors(each, "number", "position", "at")


def write_profiles(people: DataFrame, configs: dict[str, dict], folder: str, key: str = "candidate_id", errors: DataFrame | None = None, vocabulary: dict[str, list[str]] | None = None) -> Written:
    """Write a folder ``config=<name>`` for each config, whose text files hold a profile a line, in order
    from file to file. ``errors`` (source, stage, error) of the build come first among the errors."""
    rows, n = projected(people, configs, key, vocabulary)
    # Spark sorts what it writes by config, and drops a sort before that one, unless rows come sorted by it
    # (a column that cannot be null, as others are rewritten first).
    lines = rows.withColumn("config", F.coalesce("config", F.lit(""))).repartitionByRange("number", "position").sortWithinPartitions("config", "position")
    lines.select("config", "profile").write.partitionBy("config").option("maxRecordsPerFile", FILE_ROWS).text(folder)
    return Written(said(rows, key, errors), int(n > 0 or (errors is not None and not errors.isEmpty())))
