"""The corpus pipeline: filter, dedup, decontaminate, mix and shard ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meldspark.operators.scratch import discard, discard_paths, materialize, recorded
from meldspark.llm.decontaminate import decontaminate
from meldspark.llm.mixing import mix
from meldspark.llm.quality import quality_filter
from meldspark.llm.sharding import shards
from meldspark.llm.simhash import simhash_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Scratch tables of the stage that was called last, outside of ``run``.
_left: list[str] = []


def _stage(function: Stage) -> Stage:
    """A stage that is called by itself: its result is written before the next is called, which
    therefore begins by deleting the tables that the one before left behind. ``run`` calls the
    functions as they are and keeps its own account, so that runs do not meet."""

    @wraps(function)
    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_paths(_left)
        with recorded() as made:
            out = function(spark, docs, sf_dir)
        _left[:] = made
        return out

    return called


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Each row is judged by its text alone, so repeated
    rows share their fate; null and wordless texts are judged by the bias; a chance of exactly the
    threshold stays. No documents: none stay. ``labels`` may be empty or name other documents."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word runs, similarity of 0.8 or more) stays: that
    of the smallest doc_id, null last; of rows of one id the first written. Null and wordless texts
    are one group. No documents: none stay."""
    return simhash_dedup(docs)


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text a benchmark window occurs go; null texts have none and stay. Repeated rows
    share their fate. An empty benchmark keeps all rows."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to two times. A null source is one of its own;
    wordless texts are in the certain copies only; of equal rows as many are taken as fit."""
    return mix(docs)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their size, shard and slot, by columns of these names, or where a column
    of the documents has the name, with an underscore more. Rows are placed one by one, null ids
    first; repeated rows are neighbours. Without documents there are no shards."""
    had, names = {c.lower() for c in docs.columns}, []
    for name in ("size", "shard", "slot"):
        while name in had:
            name += "_"
        names.append(name)
    placed = shards(docs, carry=True)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], *[F.col(n.rstrip("_")).alias(n) for n in names])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Fingerprints and a fitted classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on ``documents``. The tables that the result still reads stand
    until the process ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before = docs
        with recorded() as made:
            docs = stage.__wrapped__(spark, docs, sf_dir)
        docs = materialize(docs, name)
        discard_paths(made)
        if i:
            discard(before)
    return STAGES[-1][1].__wrapped__(spark, docs, sf_dir)
