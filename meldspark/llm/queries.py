"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import new_folder
from .alignment import alignments
from .concurrency import open_sales
from .decontaminate import benchmark_hits
from .linededup import dedup_lines
from .lmscore import cross_entropy_difference
from .mixing import mix_plan
from .neighbours import nearest
from .oracles import ORACLES
from .passages import repeated_passages
from .quality import THRESHOLD, quality_scores
from .sharding import shards
from .simhash import simhash_components
from .tokenfiles import token_digests
from .urlfilter import CONTRACT, url_verdicts


def _tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("item_ids")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), rules=CONTRACT)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    scores = quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.where(F.col("score") >= THRESHOLD).withColumn("keep", F.lit(True))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "pages"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: the documents annotated as good and not toxic. Background: all documents."""
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return cross_entropy_difference(_table(spark, sf_dir, "documents"), target_ids=good)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"), digest=True)


def op12_peak_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_sales(*(_table(spark, sf_dir, t) for t in ("sales", "sale_lines", "clients")))


def op13_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"), new_folder(spark, "tokens"), _tokenizer("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_repeated_passages, op2_decontaminate, op3_mix, op4_shard, op5_simhash, op6_url_filter, op7_quality, op8_nearest, op9_line_dedup, op10_lm_score, op11_alignment, op12_peak_concurrency, op13_token_output)}
