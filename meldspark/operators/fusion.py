"""Fusing the claims of a candidate's records: winners, lists, agreement, confidence, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sources in order of priority with their reliability, and the confidence weights.
SOURCES = {"recruiter_csv": 0.95, "ats_json": 0.90, "resume": 0.85, "linkedin": 0.80, "github": 0.70, "recruiter_notes": 0.60}
WEIGHTS = (0.5, 0.3, 0.2)
#: Fixed order in which field confidences are summed.
FIELDS = ("full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education")


def _lookup(c: Column, values: dict, otherwise) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def reliability(source_type: Column) -> Column:
    return _lookup(source_type, SOURCES, 0.0)


def priority(source_type: Column) -> Column:
    return _lookup(source_type, {s: i for i, s in enumerate(SOURCES)}, len(SOURCES))


def field_confidence(r: Column, agreement: Column, quality: Column) -> Column:
    a, b, c = WEIGHTS
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), a * r + b * agreement + c * quality))


def null_confidence() -> Column:
    """That of a field which no source supplied."""
    return F.lit(0.0)


def list_contributions(records: DataFrame, field: str, confidence: Column | None = None) -> DataFrame:
    """A row for each item that is not null of a list field of records (``links.other``: of that list):
    record_id, source_type, source_id, at, value, method, confidence. ``confidence`` may use any of
    these and of the record's columns; without it all are 0."""
    items = records.select("*", F.posexplode(F.col(field)).alias("at", "value")).where("value is not null")
    items = items.withColumn("method", F.try_element_at("methods", F.lit(field.split(".")[0])))
    given = null_confidence() if confidence is None else confidence
    return items.select("record_id", "source_type", "source_id", "at", "value", "method", given.cast("double").alias("confidence"))


def scored(claims: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Claims ``(key, field, value, quality, source_type, source_id, record_id, method)`` with
    agreement and confidence. Agreement: distinct sources of the value over the records that hold
    the field. Two combinable aggregates joined back; a hot value is no hot task."""
    claims = claims.where("value is not null")
    supply = claims.groupBy(key, "field", "value").agg(F.countDistinct("source_id").alias("supplying"))
    hold = claims.groupBy(key, "field").agg(F.countDistinct("record_id").alias("containing"))
    out = claims.join(supply, [key, "field", "value"]).join(hold, [key, "field"])
    out = out.withColumn("agreement", F.col("supplying") / F.col("containing"))
    return out.withColumn("confidence", field_confidence(reliability(F.col("source_type")), F.col("agreement"), F.col("quality")))


def winner_rank() -> Column:
    """Smallest priority, then highest confidence, then highest quality, then smallest value."""
    return F.struct(priority(F.col("source_type")), -F.col("confidence"), -F.col("quality"), F.col("value"), F.col("source_id"), F.col("method"))


def winners(scored_claims: DataFrame) -> DataFrame:
    """One claim per candidate and field, by ``winner_rank``."""
    best = scored_claims.groupBy("candidate_id", "field").agg(F.min_by(F.struct("value", "confidence", "source_id", "method"), winner_rank()).alias("w"))
    return best.select("candidate_id", "field", "w.*")


def combined(scored_claims: DataFrame) -> DataFrame:
    """Distinct sorted values per candidate and field, with the highest confidence."""
    return scored_claims.groupBy("candidate_id", "field").agg(F.array_sort(F.collect_set("value")).alias("values"), F.max("confidence").alias("confidence"))


def overall_confidence(confidences: list[Column]) -> Column:
    """Mean of the confidences that are not null, summed from left to right."""
    present = F.filter(F.array(*confidences), lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(present) > 0, total / F.size(present)).otherwise(0.0)
