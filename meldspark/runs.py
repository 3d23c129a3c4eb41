"""Runs: source references to profiles and errors, for one or several projection configs.

A source that cannot be read, and a record that cannot be extracted, become rows of the errors
``(source, stage, error)`` and stop nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import canonical
from .operators.scratch import materialize
from .plans.projection import parse_path, project
from .sources import readers, resumes

ERRORS = "source string, stage string, error string"
POLICIES = ("null", "omit", "error")


@dataclass
class RunResult:
    profiles: DataFrame
    errors: DataFrame

    @property
    def exit_code(self) -> int:
        return 0 if self.errors.isEmpty() else 1


def check_config(config: dict) -> dict:
    """The config itself, or ValueError where its structure or a path in it is wrong."""
    if not isinstance(config, dict) or not isinstance(config.get("fields", []), list):
        raise ValueError("a projection config is an object with a list of fields")
    for spec in [config, *config.get("fields", [])]:
        if not isinstance(spec, dict) or spec.get("on_missing", "null") not in POLICIES:
            raise ValueError(f"on_missing must be one of {POLICIES}")
        if spec is not config:
            path = spec.get("from") or spec.get("path") or spec.get("name")
            if not path:
                raise ValueError("a field needs a name")
            parse_path(path)
    return {"fields": [], **config}


def _exists(spark: SparkSession, location: str) -> bool:
    """Whether Spark's file systems have something there; web addresses are not fetched."""
    if location.startswith(("http://", "https://")):
        return False
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(location)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _kind(v: Column) -> Column:
    """What JSON calls the value, in the words of the error texts (fixed values)."""
    kind = F.schema_of_variant(v)
    out = F.when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "str").when(kind == "BOOLEAN", "bool").when(kind == "BIGINT", "int").when(kind == "VOID", "NoneType")
    return F.when(kind.startswith("OBJECT"), "dict").otherwise(out.otherwise("float"))


def json_errors(spark: SparkSession, location: str, kind: str) -> DataFrame:
    """Files that are not JSON, and values that ought to be objects."""
    files = readers._json(spark, location).drop("ordinal")
    bad = files.where("v is null").select(F.col("source_id").alias("source"), F.lit("ingest").alias("stage"), F.format_string("source '%s' is not valid JSON", "source_id").alias("error"))
    if kind == "ats_json":
        list_ = F.try_variant_get("v", "$", "array<variant>")
        each = files.where(list_.isNotNull()).select("source_id", F.posexplode(list_).alias("i", "v"))
        values = each.select(F.concat("source_id", F.lit("#"), F.col("i").cast("string")).alias("source_id"), "v").unionByName(files.where(list_.isNull()))
    else:
        values = files
    values = values.where("v is not null").select("source_id", _kind(F.col("v")).alias("kind")).where("kind <> 'dict'")
    return bad.unionByName(values.select(F.col("source_id").alias("source"), F.lit("extract").alias("stage"), F.format_string("Expected a JSON object, got %s", "kind").alias("error")))


def read_sources(spark: SparkSession, refs: list[tuple[str, str | None]], registry: readers.Registry = readers.REGISTRY, strict: bool = False) -> tuple[DataFrame | None, DataFrame]:
    """References ``(location, type or None)`` to records, or None, and errors.

    A source that reads well but has no records gives one record of nulls. References are few and
    handled one by one; a reference may be a folder or a pattern of any number of files. The order of
    the records is that of the references, then of their files, then of the rows. ``strict`` reports
    CSV rows that are not as wide as their header, too, which are records all the same.
    """
    records, errors, known = [], [], []
    for location, hint in refs:
        try:
            adapter = registry.resolve(location, hint)
        except ValueError:
            known.append((location, "ingest", f"No registered adapter can handle reference: location={location!r}, source_type={hint!r}"))
            continue
        kind = adapter.kind
        try:
            if not _exists(spark, location):
                known.append((location, "ingest", f"failed to read {kind} source {location!r}: not found"))
                continue
            faults = None
            if kind in readers.TEXT_SOURCES:
                faults = readers.text_faults(spark, location, kind)
                unread = faults.select(F.col("source").alias("source_id"))
                if strict and kind == "recruiter_csv":
                    faults = faults.unionByName(readers.csv_faults(spark, location).join(unread.withColumnRenamed("source_id", "source"), "source", "left_anti").select(*faults.columns))
            elif kind in ("ats_json", "github", "linkedin"):
                faults = json_errors(spark, location, kind)
            elif kind == "resume":
                faults = resumes.faults(spark, location)
            found = adapter.read(spark, location)
            if kind in readers.TEXT_SOURCES:
                found = found.join(unread, "source_id", "left_anti").select(*found.columns)
            if found.isEmpty() and (faults is None or faults.isEmpty()):
                found = readers._records(spark.range(1), kind, F.lit(location), {})
        except Exception as e:  # whatever a source is like, the others are read
            known.append((location, "ingest", f"unexpected ingest error: {type(e).__name__}"))
            continue
        records.append(found.withColumns({"ordinal": F.col("ordinal") + (len(records) << 48), "record_id": F.xxhash64("record_id", F.lit(len(records)))}))
        if faults is not None:
            errors.append(faults)
    every = reduce(DataFrame.unionByName, [spark.createDataFrame(known, ERRORS), *errors]).distinct()
    return (reduce(DataFrame.unionByName, records) if records else None), every


def build(spark: SparkSession, refs: list[tuple[str, str | None]], vocabulary: dict[str, list[str]] | None = None, registry: readers.Registry = readers.REGISTRY, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The candidates, written once for all projections, and the errors of their sources. Without
    any records there is one candidate of nulls."""
    records, errors = read_sources(spark, refs, registry, strict)
    if records is None:
        records = readers._records(spark.range(0), "", F.lit(""), {})
    people = materialize(canonical(records, vocabulary), "candidates")
    if people.isEmpty():
        schema = people.schema
        blank = [F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit(None).cast(f.dataType) for f in schema]
        people = spark.range(1).select(*[c.alias(f.name) for c, f in zip(blank, schema, strict=True)]).withColumn("overall_confidence", F.lit(0.0))
    return people, materialize(errors, "source-errors")


def run_multi(spark: SparkSession, refs: list[tuple[str, str | None]], configs: list[dict], vocabulary: dict[str, list[str]] | None = None, registry: readers.Registry = readers.REGISTRY, strict: bool = False) -> list[RunResult]:
    """One result per config; sources are read, resolved and fused once."""
    configs = [check_config(c) for c in configs]
    people, errors = build(spark, refs, vocabulary, registry, strict)
    out = []
    for config in configs:
        profiles, found = project(people, config, vocabulary=vocabulary)
        found = found.select(F.col("candidate_id").alias("source"), "stage", "error")
        out.append(RunResult(profiles, errors.unionByName(found)))
    return out


def run(spark: SparkSession, refs: list[tuple[str, str | None]], config: dict, vocabulary: dict[str, list[str]] | None = None, registry: readers.Registry = readers.REGISTRY, strict: bool = False) -> RunResult:
    return run_multi(spark, refs, [config], vocabulary, registry, strict)[0]
