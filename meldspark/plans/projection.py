"""Projection configs compiled to Columns: paths, missing-value policies, normalizers, checks.

A path is compiled to a triple of Columns: value, whether it is missing, and an error text. Rows are
emitted as JSON fragments, since a field may be left out row by row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType, VariantType

from ..functions.scalar import normalize_phone
from ..functions.vocabulary import canonical_name, load
from . import validation

_SEGMENT = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)(?:\[(\d*)\])?")


@dataclass(frozen=True)
class Path:
    """Segments: a name, ``[i]`` (an int), or ``[]`` (None)."""

    text: str
    steps: tuple[str | int | None, ...]


def parse_path(text: str) -> Path:
    steps: list[str | int | None] = []
    for part in text.split("."):
        m = _SEGMENT.fullmatch(part)
        if not m or (None in steps and "." in text and steps.count(None) > 1):
            raise ValueError(f"invalid path: {text!r}")
        steps.append(m[1])
        if m[2] is not None:
            steps.append(int(m[2]) if m[2] else None)
    if steps.count(None) > 1:
        raise ValueError(f"a path may project one array only: {text!r}")
    return Path(text, tuple(steps))


def _picking(name: str):
    return lambda x: x[name]


def _parting(name: str):
    return lambda x: validation.variant_part(x, name)


@dataclass
class Resolved:
    value: Column
    missing: Column
    error: Column
    kind: DataType | None


def resolve_path(path: Path, schema: StructType) -> Resolved:
    """Null and empty parents are missing; an index past a list that has elements is an error, and
    so is an unknown name (below a list, only where the list has elements). Below a VARIANT, names and
    places that are not there are missing, and a JSON null is."""
    none, kind, value = F.lit(None).cast("string"), schema, None
    error = none
    for n, step in enumerate(path.steps):
        if isinstance(kind, VariantType):
            if step is None:
                rest, out = path.steps[n + 1 :], validation.variant_items(value)
                for sub in rest:
                    out = F.transform(out, _parting(sub))
                return Resolved(out, validation.variant_items(value).isNull(), error, ArrayType(kind))
            value = F.get(validation.variant_items(value), F.lit(step)) if isinstance(step, int) else validation.variant_part(value, step)
        elif isinstance(step, int):
            if not isinstance(kind, ArrayType):
                return Resolved(none, F.lit(False), F.lit(f"{path.steps[n - 1]!r} is not a list (cannot index)"), None)
            past = (F.size(value) > 0) & (F.size(value) <= step)
            error = F.when(past, F.concat(F.lit(f"index {step} out of range for {path.steps[n - 1]!r} (length "), F.size(value).cast("string"), F.lit(")"))).otherwise(error)
            value, kind = F.get(value, F.lit(step)), kind.elementType
        elif step is None:
            if not isinstance(kind, ArrayType):
                return Resolved(none, F.lit(False), F.lit(f"{path.steps[n - 1]!r} is not a list (cannot project)"), None)
            rest = path.steps[n + 1 :]
            inner = kind.elementType
            for sub in rest:
                if not isinstance(inner, StructType) or sub not in inner.names:
                    return Resolved(value, value.isNull(), F.when(F.size(value) > 0, F.lit(f"non-existent subfield {sub!r}")), kind)
                inner = inner[sub].dataType
            out = value
            for sub in rest:
                out = F.transform(out, _picking(sub))
            return Resolved(out, value.isNull(), error, ArrayType(inner))
        else:
            if not isinstance(kind, StructType) or step not in kind.names:
                return Resolved(none, F.lit(False), F.lit(f"non-existent subfield {step!r}"), None)
            value = F.col(step) if value is None else value.getField(step)
            kind = kind[step].dataType
    return Resolved(value, validation.absent(value, kind), error, kind)


NORMALIZERS = {
    "lowercase": F.lower,
    "uppercase": F.upper,
    "e164": lambda c: F.coalesce(normalize_phone(c)["value"], c),
}


def normalized(value: Column, kind: DataType | None, name: str | None, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """Strings and lists of strings by the named normalizer; other values as they are."""
    name, listed = (name or "").lower(), isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType)
    if not listed and not isinstance(kind, StringType):
        return value
    if name == "canonical":
        return canonical_name(value, vocabulary or load(), listed)
    f = NORMALIZERS.get(name)
    return value if f is None else F.transform(value, f) if listed else f(value)


def compiled(df: DataFrame, config: dict, vocabulary: dict[str, list[str]] | None = None) -> tuple[Column, Column]:
    """A config as two Columns of ``df``: the profile, a JSON text of the configured fields in order,
    and its errors, an array of struct(stage, error). A field whose path is invalid is left out."""
    fragments, errors, faults = [], [], []
    everywhere = config.get("on_missing", "null")
    fields = {f.get("name") or f.get("path"): f for f in config["fields"]}
    for name, spec in fields.items():
        path = spec.get("from") or spec.get("path") or name
        got = resolve_path(parse_path(path), df.schema)
        policy = spec.get("on_missing", everywhere)
        value = normalized(got.value, got.kind, spec.get("normalize"), vocabulary)
        bad = got.error.isNotNull()
        errors.append(F.when(bad, F.struct(F.lit("project").alias("stage"), F.concat(F.lit(f"invalid canonical path {path!r} for output field {name!r}: "), got.error).alias("error"))))
        shown = F.to_json(F.struct(value.alias(name)), {"ignoreNullFields": "false"})
        fragment = F.substring(shown, F.lit(2), F.length(shown) - 2)
        absent = got.missing | bad
        fragment = F.when(~bad, F.when(~got.missing, fragment).otherwise(F.lit(f'"{name}":null' if policy == "null" else None)))
        if policy == "error":
            errors.append(F.when(got.missing & ~bad, F.struct(F.lit("project").alias("stage"), F.lit(f"required output field {name!r} is absent from the canonical record (from {path!r})").alias("error"))))
        fragments.append(fragment)
        if spec.get("required"):
            faults.append(F.when(bad if policy == "null" else absent, F.array(F.struct(F.lit(name).alias("field"), F.lit(validation.MISSING).alias("reason")))))
        faults += [F.when(~absent, f) for f in validation.field_faults(name, value, got.kind, spec)]
    if config.get("include_provenance", True) and "provenance" in df.columns:
        fragments.append(F.concat(F.lit('"provenance":'), F.to_json("provenance", {"ignoreNullFields": "false"})))
    if config.get("include_confidence", True) and "overall_confidence" in df.columns:
        fragments.append(F.concat(F.lit('"overall_confidence":'), F.col("overall_confidence").cast("string")))
    profile = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*fragments), lambda x: x.isNotNull()), ","), F.lit("}"))
    every = F.filter(F.array(*errors), lambda x: x.isNotNull()).cast(ERRORS)
    for more in faults:
        said = F.transform(more, lambda f: F.struct(F.lit("validate").alias("stage"), F.concat(F.lit("field '"), f["field"], F.lit("': "), f["reason"]).alias("error")))
        every = F.concat(every, F.coalesce(said.cast(ERRORS), F.array().cast(ERRORS)))
    return profile, every


ERRORS = "array<struct<stage:string,error:string>>"


def project(df: DataFrame, config: dict, key: str = "candidate_id", vocabulary: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Profiles ``(key, profile)`` and errors ``(key, stage, error)`` of a config (see ``compiled``). A
    column ``__order`` comes along."""
    profile, errors = compiled(df, config, vocabulary)
    found = df.select(F.col(key), F.explode(errors).alias("e")).select(key, "e.stage", "e.error")
    order = [c for c in ("__order",) if c in df.columns]
    return df.select(F.col(key), profile.alias("profile"), *order), found


def project_many(df: DataFrame, configs: dict[str, dict], key: str = "candidate_id", vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """All configs in one pass over ``df``: ``(config, number, key, profile, errors)``, a row for each of
    its rows and configs, with the config's name and its place among them; ``__order`` comes along."""
    each = []
    for i, (name, config) in enumerate(configs.items()):
        profile, errors = compiled(df, config, vocabulary)
        each.append(F.struct(F.lit(name).alias("config"), F.lit(i).alias("number"), profile.alias("profile"), errors.alias("errors")))
    order = [c for c in ("__order",) if c in df.columns]
    return df.select(F.col(key), *order, F.explode(F.array(*each)).alias("p")).select("p.config", "p.number", key, "p.profile", "p.errors", *order)
