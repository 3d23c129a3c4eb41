"""Schema checks compiled to Columns, for typed values and for VARIANT.

What a type settles is settled when the plan is made; a VARIANT is asked row by row. Either way null
values pass, a wrong type ends the checks of a field, and each fault names the place where it is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType, VariantType

FAULTS = "array<struct<field:string,reason:string>>"
#: Type names of configs, and of error texts.
TYPES = {"string": StringType, "number": NumericType, "boolean": BooleanType, "array": ArrayType, "object": StructType}
MISSING = "required field is missing from the projected profile"
NO_SUBFIELD = "required object subfield is missing"


def _none() -> Column:
    return F.array().cast(FAULTS)


def _fault(field: Column, reason: Column | str) -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    return F.array(F.struct(field.alias("field"), text.alias("reason"))).cast(FAULTS)


def variant_kind(v: Column) -> Column:
    """The name of a VARIANT's type, ``null`` for a JSON null, or SQL null where there is no value."""
    kind = F.schema_of_variant(v)
    out = F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "VOID", "null")
    return F.when(v.isNull(), None).otherwise(out.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number"))


def variant_part(v: Column, name: str) -> Column:
    """A member of an object, as VARIANT; SQL null where there is none."""
    return F.try_variant_get(v, f"$[{json.dumps(name)}]", "variant")


def variant_items(v: Column) -> Column:
    """The elements of an array, as VARIANT; SQL null for other values."""
    return F.try_variant_get(v, "$", "array<variant>")


def type_name(value: Column, kind: DataType) -> Column:
    """What a value is called in error texts."""
    if isinstance(kind, VariantType):
        return F.coalesce(variant_kind(value), F.lit("null"))
    name = next((n for n, t in TYPES.items() if isinstance(kind, t)), kind.typeName())
    return F.when(value.isNull(), "null").otherwise(name)


def absent(value: Column, kind: DataType) -> Column:
    """Whether there is no value, or null."""
    return F.coalesce(variant_kind(value) == "null", F.lit(True)) if isinstance(kind, VariantType) else value.isNull()


def matches(value: Column, kind: DataType, want: str) -> bool | Column:
    """Whether a value that is not null is of the named type: known beforehand, but for VARIANT.
    ``<name>[]`` is any array; unknown names take anything."""
    want = "array" if want.endswith("[]") else want
    if want not in TYPES:
        return True
    return variant_kind(value) == want if isinstance(kind, VariantType) else isinstance(kind, TYPES[want])


def _unless(fits: bool | Column, faults: Column) -> Column:
    if isinstance(fits, bool):
        return _none() if fits else faults
    return F.when(fits, _none()).otherwise(faults)


def _wrong(value: Column, kind: DataType, want: str, what: str = "type") -> Column:
    return F.concat(F.lit(f"expected {what} {want!r} but got '"), type_name(value, kind), F.lit("'"))


def object_faults(field: Column, value: Column, kind: DataType, structure: dict | str | None) -> Column:
    """Faults of a value, null included, against a mapping of subfields to type names or mappings."""
    if isinstance(kind, VariantType):
        is_object: bool | Column = F.coalesce(variant_kind(value) == "object", F.lit(False))
    else:
        is_object = value.isNotNull() if isinstance(kind, StructType) else False
    no_object = _fault(field, F.concat(F.lit("expected an object but got '"), type_name(value, kind), F.lit("'")))
    if is_object is False or not isinstance(structure, dict):
        return _unless(is_object, no_object)
    parts = [_none()]
    for name, want in structure.items():
        at = F.concat(field, F.lit(f".{name}"))
        if isinstance(kind, VariantType):
            sub, sub_kind = variant_part(value, name), kind
            lacking = _fault(at, NO_SUBFIELD)
        elif name in kind.names:
            sub, sub_kind, lacking = value.getField(name), kind[name].dataType, _none()
        else:
            parts.append(_fault(at, NO_SUBFIELD))
            continue
        inner = object_faults(at, sub, sub_kind, want) if isinstance(want, dict) else _unless(matches(sub, sub_kind, want), _fault(at, _wrong(sub, sub_kind, want))) if isinstance(want, str) else _none()
        inner = F.when(absent(sub, sub_kind), _none()).otherwise(inner)
        parts.append(F.when(sub.isNull(), lacking).otherwise(inner))
    return F.when(is_object, F.concat(*parts)).otherwise(no_object)


def array_faults(field: Column, value: Column, kind: DataType, want: dict | str | None) -> Column:
    """Faults of the elements of an array: scalars against a type name (null passes), or objects."""
    if not want:
        return _none()
    items, item = (variant_items(value), kind) if isinstance(kind, VariantType) else (value, kind.elementType)
    if isinstance(want, str) and matches(F.lit(None), item, want) is True:
        return _none()

    def one(x: Column, i: Column) -> Column:
        at = F.concat(field, F.lit("["), i.cast("string"), F.lit("]"))
        if isinstance(want, dict):
            return object_faults(at, x, item, want)
        return F.when(absent(x, item), _none()).otherwise(_unless(matches(x, item, want), _fault(at, _wrong(x, item, want, "element type"))))

    return F.coalesce(F.flatten(F.transform(items, one)), _none())


def one_of(value: Column, kind: DataType, allowed: list) -> Column:
    """Whether the value is among those allowed, of its own JSON kind: the number 1 is not the text "1"."""

    def typed(t: str, of: Column) -> Column:
        pick = {"string": str, "number": (int, float), "boolean": bool}[t]
        same = [x for x in allowed if isinstance(x, pick) and isinstance(x, bool) == (t == "boolean")]
        return of.isin(same) if same else F.lit(False)

    texts = [json.dumps({"v": x}, separators=(",", ":"), ensure_ascii=False) for x in allowed if isinstance(x, list | dict)]
    whole = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}).isin(texts) if texts else F.lit(False)
    if not isinstance(kind, VariantType):
        t = next((n for n, t in TYPES.items() if isinstance(kind, t)), None)
        return typed(t, value) if t in ("string", "number", "boolean") else whole
    got = variant_kind(value)
    out = F.when(got == "string", typed("string", F.try_variant_get(value, "$", "string"))).when(got == "number", typed("number", F.try_variant_get(value, "$", "double")))
    return F.coalesce(out.when(got == "boolean", typed("boolean", F.try_variant_get(value, "$", "boolean"))).otherwise(whole), F.lit(False))


def shown(value: Column, kind: DataType) -> Column:
    """A value in an error text: texts in quotes, truth as True or False, all else as JSON."""
    text = F.try_variant_get(value, "$", "string") if isinstance(kind, VariantType) else value.cast("string") if isinstance(kind, StringType | NumericType | BooleanType) else F.to_json(F.struct(value.alias("v")))
    quote = F.when(text.contains("'") & ~text.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    quoted = F.concat(quote, F.when(quote == "'", F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))).otherwise(F.replace(text, F.lit("\\"), F.lit("\\\\"))), quote)
    if isinstance(kind, VariantType):
        got = variant_kind(value)
        return F.when(got == "string", quoted).when(got == "boolean", F.initcap(text)).otherwise(F.to_json(value))
    return quoted if isinstance(kind, StringType) else F.initcap(text) if isinstance(kind, BooleanType) else text if isinstance(kind, NumericType) else F.regexp_replace(text, r'(?s)^\{"v":(.*)\}$', "$1")


def field_faults(name: str, value: Column, kind: DataType | None, spec: dict) -> Iterator[Column]:
    """Faults of a field that is present, with a null for none, by the keys type, enum and element_type
    of its spec."""
    field, want, element = F.lit(name), spec.get("type"), spec.get("element_type")
    if kind is None:
        return
    there = ~absent(value, kind)
    fits: bool | Column = True if want is None else matches(value, kind, want)
    if fits is not True:
        wrong = _fault(field, _wrong(value, kind, want))
        yield F.when(there & (F.lit(True) if fits is False else ~fits), wrong)
        if fits is False:
            return
        there = there & fits
    if spec.get("enum") is not None:
        reason = F.concat(F.lit("value "), shown(value, kind), F.lit(f" is not a member of the allowed set {list(spec['enum'])!r}"))
        yield F.when(there & ~one_of(value, kind, spec["enum"]), _fault(field, reason))
    if want == "array" or (want or "").endswith("[]"):
        yield F.when(there, array_faults(field, value, kind, element or want[:-2] if want != "array" else element))
    elif want == "object":
        yield F.when(there, object_faults(field, value, kind, element))
