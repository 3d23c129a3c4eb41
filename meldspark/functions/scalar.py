"""Normalizers as Columns: each gives ``struct(value, quality)``, value null and quality 0 if rejected."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

#: The namespace of entity ids, qualities, month names, phone plans.
ID_NAMESPACE = "6f9b3f7a2c1e5d8b9a4c3e2d1f0a7b6c"
EMAIL_QUALITY = (1.0, 0.7)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Country code to the pattern of its national numbers, from the public numbering plans. Numbers of
#: other countries are rejected: no value is better than a wrong one.
PHONE_PLANS = {
    "1": "[2-9][0-9]{2}[2-9][0-9]{6}", "7": "[3489][0-9]{9}", "20": "1[0125][0-9]{8}|[2-9][0-9]{7,8}", "27": "[1-8][0-9]{8}", "30": "2[0-9]{9}|6[89][0-9]{8}", "31": "[1-9][0-9]{8}",
    "32": "[1-9][0-9]{7}|4[0-9]{8}", "33": "[1-9][0-9]{8}", "34": "[5-9][0-9]{8}", "36": "[1-9][0-9]{7,8}", "39": "0[0-9]{5,10}|3[0-9]{8,9}", "40": "[237][0-9]{8}", "41": "[2-9][0-9]{8}",
    "43": "[1-9][0-9]{3,12}", "44": "[1237][0-9]{8,9}|[58][0-9]{9}", "45": "[2-9][0-9]{7}", "46": "[1-9][0-9]{6,9}", "47": "[2-9][0-9]{7}", "48": "[1-9][0-9]{8}", "49": "[1-9][0-9]{5,12}",
    "51": "9[0-9]{8}|[14-8][0-9]{7}", "52": "[2-9][0-9]{9}", "54": "9?[1-3][0-9]{9}", "55": "[1-9]{2}9?[0-9]{8}", "56": "[2-9][0-9]{8}", "57": "3[0-9]{9}|60[0-9]{8}", "58": "[24][0-9]{9}",
    "60": "1[0-9]{8,9}|[3-9][0-9]{7,8}", "61": "[23478][0-9]{8}", "62": "[2-9][0-9]{7,11}", "63": "9[0-9]{9}|[2-8][0-9]{7,9}", "64": "[34679][0-9]{7}|2[0-9]{7,9}", "65": "[3689][0-9]{7}",
    "66": "[2-7][0-9]{7}|[689][0-9]{8}", "81": "[1-9][0-9]{8}|[5789]0[0-9]{8}", "82": "1[0-9]{8,9}|[2-6][0-9]{7,9}", "84": "[2-9][0-9]{8}|2[0-9]{9}", "86": "1[3-9][0-9]{9}|[2-9][0-9]{8,10}",
    "90": "[2-5][0-9]{9}", "91": "[6-9][0-9]{9}", "92": "3[0-9]{9}|[2-9][0-9]{8,9}", "94": "[1-9][0-9]{8}", "98": "[1-9][0-9]{9}", "212": "[5-7][0-9]{8}", "234": "[7-9][0-9]{9}|[1-9][0-9]{6,7}",
    "254": "[17][0-9]{8}|[2-6][0-9]{6,8}", "351": "[2-9][0-9]{8}", "353": "[1-9][0-9]{6,9}", "358": "[1-9][0-9]{4,11}", "380": "[3-9][0-9]{8}", "420": "[2-9][0-9]{8}", "852": "[2-9][0-9]{7}",
    "880": "1[0-9]{9}|[2-9][0-9]{7,9}", "886": "9[0-9]{8}|[2-8][0-9]{7,8}", "966": "[15][0-9]{8}", "971": "5[0-9]{8}|[2-9][0-9]{7}", "972": "5[0-9]{8}|[2-9][0-9]{7}", "977": "9[0-9]{9}|[1-9][0-9]{7}",
}


def clean(c: Column) -> Column:
    """Trimmed of all Unicode white space; null if nothing is left."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(trimmed != "", trimmed)


def _result(value: Column, quality: Column) -> Column:
    return F.struct(value.alias("value"), F.when(value.isNull(), 0.0).otherwise(quality).cast("double").alias("quality"))


def normalize_email(c: Column) -> Column:
    value = F.lower(clean(c))
    return _result(value, F.when(value.rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"), EMAIL_QUALITY[0]).otherwise(EMAIL_QUALITY[1]))


def normalize_phone(c: Column, default_code: str | None = None) -> Column:
    """E.164 for numbers with a leading plus (1.0), or of the default country (0.7)."""
    text = clean(c)
    explicit = F.startswith(text, F.lit("+"))
    digits = F.regexp_replace(text, r"[^0-9]", "")
    shaped = text.rlike(r"^\+?[0-9().\s/\-]+$")
    known = "|".join(f"{code}(?:{plan})" for code, plan in PHONE_PLANS.items())
    full = F.when(explicit, digits)
    if default_code:
        full = full.otherwise(F.concat(F.lit(default_code), F.regexp_replace(digits, "^0", "")))
    return _result(F.when(shaped & full.rlike(f"^(?:{known})$"), F.concat(F.lit("+"), full)), F.when(explicit, 1.0).otherwise(0.7))


def normalize_date(c: Column) -> Column:
    """``YYYY-MM`` from year-month, month-year, month name and year (1.0), or a year alone (0.6)."""
    text = clean(c)
    names = {m: i + 1 for i, m in enumerate(MONTHS)} | {m[:3]: i + 1 for i, m in enumerate(MONTHS)} | {"sept": 9}
    month_of = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    named = lambda word: F.try_element_at(month_of, F.lower(word))
    forms = [
        (r"^(\d{4})[-/](\d{1,2})(?:[-/]\d{1,2})?$", 1, lambda p: F.regexp_extract(text, p, 2).cast("int"), 1.0),
        (r"^(\d{1,2})[-/](\d{4})$", 2, lambda p: F.regexp_extract(text, p, 1).cast("int"), 1.0),
        (r"^([A-Za-z]+)[\s,]+(\d{4})$", 2, lambda p: named(F.regexp_extract(text, p, 1)), 1.0),
        (r"^(\d{4})[\s,]+([A-Za-z]+)$", 1, lambda p: named(F.regexp_extract(text, p, 2)), 1.0),
        (r"^(\d{4})$", 1, lambda p: F.lit(1), 0.6),
    ]
    year, month, quality = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0.0)
    for pattern, y, m, q in reversed(forms):
        hit = text.rlike(pattern)
        year = F.when(hit, F.regexp_extract(text, pattern, y).cast("int")).otherwise(year)
        month = F.when(hit, m(pattern)).otherwise(month)
        quality = F.when(hit, q).otherwise(quality)
    ok = year.between(1900, 2099) & month.between(1, 12)
    return _result(F.when(ok, F.format_string("%04d-%02d", year, month)), quality)


_countries: list[tuple[str, str]] = []


def country_table(spark: SparkSession) -> DataFrame:
    """``(key, code)``: ISO 3166 alpha-2, alpha-3 and English names, from the JVM's own tables, which are
    asked once."""
    if not _countries:
        locale, found = spark.sparkContext._jvm.java.util.Locale, {}
        for code in locale.getISOCountries():
            of = locale("", code)
            for key in (code, of.getISO3Country(), of.getDisplayCountry(locale.ENGLISH)):
                if key:
                    found.setdefault(key.lower(), code)
        _countries[:] = found.items()
    return spark.createDataFrame(_countries, "key string, code string")


def with_country(df: DataFrame, column: str, into: str) -> DataFrame:
    """Adds ``into``: struct(value, quality) of the country named in ``column``: exactly (1.0), or by
    a part of its name (0.7), the earlier in the name the better, then the smaller code. The table
    has about 750 rows, which bounds the broadcasts; only distinct unknown names meet all of it."""
    table = country_table(df.sparkSession).select(F.col("key").alias("__key"), F.col("code").alias("__code"))
    keyed = df.withColumn("__land", F.lower(clean(F.col(column))))
    exact = F.broadcast(table)
    open_ = keyed.where("__land is not null").select("__land").distinct().join(exact, F.col("__land") == F.col("__key"), "left_anti")
    parts = table.where(F.length("__key") > 3).toDF("name", "near")
    near = open_.join(F.broadcast(parts), F.col("name").contains(F.col("__land"))).groupBy("__land").agg(F.min_by("near", F.struct(F.least(F.instr("name", F.col("__land")), F.lit(13)), F.col("near"))).alias("__near")).withColumnRenamed("__land", "__part")
    out = keyed.join(exact, F.col("__land") == F.col("__key"), "left").join(near, F.col("__land") == F.col("__part"), "left")
    return out.withColumn(into, _result(F.coalesce("__code", "__near"), F.when(F.col("__code").isNotNull(), 1.0).otherwise(0.7))).drop("__key", "__code", "__land", "__part", "__near")


def name_key(c: Column) -> Column:
    return F.lower(clean(F.regexp_replace(c, r"(?U)\s+", " ")))


def entity_id(key: Column) -> Column:
    """UUID version 5 of a key in the fixed namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(ID_NAMESPACE)), F.encode(key, "UTF-8")))
    variant = F.lower(F.lpad(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)), 2, "0"))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def lcs(a: str, b: str) -> int:
    """Longest common subsequence, a row of bits at a time."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & at.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """200 LCS / (len a + len b); two empty strings are equal."""
    return pd.Series([None if x is None or y is None else 200 * lcs(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a, b, strict=True)], dtype="Float64")


#: What looks like an email address, and like a phone number.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)\+?\d[\d\s().\-]{7,}\d"


def find_emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), 0))


def find_phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), 0), clean)
    return F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, r"(?U)\D", "")).between(10, 15)))


def find_link(text: Column, site: str) -> Column:
    """First profile link of ``site`` (linkedin.com/in, github.com), or null."""
    hit = F.regexp_extract(text, rf"(?i)(?:https?://)?(?:www\.)?{site.replace('.', '[.]')}/[A-Za-z0-9_\-%./]+", 0)
    return F.when(hit != "", F.regexp_replace(hit, "[.,;]+$", ""))


def github_user(c: Column) -> Column:
    """The user name in a profile address, or a bare one, without a leading @."""
    text = F.regexp_replace(clean(c), "/+$", "")
    return F.regexp_extract(text, r"^(?:.*?(?i:github\.com/))?@*([^/]*)", 1)
