"""Skill vocabulary: canonical names with aliases, and matching of raw terms against it."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .near import few, keyed, other_side, shared
from .scalar import clean, indel_ratio, lcs
from .skill_names import SKILLS

QUALITY = {"exact": 1.0, "alias": 0.8, "fuzzy": 0.6}


def load(path: str | None = None) -> dict[str, list[str]]:
    """From ``path``, else the file named by MELDSPARK_VOCABULARY, an object of names with lists of
    aliases; the built-in names where there is no file, or none that can be read as such."""
    path = path or os.environ.get("MELDSPARK_VOCABULARY")
    try:
        with open(path or "", encoding="utf-8") as f:
            given = json.load(f)
    except (OSError, ValueError):
        given = None
    if not isinstance(given, dict) or not given:
        return SKILLS
    return {str(name): [str(a) for a in aliases or []] for name, aliases in given.items()}


def forms(spark: SparkSession, vocabulary: dict[str, list[str]]) -> DataFrame:
    """``(form, name, quality)``: a row per lower-cased surface form; exact names before aliases."""
    rows = [(n.lower(), n, 0, QUALITY["exact"]) for n in vocabulary] + [(a.lower(), n, 1, QUALITY["alias"]) for n, al in vocabulary.items() for a in al]
    df = spark.createDataFrame(rows, "form string, name string, tier int, quality double")
    return df.groupBy("form").agg(F.min_by(F.struct("name", "quality"), F.struct("tier", "name")).alias("m")).select("form", "m.name", "m.quality")


def term_key(c: Column) -> Column:
    return F.lower(clean(F.regexp_replace(c, r"(?U)\s+", " ")))


def match_terms(terms: DataFrame, column: str, vocabulary: dict[str, list[str]], threshold: float = 90.0, least: int = 4) -> DataFrame:
    """Adds ``key``, ``name`` and ``quality``: exact or alias form, else the closest form with an
    indel ratio of at least ``threshold`` (keys of ``least`` characters or more), else null.

    Distinct unmatched keys meet the forms under subsequences that they share, so each meets the close
    ones only; those of some thirty characters or more are compared with the forms of such lengths."""
    rule = (int(threshold), False)
    table = forms(terms.sparkSession, vocabulary)
    given = sorted({len(f) for n, al in vocabulary.items() for f in (n.lower(), *map(str.lower, al)) if len(f) >= least})
    keyed_ = terms.withColumn("key", term_key(F.col(column)))
    exact = keyed_.join(table.toDF("form", "name", "quality"), F.col("key") == F.col("form"), "left").drop("form")
    open_ = exact.where(F.col("name").isNull() & (F.length("key") >= least)).select("key").distinct()
    near_forms = table.where(F.length("form") >= least).toDF("form", "near", "q").drop("q")
    lengths = sorted({n for m in given for n in range(m * 2 // 3, m * 3 // 2 + 2) if shared(n, m, *rule)})  # of keys that can be close
    short = keyed(open_.withColumnRenamed("key", "term"), "term", given, *rule)
    met = short.join(keyed(near_forms, "form", lengths, *rule).withColumn("side", other_side("side")), ["key", "side"]).select("term", "form", "near")
    if long := [(n, m) for m in given for n in lengths if shared(n, m, *rule) and not few(n, m, *rule)]:
        size, of_form = F.length("term"), F.length("form")
        fits = 200 * F.least(size, of_form) >= rule[0] * (size + of_form)
        some = open_.where(F.length("key").isin(sorted({n for n, _ in long}))).withColumnRenamed("key", "term")
        met = met.union(some.join(near_forms.where(F.length("form").isin(sorted({m for _, m in long}))), fits).select("term", "form", "near"))
    near = met.distinct().withColumn("ratio", indel_ratio("term", "form")).where(F.col("ratio") >= threshold)
    near = near.groupBy(F.col("term").alias("key")).agg(F.min_by("near", F.struct(-F.col("ratio"), F.col("form"))).alias("near"))
    out = exact.join(near, "key", "left")
    return out.withColumn("quality", F.coalesce("quality", F.when(F.col("near").isNotNull(), QUALITY["fuzzy"]))).withColumn("name", F.coalesce("name", "near")).drop("near")


#: Bytes that a mention does not follow, and is not followed by.
BEFORE, AFTER = frozenset(b"+#.0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"), frozenset(b"+#0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=4)
def automaton(terms: tuple[str, ...]):
    """One automaton of all forms as bytes, A-Z in lower case, with a number and length each."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, term in enumerate(sorted({t.encode().lower() for t in terms} - {b""})):
        made.add_word(term.decode("latin-1"), (i, len(term)))
    made.make_automaton()
    return made


def found_mentions(text: str, terms: tuple[str, ...]) -> list[str]:
    """The first whole-word place of each form, in order, as it stands in the text."""
    raw, seen = text.encode(), {}
    scan = automaton(terms)
    for end, (i, size) in scan.iter(raw.lower().decode("latin-1")) if len(scan) else ():
        start = end + 1 - size
        if i not in seen and (not start or raw[start - 1] not in BEFORE) and (end + 1 == len(raw) or raw[end + 1] not in AFTER):
            seen[i] = (start, raw[start : end + 1])
    return [r.decode() for _, r in sorted(seen.values())]


def mentions(text: Column, vocabulary: dict[str, list[str]]) -> Column:
    """Vocabulary forms found in a text as whole words, in order, each once whatever its case; none in
    a null text, or one that is not UTF-8. One automaton runs over each text, however many forms there are."""
    terms = tuple(sorted({f for n, a in vocabulary.items() for f in (n, *a)}))

    @F.pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: found_mentions(t, terms) if t else [])

    return found(F.try_validate_utf8(text))


def canonical_name(value: Column, vocabulary: dict[str, list[str]], listed: bool = False, threshold: float = 90.0, least: int = 4) -> Column:
    """A term, or each of a list, by its canonical name; terms that match nothing stay as they are.
    Same tiers as ``match_terms``, for a projected value that no join can reach."""
    exact = {a.lower(): n for n, al in vocabulary.items() for a in al} | {n.lower(): n for n in vocabulary}
    near: dict[str, str | None] = {}

    def name(raw: str | None) -> str | None:
        key = " ".join((raw or "").split()).lower()
        if not key or key in exact:
            return exact.get(key, raw)
        if len(near) > 100_000:
            near.clear()
        if key not in near:
            ratios = [(-200 * lcs(key, f) / (len(key) + len(f)), f) for f in exact if min(len(f), len(key)) >= least]
            best = min(ratios, default=(0.0, ""))
            near[key] = exact[best[1]] if -best[0] >= threshold else None
        return near[key] or raw

    def one(values: pd.Series) -> pd.Series:
        return values.map(name, na_action="ignore")

    def many(values: pd.Series) -> pd.Series:
        return values.map(lambda terms: None if terms is None else [name(t) for t in terms])

    return F.pandas_udf(many, ArrayType(StringType()))(value) if listed else F.pandas_udf(one, StringType())(value)
