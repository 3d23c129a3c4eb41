"""The whole run: records to one canonical row per candidate.

Records are taken apart into claims, a row for each value of each field, which are scored together.
One aggregation per group and field then gives values, confidence and provenance, and a second per
group the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.scalar import name_key, normalize_date, normalize_email, normalize_phone, with_country
from .functions.vocabulary import load, match_terms
from .operators.fusion import FIELDS, field_confidence, overall_confidence, priority, reliability, scored, winner_rank
from .operators.identity import resolve
from .operators.scratch import materialize

#: The order of provenance, and the method of a field that no source has.
PROVENANCE = ("full_name", "emails", "phones", "location", "links.linkedin", "links.github", "links.portfolio", "links.other", "headline", "years_experience", "skills", "experience", "education")
NOT_FOUND = "not_found"
LISTS = ("emails", "phones", "links.other", "skills")
ENTRIES = ("experience", "education")
#: Fields whose claims hold JSON texts.
_JSON = ("location", "years_experience", *ENTRIES)
_CLAIM = "array<struct<field:string,at:int,value:string,quality:double,method:string>>"


def _as_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _claims(owned: DataFrame) -> DataFrame:
    """A row for each value that a record claims for a field, skills as they stand; and one without a
    field for each record."""

    def one(field: str, value: Column, quality: Column, of: str | None = None) -> Column:
        claim = F.struct(F.lit(field).alias("field"), F.lit(0).alias("at"), value.alias("value"), quality.cast("double").alias("quality"), F.element_at("methods", F.lit(of or field)).alias("method"))
        return F.when(value.isNotNull(), F.array(claim))

    def many(field: str, items: Column, value, quality=None, of: str | None = None) -> Column:
        def claim(x: Column, i: Column) -> Column:
            return F.struct(F.lit(field).alias("field"), i.alias("at"), value(x).alias("value"), (F.lit(1.0) if quality is None else quality(x)).cast("double").alias("quality"), F.element_at("methods", F.lit(of or field)).alias("method"))

        return F.transform(items, claim)

    dated = lambda x: _as_json(F.struct(x["company"].alias("company"), x["title"].alias("title"), normalize_date(x["start"])["value"].alias("start"), normalize_date(x["end"])["value"].alias("end"), x["summary"].alias("summary")))
    place = _as_json(F.struct(F.col("location.city").alias("city"), F.col("location.region").alias("region"), F.col("country.value").alias("country")))
    place = F.when(F.coalesce("location.city", "location.region", "country.value").isNotNull(), place)
    land = F.when(F.coalesce("location.country", F.lit("")) == "", 1.0).otherwise(F.coalesce(F.when(F.col("country.value").isNotNull(), F.col("country.quality")), F.lit(0.5)))
    years = F.when(F.col("years_experience") == F.floor("years_experience"), F.col("years_experience").cast("long").cast("string")).otherwise(F.col("years_experience").cast("string"))
    full = F.lit(1.0)
    parts = [
        one("full_name", F.col("full_name"), full), one("headline", F.col("headline"), full), one("years_experience", years, full), one("location", place, land),
        *[one(f"links.{k}", F.when(F.col(f"links.{k}") != "", F.col(f"links.{k}")), full, "links") for k in ("linkedin", "github", "portfolio")],
        many("links.other", F.col("links.other"), lambda x: x, of="links"),
        many("emails", F.col("emails"), lambda x: normalize_email(x)["value"], lambda x: normalize_email(x)["quality"]),
        many("phones", F.col("phones"), lambda x: normalize_phone(x)["value"], lambda x: normalize_phone(x)["quality"]),
        many("skills", F.col("skills"), lambda x: x),
        many("experience", F.col("experience"), dated), many("education", F.col("education"), _as_json),
    ]
    none = F.array().cast(_CLAIM)
    mark = F.array(F.struct(F.lit("").alias("field"), F.lit(0).alias("at"), F.lit("").alias("value"), F.lit(0.0).alias("quality"), F.lit(None).cast("string").alias("method")))
    every = F.concat(mark.cast(_CLAIM), *[F.coalesce(p.cast(_CLAIM), none) for p in parts])
    base = ["group_id", "candidate_id", "source_type", "source_id", "record_id", "order"]
    return owned.select(*base, F.explode(F.filter(every, lambda c: c["value"].isNotNull())).alias("c")).select(*base, "c.*")


def _owned(records: DataFrame) -> DataFrame:
    """Records with group_id, candidate_id and the key that they are ordered by."""
    records = materialize(records, "records")
    values = lambda c, f: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: f(x)["value"]), lambda x: x.isNotNull())
    origin = F.concat("source_type", F.lit("/"), "source_id").alias("origin")
    keys = materialize(records.select("record_id", values(F.col("emails"), normalize_email).alias("emails"), values(F.col("phones"), normalize_phone).alias("phones"), name_key(F.col("full_name")).alias("name"), origin), "keys")
    blank = lambda c: F.coalesce(c, F.lit(""))
    order = F.struct(blank(F.array_min("__e")).alias("email"), blank(F.array_min("__p")).alias("phone"), blank(F.col("__n")).alias("name"), "source_type", "source_id", "ordinal")
    contacts = keys.select("record_id", F.col("emails").alias("__e"), F.col("phones").alias("__p"), F.col("name").alias("__n"))
    return records.join(contacts, "record_id").join(resolve(keys), "record_id").withColumn("order", order).drop("__e", "__p", "__n")


def _heads(owned: DataFrame) -> DataFrame:
    return owned.groupBy("group_id").agg(F.min("candidate_id").alias("candidate_id"), F.min("order").alias("__order"))


def candidate_orders(records: DataFrame) -> DataFrame:
    """candidate_id and ``__order`` of ``canonical``'s rows, without what else these hold: nothing of a
    candidate is gathered."""
    return _heads(_owned(records)).drop("group_id")


def canonical(records: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """Records (see ``sources.readers``) to candidates: candidate_id, the fused fields, provenance,
    overall_confidence, and ``__order``, the smallest order key of the candidate's records.

    Records without any value are candidates of their own. Claims that are null, or that their
    normalizer rejects, do not count. What a candidate's row holds is gathered in one task: its
    lists, and an entry of provenance for each claim of a list field. No records give no rows."""
    vocabulary = vocabulary or load()
    owned = _owned(records)
    owned = with_country(owned.withColumn("__land", F.col("location.country")), "__land", "country")

    every = materialize(_claims(owned), "claims")
    claims = every.where("field not in ('', 'skills')")
    skilled = every.where("field = 'skills'").drop("quality")
    matched = materialize(match_terms(skilled, "value", vocabulary).where("key is not null"), "terms")
    known = matched.where("name is not null").drop("value", "key").withColumnRenamed("name", "value").select(*claims.columns)
    shown = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    unknown = matched.where("name is null").withColumn("value", F.regexp_replace(shown, r"(?U)\s+", " ")).where(F.col("value").rlike(r"\p{L}"))
    unknown = unknown.drop("name", "quality")
    claims = claims.unionByName(known)

    # Entries count once, for the first record that has them; the others by agreement.
    entry = claims.where(F.col("field").isin(*ENTRIES)).groupBy("group_id", "field", "value").agg(F.min(F.struct("order", "at", "source_type", "source_id", "method")).alias("m"))
    entry = entry.select("group_id", "field", "value", "m.*", field_confidence(reliability(F.col("m.source_type")), F.lit(1.0), F.lit(1.0)).alias("confidence"))
    nothing = F.struct(F.lit("").alias("email"), F.lit("").alias("phone"), F.lit("").alias("name"), F.lit("").alias("source_type"), F.lit("").alias("source_id"), F.lit(0).cast("long").alias("ordinal"))
    place = lambda listed: F.struct((F.col("order") if listed else nothing).alias("order"), (F.col("at") if listed else F.lit(0)).alias("at"), F.col("value").alias("value"), F.coalesce("source_id", F.lit("")).alias("source"), F.coalesce("method", F.lit("")).alias("way"), F.col("order").alias("then"), F.col("at").alias("then_at"))
    told = lambda df, listed: df.withColumn("told", F.struct(place(listed).alias("place"), "field", "value", "source_id", "method", "confidence"))
    marks = scored(claims.where(~F.col("field").isin(*ENTRIES)), key="group_id")
    per = told(marks, False).groupBy("group_id", "field").agg(
        F.min_by(F.struct("value", "confidence", "told"), winner_rank()).alias("best"), F.array_sort(F.collect_set("value")).alias("values"),
        F.max("confidence").alias("top"), F.array_sort(F.collect_list("told")).alias("told"),
    )
    listed = F.col("field").isin(*LISTS)
    per = per.select("group_id", "field", "best.value", "values", F.when(listed, F.col("top")).otherwise(F.col("best.confidence")).alias("confidence"), F.when(listed, F.col("told")).otherwise(F.array("best.told")).alias("told"))
    entries = told(entry, True).groupBy("group_id", "field").agg(F.array_sort(F.collect_list("told")).alias("told"), F.max("confidence").alias("confidence"))
    entries = entries.select("group_id", "field", F.lit(None).cast("string").alias("value"), F.transform("told", lambda x: x["value"]).alias("values"), "confidence", "told")
    strays = told(unknown.withColumns({"field": F.lit("unknown_skills"), "confidence": F.lit(0.0)}), False).groupBy("group_id").agg(F.array_sort(F.collect_list("told")).alias("told"))
    first = unknown.groupBy("group_id", "key").agg(F.min_by("value", F.struct("order", "at")).alias("shown"))
    first = first.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("key", "shown"))), lambda x: x["shown"]).alias("values"))
    strays = strays.join(first, "group_id").select("group_id", F.lit("unknown_skills").alias("field"), F.lit(None).cast("string").alias("value"), "values", F.lit(None).cast("double").alias("confidence"), "told")
    skill = marks.where("field = 'skills'").groupBy("group_id", "value").agg(F.max(reliability(F.col("source_type"))).alias("r"), F.max("quality").alias("q"), F.max("agreement").alias("a"), F.array_sort(F.collect_set("source_id")).alias("sources"))
    skill = skill.select("group_id", F.struct(F.col("value").alias("name"), field_confidence(F.col("r"), F.col("a"), F.col("q")).alias("confidence"), "sources").alias("skill"))
    skills = skill.groupBy("group_id").agg(F.array_sort(F.collect_list("skill")).alias("skills"), F.max("skill.confidence").alias("c_skills"))

    pick = lambda column, field: F.max(F.when(F.col("field") == field, F.col(column)))
    flat = per.unionByName(entries).unionByName(strays).groupBy("group_id").agg(
        *[pick("value", f).alias(f"v_{f}") for f in PROVENANCE if f not in LISTS + ENTRIES],
        *[pick("values", f).alias(f"l_{f}") for f in (*LISTS[:3], *ENTRIES, "unknown_skills")],
        *[pick("confidence", f).alias(f"c_{f}") for f in PROVENANCE if f != "skills"],
        *[pick("told", f).alias(f"t_{f}") for f in (*PROVENANCE, "unknown_skills")],
    )
    heads = _heads(every.where("field = ''"))
    out = heads.join(flat, "group_id", "left").join(skills, "group_id", "left")

    v, many, c = (lambda f: F.col(f"`v_{f}`")), (lambda f: F.coalesce(F.col(f"`l_{f}`"), F.array().cast("array<string>"))), (lambda f: F.col(f"`c_{f}`"))
    links = F.array_max(F.array(*[c(f) for f in PROVENANCE if f.startswith("links.")]))
    confidences = [links if f == "links" else c(f) for f in FIELDS]
    parsed = lambda f, kind: F.transform(many(f), lambda x: F.from_json(x, kind))
    return out.select(
        "candidate_id", v("full_name").alias("full_name"), many("emails").alias("emails"), many("phones").alias("phones"),
        F.coalesce(F.from_json(v("location"), "city string, region string, country string"), F.struct(*[F.lit(None).cast("string").alias(n) for n in ("city", "region", "country")])).alias("location"),
        F.struct(*[v(f"links.{k}").alias(k) for k in ("linkedin", "github", "portfolio")], many("links.other").alias("other")).alias("links"),
        v("headline").alias("headline"), v("years_experience").cast("double").alias("years_experience"),
        F.coalesce("skills", F.array().cast(skills.schema["skills"].dataType)).alias("skills"), many("unknown_skills").alias("unknown_skills"),
        parsed("experience", "company string, title string, start string, end string, summary string").alias("experience"),
        parsed("education", "institution string, degree string, field string, end_year int").alias("education"),
        _provenance().alias("provenance"), overall_confidence(confidences).alias("overall_confidence"), "__order",
    )


def _provenance() -> Column:
    """Entries of every field in the fixed order; one of its own for each field that no source has.
    Values are VARIANT: texts, numbers or objects."""
    none = F.lit(None).cast("string")

    def shown(x: Column) -> Column:
        value = F.when(x["field"].isin(*_JSON), F.try_parse_json(x["value"])).otherwise(x["value"].cast("variant"))
        return F.struct(x["field"].alias("field"), value.alias("value"), x["source_id"].alias("source"), x["method"].alias("method"), x["confidence"].alias("confidence"))

    parts = []
    for f in PROVENANCE:
        missing = F.array(F.struct(F.lit(f).alias("field"), none.cast("variant").alias("value"), none.alias("source"), F.lit(NOT_FOUND).alias("method"), F.lit(0.0).alias("confidence")))
        had = F.col(f"`t_{f}`")
        if f == "skills":  # unknown ones stand among the known
            strays = F.coalesce(F.col("t_unknown_skills"), F.filter(had, lambda x: F.lit(False)))
            every = F.when(had.isNull(), F.concat(missing, F.coalesce(F.transform(F.col("t_unknown_skills"), shown), F.slice(missing, 1, 0)))).otherwise(F.transform(F.array_sort(F.concat(had, strays)), shown))
            parts.append(every)
        else:
            parts.append(F.coalesce(F.transform(had, shown), missing))
    return F.concat(*parts)
