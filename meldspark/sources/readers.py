"""Readers: each source becomes records of one shape.

A record has record_id, source_id, source_type, ordinal (its place in the input), full_name, emails,
phones, location, links, headline, years_experience, skills, experience, education and a map of
extraction methods. Every reader has a function of a path, and one of what the files hold.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.scalar import clean, find_emails, find_link, find_phones
from ..functions.vocabulary import load, mentions
from ..operators.fusion import SOURCES
from . import resumes

ENTRY = "struct<company:string,title:string,start:string,end:string,summary:string>"
SCHOOL = "struct<institution:string,degree:string,field:string,end_year:int>"
TYPES = {
    "full_name": "string", "emails": "array<string>", "phones": "array<string>", "location": "struct<city:string,region:string,country:string>",
    "links": "struct<linkedin:string,github:string,portfolio:string,other:array<string>>", "headline": "string", "years_experience": "double", "skills": "array<string>",
    "experience": f"array<{ENTRY}>", "education": f"array<{SCHOOL}>",
}
#: Phrases that look like a name in notes.
NOT_NAMES = ("call notes", "tech lead", "good culture", "culture fit")


def numbered(scan: DataFrame) -> DataFrame:
    """A file scan with source_id (the file), ordinal (the row's place in the input: files in order of
    their names, rows as they stand) and row (its place in the file), both from 0.

    The numbers do not depend on how files are split or dealt among tasks: one pass counts the rows of
    each split, sums over them give where each begins, and these are joined back."""
    rows = scan.select("*", F.input_file_name().alias("source_id"), F.col("_metadata.file_block_start").alias("__split"), F.monotonically_increasing_id().alias("__id"))
    splits = rows.groupBy("source_id", "__split").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))  # a row for each
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("source_id", "__split", "__first", before(Window.orderBy("source_id", "__split")).alias("__all"), before(Window.partitionBy("source_id").orderBy("__split")).alias("__own"))
    placed = rows.join(splits, ["source_id", "__split"])
    at = F.col("__id") - F.col("__first")
    return placed.select(*scan.columns, "source_id", (at + F.col("__all")).alias("ordinal"), (at + F.col("__own")).alias("row"))


def _records(df: DataFrame, source_type: str, source_id: Column, methods: dict[str, str | Column], **fields: Column) -> DataFrame:
    cols = [F.coalesce(fields[n], F.lit(None)).cast(t).alias(n) if n in fields else F.lit(None).cast(t).alias(n) for n, t in TYPES.items()]
    method = F.create_map(*[x if isinstance(x, Column) else F.lit(x) for kv in methods.items() for x in kv]) if methods else F.lit(None).cast("map<string,string>")
    ordinal = F.col("ordinal") if "ordinal" in df.columns else F.monotonically_increasing_id()
    out = df.select(source_id.alias("source_id"), F.lit(source_type).alias("source_type"), ordinal.alias("ordinal"), *cols, method.alias("methods"))
    return out.select(F.xxhash64("source_type", "source_id", "ordinal").alias("record_id"), "*")


def _one(c: Column) -> Column:
    return F.when(c.isNotNull(), F.array(c))


def _entry(company: Column, title: Column) -> Column:
    none = F.lit(None).cast("string")
    one = F.struct(company.alias("company"), title.alias("title"), none.alias("start"), none.alias("end"), none.alias("summary"))
    return F.when(company.isNotNull() | title.isNotNull(), F.array(one))


_BAD_ROW = "__malformed"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows, all columns as text; ``_BAD_ROW`` is the row itself where it is not as wide as the header."""
    scan = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    columns = ", ".join(f"`{c.replace('`', '``')}` string" for c in [*scan.csv(path).columns, _BAD_ROW])
    return numbered(scan.schema(columns).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _BAD_ROW).option("columnPruning", False).csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns name, email, phone, current_company, title by exact name; missing ones are null. A row
    that is too short, or too long, is a record of what it has (see ``csv_faults``)."""
    df = _csv(spark, path)
    col = lambda n: clean(F.col(f"`{n}`")) if n in df.columns else F.lit(None).cast("string")
    names = {"full_name": col("name"), "emails": _one(col("email")), "phones": _one(col("phone")), "headline": col("title"), "experience": _entry(col("current_company"), col("title"))}
    return _records(df, "recruiter_csv", F.col("source_id"), dict.fromkeys(names, "csv_column"), **names)


def csv_faults(spark: SparkSession, path: str) -> DataFrame:
    """Errors ``(source, stage, error)`` of rows that are not as wide as the header, be it that fields
    are missing, that there are more, or that a quote is left open. Rows count from 1."""
    rows = _csv(spark, path)
    bad = rows.where(F.col(_BAD_ROW).isNotNull() & F.coalesce(*[F.col(f"`{c}`").isNotNull() for c in rows.columns]))  # Spark does not read that column alone
    return bad.select(F.col("source_id").alias("source"), F.lit("extract").alias("stage"), F.format_string("row %d is not as wide as the header: %s", F.col("row") + 1, F.substring(_BAD_ROW, 1, 100)).alias("error"))


def _json(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, v, ordinal): each file's JSON value, null where malformed."""
    return numbered(spark.read.text(path, wholetext=True)).select("source_id", F.try_parse_json("value").alias("v"), "ordinal")


def _objects(df: DataFrame) -> DataFrame:
    return df.where("v is not null")


def _text(v: Column, key: str) -> Column:
    return clean(F.try_variant_get(v, f"$.{key}", "string"))


def _array(v: Column, key: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", f"array<{kind}>")


def read_ats(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object, or an array of them, with the fixed keys of an applicant tracking export."""
    return ats_records(_json(spark, path))


def _method(o: Column, *keys: str) -> Column:
    """The keys, of those that the object has, as a method."""
    has = F.array(*[F.when(F.try_variant_get(o, f"$.{k}", "string").isNotNull(), F.lit(k)) for k in keys])
    return F.concat(F.lit("ats_field:"), F.nullif(F.array_join(has, "+"), F.lit("")))


def ats_records(df: DataFrame) -> DataFrame:
    """``(source_id, v)`` to records, one for each object."""
    place = ["ordinal"] if "ordinal" in df.columns else []
    many = df.select("source_id", *place, F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "o")).select(F.concat("source_id", F.lit("#"), F.col("i").cast("string")).alias("source_id"), "o", *[(F.shiftleft(p, 31) + F.col("i")).alias(p) for p in place])
    one = df.where(F.try_variant_get("v", "$", "array<variant>").isNull() & F.col("v").isNotNull()).select("source_id", F.col("v").alias("o"), *[F.shiftleft(p, 31).alias(p) for p in place])
    df, o = many.unionByName(one), F.col("o")
    city, region, country = _text(o, "city"), F.coalesce(_text(o, "state"), _text(o, "region")), _text(o, "country")
    place = F.when(F.coalesce(city, region, country).isNotNull(), F.struct(city.alias("city"), region.alias("region"), country.alias("country")))
    methods = {"full_name": ("candidateName",), "emails": ("emailAddress",), "phones": ("phoneNumber",), "headline": ("jobTitle",), "years_experience": ("yrsExp",), "skills": ("skillList",), "experience": ("currentEmployer", "jobTitle"), "location": ("city", "region", "state", "country")}
    methods = {k: _method(o, *keys) for k, keys in methods.items()}
    return _records(df, "ats_json", F.col("source_id"), methods, full_name=_text(o, "candidateName"), emails=_one(_text(o, "emailAddress")), phones=_one(_text(o, "phoneNumber")), headline=_text(o, "jobTitle"), years_experience=F.try_variant_get(o, "$.yrsExp", "double"), skills=F.coalesce(_array(o, "skillList", "string"), _one(_text(o, "skillList"))), experience=_entry(_text(o, "currentEmployer"), _text(o, "jobTitle")), location=place)


def place_of(text: Column) -> Column:
    """"City, Region, Country" by commas; two parts are city and country, one is a city."""
    parts = F.filter(F.transform(F.split(text, ","), clean), lambda x: x.isNotNull())
    none = F.lit(None).cast("string")
    three = F.struct(F.get(parts, F.lit(0)).alias("city"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(1))).otherwise(none).alias("region"), F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).when(F.size(parts) == 2, F.get(parts, F.lit(1))).alias("country"))
    return F.when(F.size(parts) > 0, three)


def _links(linkedin: Column | None = None, github: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    a, b = none if linkedin is None else linkedin, none if github is None else github
    return F.when(F.coalesce(a, b).isNotNull(), F.struct(a.alias("linkedin"), b.alias("github"), none.alias("portfolio"), F.array().cast("array<string>").alias("other")))


def _distinct_words(items: Column) -> Column:
    """Items that differ in more than case, each as it came first."""
    known = lambda out, x: F.exists(out, lambda y: F.lower(y) == F.lower(x))
    return F.aggregate(items, F.array().cast("array<string>"), lambda out, x: F.when(known(out, x), out).otherwise(F.concat(out, F.array(x))))


def read_github(spark: SparkSession, path: str) -> DataFrame:
    return github_records(_json(spark, path))


def github_records(df: DataFrame) -> DataFrame:
    """``(source_id, v)`` to records: a profile each."""
    v = F.col("v")
    login = _text(v, "login")
    url = F.coalesce(_text(v, "html_url"), F.concat(F.lit("https://github.com/"), login))
    spoken = F.concat(F.coalesce(_array(v, "languages", "string"), F.array().cast("array<string>")), F.coalesce(F.transform(F.coalesce(_array(v, "repositories", "variant"), _array(v, "repos", "variant")), lambda r: _text(r, "language")), F.array().cast("array<string>")))
    methods = {"full_name": "github_profile_name", "headline": "github_profile_bio", "location": "github_profile_location", "emails": "github_profile_email", "skills": "github_repo_languages", "links": "github_profile_url"}
    return _records(_objects(df), "github", F.col("source_id"), methods, full_name=_text(v, "name"), headline=_text(v, "bio"), location=place_of(_text(v, "location")), emails=_one(_text(v, "email")), skills=_distinct_words(F.filter(F.transform(spoken, clean), lambda x: x.isNotNull())), links=_links(github=url))


def read_linkedin(spark: SparkSession, path: str) -> DataFrame:
    return linkedin_records(_json(spark, path))


def linkedin_records(df: DataFrame) -> DataFrame:
    """``(source_id, v)`` to records: a profile each."""
    v = F.col("v")
    jobs = F.transform(_array(v, "experience", "variant"), lambda e: F.struct(_text(e, "company").alias("company"), _text(e, "title").alias("title"), _text(e, "start").alias("start"), _text(e, "end").alias("end"), F.coalesce(_text(e, "summary"), _text(e, "description")).alias("summary")))
    jobs = F.filter(jobs, lambda e: F.coalesce(*[e[k] for k in ("company", "title", "start", "end", "summary")]).isNotNull())
    schools = F.transform(_array(v, "education", "variant"), lambda e: F.struct(_text(e, "institution").alias("institution"), _text(e, "degree").alias("degree"), _text(e, "field").alias("field"), F.expr("cast(null as int)").alias("x"), F.try_variant_get(e, "$.end_year", "int").alias("end_year")))
    schools = F.transform(schools, lambda e: F.struct(e["institution"].alias("institution"), e["degree"].alias("degree"), e["field"].alias("field"), e["end_year"].alias("end_year")))
    schools = F.filter(schools, lambda e: F.coalesce(e["institution"], e["degree"], e["field"], e["end_year"].cast("string")).isNotNull())
    methods = {k: f"linkedin_profile_{m}" for k, m in {"full_name": "name", "headline": "headline", "location": "location", "skills": "skills", "experience": "experience", "education": "education", "links": "url", "emails": "email"}.items()}
    return _records(_objects(df), "linkedin", F.col("source_id"), methods, full_name=_text(v, "name"), headline=_text(v, "headline"), location=place_of(_text(v, "location")), emails=_one(_text(v, "email")), skills=F.filter(F.transform(_array(v, "skills", "string"), clean), lambda x: x.isNotNull()), experience=jobs, education=schools, links=_links(linkedin=_text(v, "profile_url")))


def read_notes(spark: SparkSession, path: str, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    return notes_records(numbered(spark.read.text(path, wholetext=True)), vocabulary)


def notes_records(df: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """``(source_id, value)`` to records, one a text: first name, email and phone, and all mentions
    of the vocabulary."""
    t = F.col("value")
    runs = F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"), 1)
    name = F.get(F.filter(runs, lambda x: ~F.lower(x).isin(*NOT_NAMES)), F.lit(0))
    methods = {"full_name": "regex_name", "emails": "regex_email", "phones": "regex_phone", "skills": "regex_skill"}
    return _records(df, "recruiter_notes", F.col("source_id"), methods, full_name=name, emails=_one(F.get(find_emails(t), F.lit(0))), phones=_one(F.get(find_phones(t), F.lit(0))), skills=mentions(t, vocabulary or load()))


def read_resume(spark: SparkSession, path: str, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """One record a text, DOCX or PDF resume; unreadable files have none (see ``resumes.faults``)."""
    return resume_records(resumes.texts(spark, path), vocabulary)


def resume_records(df: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """``(source_id, text)`` to records, one a text that is not null."""
    df = resumes.parse(df.where("text is not null"), vocabulary).withColumn("ordinal", F.lit(0).cast("long"))  # a record per source
    col = F.col
    fields = {k: col(k) for k in ("full_name", "headline", "skills", "experience", "education")}
    return _records(df, "resume", col("source_id"), resumes.METHODS, emails=_one(col("email")), phones=_one(col("phone")), location=place_of(col("place")), links=_links(col("linkedin"), col("github")), **fields)


#: What the error texts call a source of plain text (fixed values).
TEXT_SOURCES = {"recruiter_csv": "recruiter CSV", "recruiter_notes": "recruiter notes"}


def text_faults(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Errors ``(source, stage, error)`` of files that are not UTF-8, line by line at any size."""
    bad = spark.read.text(path).select(F.input_file_name().alias("source"), "value").where(~F.is_valid_utf8("value")).select("source").distinct()
    return bad.select("source", F.lit("ingest").alias("stage"), F.format_string(f"failed to read {TEXT_SOURCES[kind]} '%s': not valid UTF-8", "source").alias("error"))


@dataclass(frozen=True)
class Adapter:
    """A kind of source: a function of session and path to records, and which locations it takes, as a
    pattern or a function of a location in lower case."""

    kind: str
    read: Callable[[SparkSession, str], DataFrame]
    fits: str | Callable[[str], bool]
    priority: int | None = None

    def takes(self, location: str) -> bool:
        return re.search(self.fits, location.lower()) is not None if isinstance(self.fits, str) else self.fits(location.lower())

    def taken(self, location: Column) -> Column:
        """``takes`` for a column of locations."""
        if isinstance(self.fits, str):
            return F.lower(location).rlike(self.fits)
        fits = self.fits
        return F.pandas_udf(lambda c: c.map(lambda x: bool(fits(x)), na_action="ignore").astype(object), BooleanType())(F.lower(location))


class Registry:
    """Adapters in order of priority (by default that of the kind), then of their kinds."""

    def __init__(self, adapters: Iterable[Adapter] = ()) -> None:
        self._adapters: list[Adapter] = []
        for a in adapters:
            self.register(a)

    @property
    def adapters(self) -> list[Adapter]:
        return list(self._adapters)

    def register(self, adapter: Adapter) -> None:
        rank = {k: i for i, k in enumerate(SOURCES)}
        self._adapters.append(adapter)
        self._adapters.sort(key=lambda a: (rank.get(a.kind, len(rank)) if a.priority is None else a.priority, a.kind))

    def resolve(self, location: str, hint: str | None = None) -> Adapter:
        """The first adapter of the hinted kind, or without a hint the first that takes the location."""
        for a in self._adapters:
            if a.kind == hint if hint else a.takes(location):
                return a
        raise ValueError(f"no reader for {hint or location}")

    def kinds(self, location: Column, hint: Column) -> Column:
        """``resolve`` for columns of locations and hints: the kind, null where no adapter will do. Null
        and empty hints are none."""
        hinted = F.coalesce(hint, F.lit("")) != ""
        out = F.lit(None).cast("string")
        for a in reversed(self._adapters):
            out = F.when(F.when(hinted, hint == a.kind).otherwise(a.taken(location)), a.kind).otherwise(out)
        return out


REGISTRY = Registry(
    [
        Adapter("recruiter_csv", read_csv, r"\.csv$"),
        Adapter("ats_json", read_ats, r"\.json$"),
        Adapter("resume", read_resume, r"\.(?:pdf|docx)$"),
        Adapter("linkedin", read_linkedin, r"linkedin\.com"),
        Adapter("github", read_github, r"github\.com"),
        Adapter("recruiter_notes", read_notes, r"\.txt$"),
    ]
)
READERS = {a.kind: a.read for a in REGISTRY.adapters}


def route(location: str, hint: str | None = None) -> str:
    """The kind of a location."""
    return REGISTRY.resolve(location, hint).kind
