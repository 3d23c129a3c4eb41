"""Resume reader: lines as rows, sections by carrying the last heading forward, and entries by
counting the lines that open one. All windows and groups are by document, so one shuffle serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import clean, find_emails, find_link, find_phones
from ..functions.vocabulary import load, mentions
from .documents import LINKS, document_text

#: Headings with their sections, headings that end the education section, words of
#: institutions and degrees, beginnings of marks, bullets, and the methods named in provenance.
HEADINGS = {
    "summary": "summary", "professional summary": "summary", "profile": "summary", "objective": "summary",
    "experience": "experience", "work experience": "experience", "professional experience": "experience", "employment": "experience",
    "education": "education",
    "skills": "skills", "technical skills": "skills", "core skills": "skills",
}
NOT_EDUCATION = (
    "projects", "experience", "work experience", "professional experience", "employment", "skills", "technical skills", "core skills", "certifications",
    "certification", "achievements", "awards", "publications", "activities", "interests", "languages", "hobbies", "summary", "professional summary", "profile",
    "objective", "contact",
)
INSTITUTIONS = ("university", "institute", "college", "school", "academy", "polytechnic")
DEGREES = ("b.e", "b.tech", "b.s", "b.sc", "b.a", "bachelor", "m.e", "m.tech", "m.s", "m.sc", "m.a", "master", "ph.d", "phd", "mba", "diploma", "associate")
MARKS = ("gpa", "cgpa", "score", "percentage", "grade")
BULLETS = "-*•●▪"
METHODS = {
    "full_name": "resume_text_name", "emails": "regex_email", "phones": "regex_phone", "links": "regex_profile_links", "location": "resume_contact_line",
    "skills": "pdf_section_skills", "experience": "resume_section_experience", "education": "resume_section_education", "headline": "resume_section_experience",
}
_DASH = r"(?U)\s+[-–—]\s+"
_POINT = r"(?:(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}|\d{4}|present|current)"
_SPAN = rf"(?iU)^({_POINT})\s+[-–—]\s+({_POINT})$"
_YEAR = r"\b(?:19|20)\d{2}\b"
DOC = "source_id"


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``(source_id, text, error)``: each file's text, or why it has none. Only DOCX and PDF
    bytes go through Python."""
    packed = F.lower(F.col(DOC)).rlike(r"\.(pdf|docx)$")
    files = spark.read.format("binaryFile").load(path).select(F.input_file_name().alias(DOC), "content")
    files = files.withColumn("packed", document_text(F.when(packed, F.col("content")), F.col(DOC)))
    plain = F.try_validate_utf8(F.col("content").cast("string"))
    out = files.select(DOC, F.when(packed, F.col("packed.text")).otherwise(plain).alias("text"), F.coalesce("packed.error", F.lit("not UTF-8")).alias("error"))
    return out.withColumn("error", F.when(F.col("text").isNull(), F.col("error")))


def faults(spark: SparkSession, path: str) -> DataFrame:
    """Errors ``(source, stage, error)`` of the files that cannot be read."""
    bad = texts(spark, path).where("text is null")
    return bad.select(F.col(DOC).alias("source"), F.lit("ingest").alias("stage"), F.format_string("failed to read resume '%s': %s", DOC, "error").alias("error"))


def _holds(line: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(line), w))


def _place(lines: Column) -> Column:
    """First short "City, Region, Country" between the separators of the contact lines."""
    bits = F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, "[|•–—]"))), clean)
    pieces = lambda b: F.filter(F.transform(F.split(b, ","), clean), lambda p: p.isNotNull())
    short = lambda b: F.forall(pieces(b), lambda p: F.size(F.split(p, r"(?U)\s+")) <= 3)
    fits = lambda b: b.contains(",") & b.rlike(r"\p{L}") & ~b.rlike(r"@|http|(?i:\.com)") & (F.length(b) <= 40) & short(b)
    return F.get(F.filter(bits, lambda b: F.coalesce(fits(b), F.lit(False))), F.lit(0))


def _skills(lines: Column, text: Column, vocabulary: dict[str, list[str]]) -> Column:
    tokens = F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, ","))), lambda t: clean(F.regexp_replace(clean(t), r"(?s)^.*:", "")))
    listed = F.filter(tokens, lambda t: t.rlike(r"\p{L}"))
    return F.when(F.exists(lines, lambda x: clean(x).isNotNull()), listed).otherwise(mentions(text, vocabulary))


def _experience(lines: DataFrame) -> DataFrame:
    """A line with a spaced dash opens an entry; a span of dates dates it; the rest is its summary."""
    line, here = F.col("line"), Window.partitionBy(DOC).orderBy("no")
    marked = lines.where("section = 'experience' and line is not null").withColumn("span", line.rlike(_SPAN)).withColumn("opens", ~F.col("span") & line.rlike(_DASH))
    marked = marked.withColumn("entry", F.sum(F.col("opens").cast("int")).over(here)).where("entry > 0")
    halves, prose = F.split(line, _DASH, 2), clean(F.regexp_replace(line, r"^[-*• \t]+", ""))
    said = F.collect_list(F.when(~F.col("span") & ~F.col("opens") & prose.isNotNull(), F.struct("no", prose.alias("prose"))))
    one = marked.groupBy(DOC, "entry").agg(
        F.max(F.when(F.col("opens"), F.struct(clean(halves[0]).alias("company"), clean(halves[1]).alias("title")))).alias("head"),
        F.max_by(F.struct(F.regexp_extract(line, _SPAN, 1).alias("start"), F.regexp_extract(line, _SPAN, 2).alias("end")), F.when(F.col("span"), F.col("no"))).alias("dates"),
        F.transform(F.array_sort(said), lambda x: x["prose"]).alias("said"),
    )
    entry = F.struct("entry", "head.company", "head.title", "dates.start", "dates.end", F.when(F.size("said") > 0, F.array_join("said", " ")).alias("summary"))
    jobs = one.groupBy(DOC).agg(F.array_sort(F.collect_list(entry)).alias("jobs"))
    keep = ("company", "title", "start", "end", "summary")
    return jobs.select(DOC, F.transform("jobs", lambda j: F.struct(*[j[k].alias(k) for k in keep])).alias("experience"))


def _education(lines: DataFrame) -> DataFrame:
    """Lines that name an institution, each with the degree of the line below, up to another heading."""
    line, here = F.col("line"), Window.partitionBy(DOC).orderBy("no")
    low = F.lower(line)
    own = lines.where("section = 'education' and line is not null")
    own = own.withColumn("ended", F.max(low.isin(*NOT_EDUCATION)).over(here)).where("not ended")
    own = own.where(~F.substring(line, 1, 1).isin(*BULLETS) & ~low.rlike(f"^(?:{'|'.join(MARKS)})"))
    own = own.withColumn("below", F.lead("line").over(here)).where(_holds(line, INSTITUTIONS))
    below = F.col("below")
    detail = F.when(~_holds(below, INSTITUTIONS) & (_holds(below, DEGREES) | F.lower(below).contains(" in ")), below)
    year = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit(_YEAR), 0), F.lit(-1)).cast("int")
    bare = lambda c: clean(F.regexp_replace(clean(c), ",+$", ""))
    halves = F.split(bare(F.regexp_replace(detail, _YEAR, "")), " in ", 2)
    degree = clean(halves[0])
    found = F.struct("no", line.alias("institution"), degree.alias("degree"), bare(F.get(halves, F.lit(1))).alias("field"), F.coalesce(year(line), year(detail)).alias("end_year"))
    schools = own.groupBy(DOC).agg(F.array_sort(F.collect_list(found)).alias("schools"))
    keep = ("institution", "degree", "field", "end_year")
    return schools.select(DOC, F.transform("schools", lambda s: F.struct(*[s[k].alias(k) for k in keep])).alias("education"))


def parse(docs: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """``(source_id, text)`` to one row a document with the fields of a record.

    Null and empty texts have null fields; unknown headings belong to the section before them.
    Texts with the same source_id are taken as one document, in undefined order."""
    head = F.substring_index("text", LINKS, 1)
    docs = docs.select(DOC, head.alias("seen"), F.replace(F.col("text"), F.lit(LINKS), F.lit("\n")).alias("all"))
    lines = docs.select(DOC, F.posexplode(F.split("seen", r"\R|[\x1c-\x1e]")).alias("no", "line")).withColumn("line", clean("line"))
    known = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])
    lines = lines.withColumn("heading", F.try_element_at(known, F.lower("line")))
    lines = lines.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(Window.partitionBy(DOC).orderBy("no")), F.lit("_header"))).where("heading is null")
    part = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == name, F.struct("no", "line")))), lambda x: x["line"])
    some = lines.where("line is not null").groupBy(DOC).agg(F.min_by("line", "no").alias("full_name"), part("_header").alias("top"), part("skills").alias("listed"))
    out = docs.join(some, DOC, "left").join(_experience(lines), DOC, "left").join(_education(lines), DOC, "left")
    none = F.array().cast("array<string>")
    linkedin, github = find_link(F.col("all"), "linkedin.com/in"), find_link(F.col("all"), "github.com")
    return out.select(
        DOC, "full_name", F.get(find_emails(F.col("all")), F.lit(0)).alias("email"), F.get(find_phones(F.col("seen")), F.lit(0)).alias("phone"), _place(F.coalesce("top", none)).alias("place"),
        linkedin.alias("linkedin"), github.alias("github"), F.get("experience", F.lit(0))["title"].alias("headline"), "experience", "education",
        _skills(F.coalesce("listed", none), F.coalesce("seen", F.lit("")), vocabulary or load()).alias("skills"),
    )
