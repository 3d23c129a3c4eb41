"""Resumes: sections, entries and places of texts, and the text of DOCX and PDF files."""

import zipfile
import zlib

import pytest

from meldspark import runs
from meldspark.sources import documents, resumes
from meldspark.sources.readers import read_resume, route

TEXT = """
Ann Lee
ann@x.org | +1 415-555-2671 | Oslo, Norway
Long, sentences, with commas that go on and on are no place
EXPERIENCE
a line before any entry
Acme - Engineer - Lead
2019 - Present
- Built x
\t* and y
Beta — Intern
Mar 2017 – 2018
May 2017 - 2019
Education
GPA: 4.0
- State College, a bullet
Oslo University, 2012
M.Sc. in Physics, 2014
Northern Institute
Western School 2001
PROJECTS
Late University
Experience
Gamma - Chief
Skills
Backend: Java, Go
Other: , 1 2 3, x:y: Rust
"""
CONFIG = {"include_provenance": False, "include_confidence": False, "fields": [{"name": "n", "from": "full_name"}, {"name": "s", "from": "education[].institution"}]}


def parsed(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    return {r.source_id: r for r in resumes.parse(docs).collect()}


def test_fields(spark):
    r = parsed(spark, TEXT)[0]
    assert (r.full_name, r.email, r.phone, r.place, r.headline) == ("Ann Lee", "ann@x.org", "+1 415-555-2671", "Oslo, Norway", "Engineer - Lead")
    assert [tuple(e) for e in r.experience] == [("Acme", "Engineer - Lead", "2019", "Present", "Built x and y"), ("Beta", "Intern", "May 2017", "2019", None), ("Gamma", "Chief", None, None, None)]
    assert [tuple(e) for e in r.education] == [("Oslo University, 2012", "M.Sc.", "Physics", 2012), ("Northern Institute", None, None, None), ("Western School 2001", None, None, 2001)]
    assert r.skills == ["Java", "Go", "Rust"]


def test_odd_texts(spark):
    got = parsed(spark, None, "", " \n\t", "SKILLS\n\nSUMMARY\nknows py", f"Bo\nhttps://github.com/seen.\n{documents.LINKS}\nhttps://linkedin.com/in/bo", "x " * 100_000)
    for i in (0, 1, 2):
        assert got[i].full_name is None and got[i].experience is None and not got[i].skills
    assert got[3].full_name == "knows py" and got[3].skills == ["py"]  # an empty section is none
    assert (got[4].github, got[4].linkedin) == ("https://github.com/seen", "https://linkedin.com/in/bo")
    assert got[5].place is None
    assert parsed(spark, *[]) == {}


def test_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    lines = "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in ("Cy Doe", "EDUCATION", "Bay College"))
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{lines}</w:body></w:document>")
    drawn = zlib.compress(rb"BT /F1 12 Tf 72 700 Td (Di \(D\) ) Tj [(R) 20 (oe)] TJ 0 -14 Td (EDUCATION) Tj 0 -14 Td <44616c65> Tj ( College) Tj ET")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4\n1 0 obj <</Filter /FlateDecode>>\nstream\n" + drawn + b"\nendstream\nendobj\n2 0 obj <</A <</URI (https://github.com/di)>>>> endobj")
    (tmp_path / "broken.pdf").write_bytes(b"%PDF nothing")
    (tmp_path / "broken.docx").write_bytes(b"PK")
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    refs = [(f"{tmp_path}/{n}", None if n[-1] != "t" else "resume") for n in ("a.docx", "b.pdf", "broken.pdf", "broken.docx", "latin.txt")]
    assert [route(p, k) for p, k in refs] == ["resume"] * 5
    result = runs.run(spark, refs, CONFIG)
    assert sorted(r.profile for r in result.profiles.collect()) == ['{"n":"Cy Doe","s":["Bay College"]}', '{"n":"Di (D) Roe","s":["Dale College"]}']
    assert sorted(r.source.rsplit("/", 1)[1] for r in result.errors.collect()) == ["broken.docx", "broken.pdf", "latin.txt"]
    assert read_resume(spark, f"{tmp_path}/b.pdf").first().links.github == "https://github.com/di"
    with pytest.raises(ValueError):
        documents.pdf_text(b"text")


def test_numbers_of_made_universities_are_no_years(spark, tmp_path):
    from meldspark.queries import resume_records_query

    keys = (1903, 1950, 2015, 2100)
    spark.createDataFrame([(k, f"Supplier {k}", 1, 0.0) for k in keys], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.source_id: r.schools for r in resume_records_query(spark, str(tmp_path)).collect()}
    assert got == {f"r{k}": f"University {k}" + ("|B.Sc.|Physics|2014" if k % 3 == 0 else "") for k in keys}
