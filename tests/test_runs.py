"""Runs and the command line: error isolation, empty sources, several configs, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from meldspark import cli, runs

CONFIG = {"include_provenance": False, "include_confidence": False, "fields": [{"name": "name", "from": "full_name"}, {"name": "mail", "from": "emails[0]", "on_missing": "omit"}]}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.csv").write_text("name,email,phone,current_company,title\nJane Doe,Jane@x.org,,Acme,Engineer\nBob Lee,,,,\n")
    (tmp_path / "head.csv").write_text("name,email,phone,current_company,title\n")
    (tmp_path / "ats.json").write_text(json.dumps([{"candidateName": "Jane D", "emailAddress": "jane@x.org"}, 7]))
    (tmp_path / "bad.json").write_text("{nope")
    (tmp_path / "gh.json").write_text("[1]")
    (tmp_path / "one.json").write_text(json.dumps(CONFIG))
    (tmp_path / "two.json").write_text(json.dumps({**CONFIG, "fields": [{"name": "id", "from": "candidate_id"}]}))
    return tmp_path


def test_errors_are_isolated(spark, files):
    refs = [(f"{files}/{n}", k) for n, k in (("a.csv", None), ("ats.json", None), ("bad.json", None), ("gh.json", "github"), ("gone.txt", None), ("x.zip", None))]
    result = runs.run(spark, refs, CONFIG)
    errors = sorted((r.source.rsplit("/", 1)[-1], r.stage, r.error.split(" ")[0]) for r in result.errors.collect())
    assert errors == [("ats.json#1", "extract", "Expected"), ("bad.json", "ingest", "source"), ("gh.json", "extract", "Expected"), ("gone.txt", "ingest", "failed"), ("x.zip", "ingest", "No")]
    assert result.exit_code == 1
    got = sorted(r.profile for r in result.profiles.collect())
    assert got.count('{"name":"Jane Doe","mail":"jane@x.org"}') == 1 and '{"name":"Bob Lee"}' in got
    assert got.count('{"name":null}') == 2  # the two values that are no objects


def test_empty_sources(spark, files):
    head = runs.run(spark, [(f"{files}/head.csv", None)], CONFIG)
    assert [r.profile for r in head.profiles.collect()] == ['{"name":null}'] and head.exit_code == 0
    none = runs.run(spark, [(f"{files}/gone.csv", None)], CONFIG)
    assert [tuple(r)[:2] for r in none.profiles.collect()] == [(None, '{"name":null}')] and none.exit_code == 1


def test_command_line(spark, files, capsys):
    out = files / "out.json"
    assert cli.main(["--input", f"recruiter_csv={files}/a.csv", "--config", f"{files}/one.json", "--output", str(out)], spark) == 0
    assert {"name": "Jane Doe", "mail": "jane@x.org"} in json.loads(out.read_text())
    assert cli.main(["--input", f"{files}/a.csv", "--input", f"{files}/gone.csv", "--config", f"{files}/one.json", "--config", f"{files}/two.json"], spark) == 1
    text = capsys.readouterr()
    assert set(json.loads(text.out)) == {"one.json", "two.json"} and text.err.count("error_report: ") == 1
    assert cli.main(["--input", f"{files}/a.csv", "--config", f"{files}/one.json", "--write", f"{files}/big"], spark) == 0
    assert len(spark.read.text(f"{files}/big/config=one.json").collect()) == 2
    assert cli.main(["--input", "x"], spark) == 2 and cli.main(["--input", "x", "--config", f"{files}/bad.json"], spark) == 2


@pytest.mark.parametrize("bad", [[], {"fields": 1}, {"on_missing": "x"}, {"fields": [{"name": "a..b"}]}, {"fields": [{}]}])
def test_wrong_configs(bad):
    with pytest.raises(ValueError):
        runs.check_config(bad)


def test_ordinals_do_not_depend_on_splits(spark, tmp_path):
    from meldspark.sources.readers import numbered

    lines = [f"{i:05d}" + "x" * (i % 37) for i in range(3000)]
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("\n".join(lines[k * 1000 : (k + 1) * 1000]) + "\n")
    for size in ("1k", "7k", "128m"):
        session = spark.newSession()
        session.conf.set("spark.sql.files.maxPartitionBytes", size)
        session.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {r.value: (r.ordinal, r.row, r.source_id[-5]) for r in numbered(session.read.text(str(tmp_path))).collect()}
        assert got == {v: (i, i % 1000, str(i // 1000)) for i, v in enumerate(lines)}
    assert numbered(spark.read.text(f"{tmp_path}/0.txt").limit(0)).collect() == []


def test_rows_of_another_width(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,email,phone\nAnn,a@x,1\nBob,b@x\nCid,c@x,3,more\n"Dan ""D""",d@x,4\n"Two\nlines",m@x,5\nEve,"open,6\nFay,f@x,7\n')
    refs = [(f"{tmp_path}/a.csv", None)]
    records, errors = runs.read_sources(spark, refs)
    assert errors.isEmpty()
    assert [(r.full_name, r.emails) for r in records.orderBy("ordinal").collect()] == [("Ann", ["a@x"]), ("Bob", ["b@x"]), ("Cid", ["c@x"]), ('Dan "D"', ["d@x"]), ("Two\nlines", ["m@x"]), ("Eve", ["open,6\nFay,f@x,7"])]
    _, errors = runs.read_sources(spark, refs, strict=True)
    assert sorted((r.stage, r.error) for r in errors.collect()) == [("extract", f"row {n} is not as wide as the header: {t}") for n, t in ((2, "Bob,b@x"), (3, "Cid,c@x,3,more"), (6, 'Eve,"open,6\nFay,f@x,7'))]


def test_one_file_twice_is_two_records(spark, files):
    records, _ = runs.read_sources(spark, [(f"{files}/a.csv", None)] * 2)
    assert records.select("record_id").distinct().count() == 4
    assert [r.full_name for r in records.orderBy("ordinal").collect()] == ["Jane Doe", "Bob Lee"] * 2


def test_routing_of_a_table(spark):
    from meldspark.sources import readers

    registry = readers.Registry([*readers.REGISTRY.adapters, readers.Adapter("odd", readers.read_notes, lambda x: x.startswith("odd"), 0)])
    refs = [("a/B.CSV", None), ("https://github.com/x.json", None), ("cv.PDF", ""), ("odd.csv", None), ("n.txt", "resume"), ("x.zip", None), ("a.csv", "nothing"), (None, None), (None, "github")]

    def kind(location, hint):
        try:
            return registry.resolve(location or "", hint).kind
        except ValueError:
            return None

    got = spark.createDataFrame([(i, *r) for i, r in enumerate(refs)], "i int, l string, h string").withColumn("k", registry.kinds(F.col("l"), F.col("h"))).orderBy("i").collect()
    assert [r.k for r in got] == [kind(*r) for r in refs]


def test_profiles_stand_in_order_however_they_are_dealt(spark, tmp_path):
    from meldspark.sinks import write_profiles
    from meldspark.sources.readers import numbered

    people = spark.range(20_000).select("id", F.struct(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("o")).alias("__order"), F.lit(1).alias("x"))
    config = {"include_provenance": False, "include_confidence": False, "fields": [{"name": "id", "from": "id"}]}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_profiles(people, {"a": config, "b": config}, f"{tmp_path}/out", "id")
        lines = numbered(spark.read.text(f"{tmp_path}/out")).orderBy("ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [f'{{"id":{i}}}' for i in sorted(range(20_000), key=lambda i: i * 7919 % 20_000)]
    assert [r.value for r in lines if r.config == "a"] == want == [r.value for r in lines if r.config == "b"]
