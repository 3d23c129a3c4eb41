"""The fusion engine: fixed cases, brute force, and the queries against DuckDB."""

import random
import uuid
import json
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from meldspark import queries
from meldspark.functions import scalar, vocabulary
from meldspark.operators import identity
from meldspark.plans.projection import parse_path, project

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    near = lambda r: str(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    got = [near(r) for r in df.select(*want.columns).collect()]
    assert Counter(got) == Counter(map(near, want.fetchall()))
    assert got


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
@settings(deadline=None)
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert scalar.lcs(a, b) == t[-1][-1]


def test_close_names_lose_no_pair(spark):
    rnd = random.Random(0)
    names = set()
    for _ in range(60):
        base = "".join(rnd.choices("abcde ", k=rnd.randint(1, 24)))
        names.add(base)
        for _ in range(3):
            w = list(base)
            for _ in range(rnd.randint(1, 3)):
                i = rnd.randrange(len(w) + 1)
                w[i : i + rnd.randint(0, 1)] = rnd.choices("abcde ", k=rnd.randint(0, 1))
            names.add("".join(w))
    names = sorted(n for n in names if n)
    want = {(x, y) for x in names for y in names if x != y and 200 * scalar.lcs(x, y) > 90 * (len(x) + len(y))}
    got = {tuple(r) for r in identity.close_names(*[spark.createDataFrame([(n,) for n in names], "name string")] * 2).collect()}
    assert got == want and want


def groups_by_pairs(rows):
    """Groups by definition, record by record."""
    parent = {r[0]: r[0] for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, e, p, n in rows:
        for j, f, q, m in rows:
            if i < j:
                apart = (e and f) or (p and q)
                if set(e) & set(f) or set(p) & set(q) or (n and m and not apart and 200 * scalar.lcs(n, m) > 90 * (len(n) + len(m))):
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("kinds", ["none", "any", "apart"])
def test_names_by_stars_give_the_groups_of_pairs(spark, monkeypatch, kinds):
    monkeypatch.setattr(identity, "PART", 5)  # common q-grams in several parts
    rnd = random.Random(len(kinds))
    heads = ["", "person 0000", "senior consultant number 00", "a much longer name that is shared by all of these people 0"]
    rows = []
    for i in range(260):
        kind = {"none": "", "any": rnd.choice(["", "e", "e", "p", "p", "ep"]), "apart": rnd.choice(["e", "p", "ep"])}[kinds]
        name = rnd.choice(heads) + rnd.choice([str(rnd.randrange(400)), "".join(rnd.choices("abcdefgh ", k=rnd.randint(1, 14)))]) if rnd.random() < 0.95 else rnd.choice([None, "twin", heads[3]])
        rows.append((i, [f"u{rnd.choice([i, i % 40])}"] * ("e" in kind), [f"t{i}"] * ("p" in kind), name))
    df = spark.createDataFrame(rows, "record_id long, emails array<string>, phones array<string>, name string")
    want = groups_by_pairs(rows)
    assert {r.record_id: r.group_id for r in identity.resolve(df).collect()} == want
    assert len(set(want.values())) < len(rows) - 20


def test_names_with_a_shared_prefix_make_few_rows(spark):
    """The keys of a name are as many as its characters, whatever it shares with the others."""
    groups = spark.range(3000).select(F.format_string("person %06d", "id").alias("name"), F.lit("").alias("kind"), F.col("id").alias("least"))
    assert identity.name_links(groups).count() <= 14 * 3000


def test_identity_rules(spark):
    rows = [
        (1, ["a@x"], [], "john smith"), (2, ["a@x"], ["+1"], "other"), (3, [], ["+1"], None),
        (4, [], [], "john smith"), (5, ["b@x"], [], "jon smith"), (6, ["c@x"], [], "mary jones"), (7, [], ["+2"], "mary jones"), (8, ["d@x"], ["+3"], "mary jones"), (9, [], [], None),
    ]
    df = spark.createDataFrame(rows, "record_id long, emails array<string>, phones array<string>, name string")
    got = {r.record_id: r.group_id for r in identity.resolve(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 8: 8, 9: 9}
    ids = {r.record_id: r.candidate_id for r in identity.resolve(df).collect()}
    assert ids[1] == str(uuid.uuid5(uuid.UUID(scalar.ID_NAMESPACE), "email:a@x"))


def test_normalizers(spark):
    df = spark.createDataFrame([("+1 (415) 555-2671", "March 2019", " A@B.co "), ("+44 20 7946 0000", "2019", "n/a"), ("415-555-9000", "13/2019", "\t"), ("+1 999", "2019-03-12", None), (None, "2019, sept", "a@b")], "p string, d string, e string")
    got = df.select(scalar.normalize_phone(df.p).alias("p"), scalar.normalize_date(df.d).alias("d"), scalar.normalize_email(df.e).alias("e")).collect()
    assert [tuple(r.p) for r in got] == [("+14155552671", 1.0), ("+442079460000", 1.0), (None, 0.0), (None, 0.0), (None, 0.0)]
    assert [tuple(r.d) for r in got] == [("2019-03", 1.0), ("2019-01", 0.6), (None, 0.0), ("2019-03", 1.0), ("2019-09", 1.0)]
    assert [tuple(r.e) for r in got] == [("a@b.co", 1.0), ("n/a", 0.7), (None, 0.0), (None, 0.0), ("a@b", 0.7)]
    land = {r.c: r.x.value for r in scalar.with_country(spark.createDataFrame([("us",), ("GBR",), ("India",), ("Nowhere",), (None,)], "c string"), "c", "x").collect()}
    assert land == {"us": "US", "GBR": "GB", "India": "IN", "Nowhere": None, None: None}


def test_terms(spark):
    df = spark.createDataFrame([("py",), ("PYTHON",), ("kubernets",), ("wizardry",), ("  ",), (None,)], "t string")
    got = {r.t: (r.name, r.quality) for r in vocabulary.match_terms(df, "t", vocabulary.SKILLS).collect()}
    assert got["py"] == ("Python", 0.8) and got["PYTHON"] == ("Python", 1.0) and got["kubernets"] == ("Kubernetes", 0.6)
    assert got["wizardry"] == got["  "] == got[None] == (None, None)
    text = spark.createDataFrame([("Strong on py and JS, C++ too; Golang-ish, Node.js",)], "t string")
    assert text.select(vocabulary.mentions(text.t, vocabulary.SKILLS).alias("m")).first().m[:3] == ["py", "JS", "C++"]


def test_terms_by_brute_force(spark):
    rnd = random.Random(4)
    letters = "abcde "
    word = lambda k: "".join(rnd.choices(letters, k=k)).strip() or "x"
    names = sorted({word(rnd.choice([2, 4, 6, 9, 14, 20, 33, 45])) for _ in range(80)} | {"same name", "sane name"})
    given = {n: [word(8)] for n in names}

    def edited(f):
        w = list(f)
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choices(letters, k=rnd.randint(0, 1))
        return "".join(w)

    terms = sorted({edited(rnd.choice(names)) for _ in range(300)} | {"safe name"})
    table = {}
    for n, al in sorted(given.items()):
        for tier, f in [(0, n), *((1, a) for a in al)]:
            table[f.lower()] = min(table.get(f.lower(), (9, "")), (tier, n))
    want = {}
    for t in terms:
        key = " ".join(t.split()).lower()
        if not key:
            want[t] = None
        elif key in table:
            want[t] = (table[key][1], (1.0, 0.8)[table[key][0]])
        else:
            close = [(-200 * scalar.lcs(key, f) / (len(key) + len(f)), f) for f in table if min(len(f), len(key)) >= 4]
            best = min([c for c in close if -c[0] >= 90], default=None)
            want[t] = (table[best[1]][1], 0.6) if best else None
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    got = {r.t: (r.name, r.quality) if r.name else None for r in vocabulary.match_terms(df, "t", given).collect()}
    assert got == want and sum(w is not None and w[1] == 0.6 for w in want.values()) > 30


def test_mentions_by_patterns():
    import re

    rnd = random.Random(5)
    terms = ("Go", "go", "C", "C++", "c#", ".NET", "Node", "Node.js", "machine learning", "R", "é", "Ünder", "a-b", "")
    bits = ["Go", "GO", "C", "C++", "C#", ".net", "Node", "node.JS", "js", "Machine Learning", "machine", "r", "é", "É", "ünder", "Ünder", "a-B", " ", ".", ",", "+", "#", "x", "9", "日本"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) + rnd.choice(["", " ", " "]) for _ in range(rnd.randint(0, 12)))
        want = {}
        for f in {"".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in terms} - {""}:
            flags = re.ASCII | re.IGNORECASE
            pattern = "".join(re.escape(c) if ord(c) < 128 else f"(?-i:{c})" for c in f)
            if m := re.search(rf"(?<![A-Za-z0-9+#.]){pattern}(?![A-Za-z0-9+#])", text, 0 if not f.isascii() else flags):
                want[f] = (m.start(), m[0])
            if not f.isascii():
                m = re.search(rf"(?<![A-Za-z0-9+#.])(?a:(?i:{pattern}))(?![A-Za-z0-9+#])", text)
                want.pop(f, None)
                if m:
                    want[f] = (m.start(), m[0])
        assert vocabulary.found_mentions(text, terms) == [r for _, r in sorted(want.values())]


def test_paths_and_policies(spark):
    df = spark.createDataFrame([(1, ["x", "Y"], None), (2, [], None)], "id long, tags array<string>, gone string")
    config = {"on_missing": "omit", "fields": [{"name": "a", "from": "tags[0]"}, {"name": "b", "from": "tags[5]", "on_missing": "null"}, {"name": "c", "from": "tags", "normalize": "lowercase"}, {"name": "d", "from": "gone", "required": True, "on_missing": "error"}]}
    profiles, errors = project(df, config, "id")
    assert [r.profile for r in profiles.orderBy("id").collect()] == ['{"a":"x","c":["x","y"]}', '{"b":null,"c":[]}']
    assert Counter((r.id, r.stage) for r in errors.collect()) == {(1, "project"): 2, (1, "validate"): 1, (2, "project"): 1, (2, "validate"): 1}
    for bad in ("a..b", "a[", "a[].b[]", ""):
        with pytest.raises(ValueError):
            parse_path(bad)


def test_canonical_names_and_elements(spark):
    df = spark.createDataFrame([(1, ["py", "kubernets", "wizardry", None], "GOLANG", [("a", 1), None]), (2, None, None, [])], "id long, terms array<string>, term string, items array<struct<k:string,v:int>>")
    fields = [{"name": "terms", "normalize": "canonical", "type": "number[]"}, {"name": "term", "normalize": "canonical"}, {"name": "items", "type": "array", "element_type": {"k": "string", "v": "string", "w": "number"}}, {"name": "rows", "from": "items", "type": "array", "element_type": {"k": "string"}}]
    profiles, errors = project(df, {"fields": fields}, "id")
    got = {r.id: json.loads(r.profile) for r in profiles.collect()}
    assert got[1]["terms"] == ["Python", "Kubernetes", "wizardry", None] and got[1]["term"] == "Go" and got[2]["terms"] is None
    assert sorted(r.error for r in errors.where("stage = 'validate'").collect()) == sorted(
        [f"field 'terms[{i}]': expected element type 'number' but got 'string'" for i in range(3)]
        + ["field 'items[0].v': expected type 'string' but got 'number'", "field 'items[0].w': required object subfield is missing"]
        + [f"field '{n}[1]': expected an object but got 'null'" for n in ("items", "rows")]
    )


def test_checks_of_dynamic_values(spark):
    texts = ['{"k":1.5}', '{"k":"it\'s"}', '{"k":true}', '{"k":[1,"a",null,[2]]}', '{"k":{"a":{"b":null,"c":3},"n":null}}', '{"k":null}', "{}", None, '{"k":[{"a":{"b":1}},7,null]}', "{"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", F.try_parse_json("t").alias("v"))

    def errors(**spec):
        _, found = project(df, {"fields": [{"name": "x", "from": "v.k", **spec}]}, "id")
        return sorted((r.id, r.error.removeprefix("field 'x")) for r in found.collect())

    got = errors(type="string")
    assert got == [(i, f"': expected type 'string' but got '{t}'") for i, t in ((0, "number"), (2, "boolean"), (3, "array"), (4, "object"), (8, "array"))]
    assert errors(type="array", element_type="number")[0] == (0, "': expected type 'array' but got 'number'")
    elements = [e for e in errors(type="number[]") if e[1].startswith("[")]
    assert elements == [(3, "[1]': expected element type 'number' but got 'string'"), (3, "[3]': expected element type 'number' but got 'array'"), (8, "[0]': expected element type 'number' but got 'object'")]
    assert [e for e in errors(type="array", element_type={"a": {"b": "string"}}) if e[0] == 8] == [(8, "[0].a.b': expected type 'string' but got 'number'"), (8, "[1]': expected an object but got 'number'"), (8, "[2]': expected an object but got 'null'")]
    assert [e for e in errors(type="object", element_type={"a": {"b": "string", "c": "string", "d": "number"}, "n": "number", "z": "any"}) if e[0] == 4] == [(4, ".a.c': expected type 'string' but got 'number'"), (4, ".a.d': required object subfield is missing"), (4, ".z': required object subfield is missing")]
    allowed = ["x", 1.5, True, [1, "a", None, [2]]]
    odd = [(1, '"it\'s"'), (4, '{"a":{"b":null,"c":3},"n":null}'), (8, '[{"a":{"b":1}},7,null]')]
    assert errors(enum=allowed) == [(i, f"': value {v} is not a member of the allowed set {allowed!r}") for i, v in odd]
    assert errors(type="anything", required=True, on_missing="omit") == [(i, "': required field is missing from the projected profile") for i in (5, 6, 7, 9)]
    profiles, _ = project(df, {"fields": [{"name": "a", "from": "v.k[1]"}, {"name": "b", "from": "v.k[].a", "on_missing": "omit"}]}, "id")
    assert {r.id: r.profile for r in profiles.where("id in (3, 5, 8)").collect()} == {3: '{"a":"a","b":[null,null,null,null]}', 5: '{"a":null}', 8: '{"a":7,"b":[{"b":1},null,null]}'}


def test_checks_of_typed_objects(spark):
    df = spark.createDataFrame([(1, (None, 2, (True,))), (2, None)], "id long, o struct<a:string,b:int,c:struct<d:boolean>>")
    config = {"fields": [{"name": "o", "type": "object", "element_type": {"a": "number", "b": "string", "c": {"d": "string", "e": "x"}}}]}
    _, found = project(df, config, "id")
    assert sorted(r.error for r in found.collect()) == ["field 'o.b': expected type 'string' but got 'number'", "field 'o.c.d': expected type 'string' but got 'boolean'", "field 'o.c.e': required object subfield is missing"]


def test_identity_exact_takes_all_orders(spark, tmp_path):
    from collections import Counter

    from meldspark.queries import identity_exact_query

    orders = [(k, 100 + k * 7 % 41) for k in range(1, 400, 3)] + [(k, 500 + k) for k in range(402, 700, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    parent = {k: k for k, _ in orders}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for j, c in orders:
        for k, e in orders:
            if c == e or (j // 50 == k // 50 and j % 50 < 6 and k % 50 < 6):
                a, b = sorted((find(j), find(k)))
                parent[b] = a
    want = Counter(find(k) for k, _ in orders)
    assert {r.group_id: r.n for r in identity_exact_query(spark, str(tmp_path)).collect()} == want


def test_candidate_order_gathers_nothing(spark):
    """No list of a candidate's claims is made where only its order is asked for."""
    plan = queries.QUERIES["candidate_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("bucket", [1, 3, 16])
def test_names_meet_by_their_halves(spark, monkeypatch, bucket):
    """All close pairs of 20 to 25 characters meet under a key of a half, however their two characters
    each are spread, or else both names are under a crowded one."""
    from meldspark.functions import near

    monkeypatch.setattr(near, "BUCKET", bucket)
    rnd = random.Random(bucket)
    names = set()
    for i in range(120):
        base = "".join(rnd.choices("abcdefghij", k=rnd.randint(21, 25)))
        for _ in range(4):
            w = list(base)
            for at in sorted(rnd.sample(range(len(w)), 2), reverse=True):
                del w[at]
            for _ in range(rnd.randint(0, 2)):
                w.insert(rnd.choice([0, len(w) // 2, len(w), rnd.randrange(len(w) + 1)]), rnd.choice("abcxyz"))
            names.add("".join(w))
        names.add(base)
    names = sorted(names)
    lengths = sorted({len(n) for n in names})
    rows = sorted((hash(k[:-1]), "=><".index(k[-1]), i) for i, n in enumerate(names) for k in near.halves_of(n, lengths))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 7], strict=True)], names=["key", "sign", "id"]) for i in range(0, len(rows), 7)]
    got = [(r["a"], r["b"]) for b in near.bucket_batches(iter(batches)) for r in b.to_pylist()]
    met, crowded = {p for p in got if p[0] != p[1]}, {a for a, b in got if a == b}
    want = {(i, j) for i in range(len(names)) for j in range(i) if near.shared(len(names[i]), len(names[j])) and near.heavy(len(names[i]), len(names[j])) and 200 * scalar.lcs(names[i], names[j]) > 90 * (len(names[i]) + len(names[j]))}
    assert len(want) > 300 and all((j, i) in met or {i, j} <= crowded for i, j in want)
    assert max(len(near.halves_of(n, lengths)) for n in names if len(n) == 21) <= 150  # 210 and more keys before


def test_long_names_that_meet_few_others_have_few_rows(spark, tmp_path, monkeypatch):
    """Names of 21 characters do not have a row for each of their 210 subsequences."""
    seen = {}
    monkeypatch.setattr(identity, "materialize", lambda df, name, m=identity.materialize: seen.setdefault(name, m(df, name)))
    groups = spark.range(400).select(F.concat(F.substring(F.md5((F.col("id") / 2).cast("int").cast("string")), 1, 20), F.when(F.col("id") % 2 == 0, "x").otherwise("y")).alias("name"), F.lit("").alias("kind"), F.col("id").alias("least"))
    links = {(r.least, r.hub) for r in identity.name_links(groups).collect()}
    assert links == {(i, j) for k in range(200) for i in (2 * k, 2 * k + 1) for j in (2 * k, 2 * k + 1)}
    assert seen["name-keys"].count() == 400
