"""The whole fusion against a plain walk over the records, pair by pair."""

import hashlib
import json
import random
import uuid

import pytest

from meldspark import engine, runs
from meldspark.functions import scalar, vocabulary
from meldspark.operators.fusion import SOURCES
from meldspark.sources import readers

VOCABULARY = {"Python": ["py"], "Go": ["golang"], "SQL": []}
DATES = {"2019": "2019-01", "2020-05": "2020-05", "Present": None, None: None}
LANDS = {"us": "US", "India": "IN", "Nowhere": None, None: None}
KINDS = list(SOURCES)
SCHEMA = "record_id long, source_id string, source_type string, ordinal long, " + ", ".join(f"{n} {t}" for n, t in readers.TYPES.items()) + ", methods map<string,string>"


def made(rnd, n):
    pick = lambda *some: rnd.choice(some)
    some = lambda *items: rnd.sample(items, rnd.randint(0, min(2, len(items)))) or None
    out = []
    for i in range(n):
        kind = rnd.choice(KINDS)
        who = rnd.randrange(n // 3)
        tag = hashlib.md5(str(who).encode()).hexdigest()[:12]
        name = pick(None, f"{tag} x", f"{tag.upper()}  y", f"{tag} x")
        if rnd.random() < 0.1:
            out.append({"kind": kind, "source": f"{kind}/{i % 3}"})
            continue
        out.append(
            {
                "kind": kind, "source": f"{kind}/{i % 3}", "full_name": name, "emails": some(f"U{who}@x.org", f"u{who}@y.org", "n/a " if who == 0 else f"u{who}@x.org"),
                "phones": some(f"+1 415 555 {2000 + who}", f"+1415555{3000 + who}", "12"), "headline": pick(None, "Cook", "Clerk"), "years_experience": pick(None, 3.0, 4.5, 11.0),
                "location": pick(None, (pick(None, "Town"), pick(None, "R"), pick(*LANDS))), "links": pick(None, (pick(None, "l/1", "l/2"), pick(None, "g/1"), None, pick([], ["o/1"], ["o/2", "o/1"]))),
                "skills": some("py", "PYTHON", "golang", "Spell  Craft", "spell craft", "12"),
                "experience": pick(None, [(pick("A", "B"), pick(None, "T"), pick(*DATES), pick(*DATES), None)], [("A", "T", "2019", None, "s"), ("A", "T", "2019", None, "s")]),
                "education": pick(None, [("School", pick(None, "BA"), None, pick(None, 2001))]),
            }
        )
    return out


def frame(spark, rows):
    fields = list(readers.TYPES)
    full = [(i, r["source"], r["kind"], i, *[r.get(f) for f in fields], {f: f"m:{f}" for f in fields}) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


class Person:
    """What one record says, normalized."""

    def __init__(self, i, r):
        self.i, self.kind, self.source = i, r["kind"], r["source"]
        self.name_key = " ".join(r["full_name"].split()).lower() if r.get("full_name") else None
        emails = [(e.strip().lower(), 1.0 if "@" in e else 0.7) for e in r.get("emails") or []]
        phones = [("+" + "".join(c for c in p if c.isdigit()), 1.0) for p in r.get("phones") or [] if p.startswith("+")]
        place = r.get("location")
        if place and (land := LANDS[place[2]], place[0], place[1]) != (None, None, None):
            place = ({"city": place[0], "region": place[1], "country": land}, 1.0 if land or not place[2] else 0.5)
        else:
            place = None
        links = r.get("links") or (None, None, None, [])
        one = lambda x: [(x, 1.0)] if x is not None else []
        years = r.get("years_experience")
        self.says = {
            "full_name": one(r.get("full_name")), "emails": emails, "phones": phones, "location": [place] if place else [],
            "links.linkedin": one(links[0]), "links.github": one(links[1]), "links.portfolio": [], "links.other": [(x, 1.0) for x in links[3]],
            "headline": one(r.get("headline")), "years_experience": one(int(years) if years and years == int(years) else years), "skills": [], "unknown": [],
        }
        for raw in r.get("skills") or []:
            key = " ".join(raw.split())
            hit = next(((n, 1.0 if key.lower() == n.lower() else 0.8) for n, a in VOCABULARY.items() if key.lower() in (n.lower(), *a)), None)
            if hit:
                self.says["skills"].append(hit)
            elif any(c.isalpha() for c in key):
                self.says["unknown"].append(key)
        self.jobs = [dict(zip(("company", "title", "start", "end", "summary"), (c, t, DATES[s], DATES[e], x), strict=True)) for c, t, s, e, x in r.get("experience") or []]
        self.schools = [dict(zip(("institution", "degree", "field", "end_year"), s, strict=True)) for s in r.get("education") or []]
        mails, calls = sorted(e for e, _ in emails), sorted(p for p, _ in phones)
        self.mails, self.calls = set(mails), set(calls)
        self.order = ((mails or [""])[0], (calls or [""])[0], self.name_key or "", self.kind, self.source, i)

    def same(self, other):
        if self.mails & other.mails or self.calls & other.calls:
            return True
        if not self.name_key or not other.name_key or (self.mails and other.mails) or (self.calls and other.calls):
            return False
        return 200 * scalar.lcs(self.name_key, other.name_key) > 90 * (len(self.name_key) + len(other.name_key))


def score(kind, agreement, quality):
    return max(0.0, min(1.0, 0.5 * SOURCES[kind] + 0.3 * agreement + 0.2 * quality))


def text(value):
    return json.dumps(value, separators=(",", ":")) if isinstance(value, dict) else str(value)


def fuse(group):
    group = sorted(group, key=lambda p: p.order)
    out, told, conf = {}, [], {}
    missing = lambda f: {"field": f, "value": None, "source": None, "method": "not_found", "confidence": 0.0}
    for field in engine.PROVENANCE:
        top = "links" if field.startswith("links.") else field
        if field in ("experience", "education"):
            seen = {}
            for p in group:
                for entry in p.jobs if field == "experience" else p.schools:
                    seen.setdefault(text(entry), (entry, p))
            rows = [{"field": field, "value": e, "source": p.source, "method": f"m:{field}", "confidence": score(p.kind, 1.0, 1.0)} for e, p in seen.values()]
            out[field] = [r["value"] for r in rows]
            told += rows or [missing(field)]
            conf[field] = max((r["confidence"] for r in rows), default=None)
            continue
        claims = [(v, q, p) for p in group for v, q in p.says[field]]
        holders = len({p.i for _, _, p in claims})
        backed = lambda v: len({p.source for w, _, p in claims if text(w) == text(v)}) / holders  # noqa: E731, B023
        rows = [{"field": field, "value": v, "source": p.source, "method": f"m:{top}", "confidence": score(p.kind, backed(v), q), "_": (KINDS.index(p.kind), q)} for v, q, p in claims]
        if field in ("emails", "phones", "links.other"):
            out[field] = sorted({r["value"] for r in rows})
        elif field == "skills":
            names = sorted({r["value"] for r in rows})
            out[field] = []
            for n in names:
                mine = [(v, q, p) for v, q, p in claims if v == n]
                best = max(SOURCES[p.kind] for *_, p in mine)
                out[field].append({"name": n, "confidence": max(0.0, min(1.0, 0.5 * best + 0.3 * backed(n) + 0.2 * max(q for _, q, _ in mine))), "sources": sorted({p.source for *_, p in mine})})
            stray = [{"field": "unknown_skills", "value": v, "source": p.source, "method": "m:skills", "confidence": 0.0} for p in group for v in p.says["unknown"]]
            shown = {}
            for r in stray:
                shown.setdefault(r["value"].lower(), r["value"])
            out["unknown_skills"] = [shown[k] for k in sorted(shown)]
            conf[field] = max((s["confidence"] for s in out[field]), default=None)
            by = lambda r: (r["value"], r["source"], r["method"])
            told += [{k: v for k, v in r.items() if k != "_"} for r in sorted(rows + stray, key=by)] if rows else [missing(field), *sorted(stray, key=by)]
            continue
        elif rows:
            rows = [min(rows, key=lambda r: (r["_"][0], -r["confidence"], -r["_"][1], text(r["value"]), r["source"]))]
            out[field] = rows[0]["value"]
        else:
            out[field] = None
        rows.sort(key=lambda r: (text(r["value"]), r["source"], r["method"]))
        told += [{k: v for k, v in r.items() if k != "_"} for r in rows] or [missing(field)]
        found = [r["confidence"] for r in rows] + ([conf[top]] if conf.get(top) is not None else [])
        conf[top] = max(found, default=None)
    have = [conf[f] for f in ("full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education") if conf[f] is not None]
    total = 0.0
    for c in have:
        total += c
    mails, calls = (sorted(set().union(*x)) for x in ([p.mails for p in group], [p.calls for p in group]))
    names = sorted({p.name_key for p in group if p.name_key})
    key = f"email:{mails[0]}" if mails else f"phone:{calls[0]}" if calls else f"name:{names[0]}" if names else f"fallback:{group[0].kind}/{group[0].source}"
    out["candidate_id"] = str(uuid.uuid5(uuid.UUID(scalar.ID_NAMESPACE), key))
    return group[0].order, out, told, total / len(have) if have else 0.0


def brute(rows):
    people = [Person(i, r) for i, r in enumerate(rows)]
    parent = list(range(len(people)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in people:
        for b in people[a.i + 1 :]:
            if a.same(b):
                x, y = sorted((find(a.i), find(b.i)))
                parent[y] = x
    groups = {}
    for p in people:
        groups.setdefault(find(p.i), []).append(p)
    return sorted((fuse(g) for g in groups.values()), key=lambda f: f[0])


@pytest.mark.parametrize("seed", range(3))
def test_fusion_is_that_of_a_plain_walk(spark, seed):
    rows = made(random.Random(seed), 75)
    got = engine.canonical(frame(spark, rows).repartition(3), VOCABULARY).orderBy("__order")
    people = [json.loads(x) for x in got.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false'))").toPandas().iloc[:, 0]]
    want = brute(rows)
    assert len(people) == len(want) > 20
    for p, (_, fields, told, overall) in zip(people, want, strict=True):
        flat = {**p, **{f"links.{k}": v for k, v in p["links"].items()}}
        if fields["location"] is None:
            fields["location"] = {"city": None, "region": None, "country": None}
        assert {k: flat[k] for k in fields} == fields
        assert p["provenance"] == told
        assert p["overall_confidence"] == pytest.approx(overall, abs=1e-12)


def test_order_does_not_matter(spark):
    rows = made(random.Random(9), 40)
    one = engine.canonical(frame(spark, rows), VOCABULARY).drop("__order").toJSON().collect()
    other = engine.canonical(frame(spark, rows).orderBy("record_id", ascending=False).repartition(4), VOCABULARY).drop("__order").toJSON().collect()
    assert sorted(one) == sorted(other)


def test_empty_records_stay_apart(spark):
    rows = [{"kind": "recruiter_csv", "source": "a.csv"}] * 2 + [{"kind": "ats_json", "source": "b#0", "full_name": "Ann"}]
    got = engine.canonical(frame(spark, rows)).collect()
    ids = sorted(r.candidate_id for r in got)
    fallback = str(uuid.uuid5(uuid.UUID(scalar.ID_NAMESPACE), "fallback:recruiter_csv/a.csv"))
    assert ids.count(fallback) == 2 and len(ids) == 3
    assert all(len(r.provenance) == 13 and r.overall_confidence == 0 for r in got if r.full_name is None)


def test_registry(spark, tmp_path):
    (tmp_path / "x.yaml").write_text("name: Ann")
    own = readers.Adapter("yaml", lambda s, p: readers.notes_records(s.read.text(p, wholetext=True).selectExpr("'y' as source_id", "'Spoke with Ann Lee' as value")), lambda x: x.endswith(".yaml"))
    registry = readers.Registry([*readers.REGISTRY.adapters, own])
    assert [a.kind for a in registry.adapters] == [*KINDS, "yaml"]
    config = {"include_provenance": False, "include_confidence": False, "fields": [{"name": "n", "from": "full_name"}]}
    refs = [(f"{tmp_path}/x.yaml", None)]
    assert [r.profile for r in runs.run(spark, refs, config, registry=registry).profiles.collect()] == ['{"n":"Ann Lee"}']
    assert runs.run(spark, refs, config).exit_code == 1


def test_vocabulary_files(tmp_path, monkeypatch):
    (tmp_path / "v.json").write_text('{"Weaving": ["loom"], "Knots": null}')
    (tmp_path / "bad.json").write_text("[]")
    assert vocabulary.load(f"{tmp_path}/v.json") == {"Weaving": ["loom"], "Knots": []}
    for other in ("bad.json", "gone.json"):
        assert vocabulary.load(f"{tmp_path}/{other}") == vocabulary.SKILLS
    monkeypatch.setenv("MELDSPARK_VOCABULARY", f"{tmp_path}/v.json")
    assert "Weaving" in vocabulary.load()


def test_all_have_emails_so_no_names_are_compared(spark, monkeypatch):
    from meldspark.operators import identity

    monkeypatch.setattr(identity, "name_links", None)  # would fail if called
    keys = spark.createDataFrame([(i, [f"u{i}@x"], [], f"person 00000{i}") for i in range(10)], "record_id long, emails array<string>, phones array<string>, name string")
    assert identity.resolve(keys).select("group_id").distinct().count() == 10


def test_texts_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"name,email\nAnn,\xff@x\n")
    (tmp_path / "n.txt").write_bytes(b"Spoke with \xff")
    config = {"include_provenance": False, "fields": [{"name": "n", "from": "full_name"}]}
    result = runs.run(spark, [(f"{tmp_path}/{n}", None) for n in ("a.csv", "n.txt")], config)
    errors = [(r.stage, r.error.split(" '")[0]) for r in result.errors.collect()]
    assert sorted(errors) == [("ingest", "failed to read recruiter CSV"), ("ingest", "failed to read recruiter notes")]


def test_live_profiles(spark):
    from meldspark.sources.github_live import fetch_github

    answers = {"users/ann": {"login": "ann", "name": "Ann"}, "users/ann/repos?per_page=100&sort=updated": [{"language": "Go"}, {"language": None}, {"language": "GO"}], "users/x": [], "users/x/repos?per_page=100&sort=updated": {}}
    got = readers.github_records(fetch_github(spark, ["ann", "x"], lambda url: answers[url.split(".com/")[1]])).collect()
    assert [(r.full_name, r.skills, r.links.github) for r in got] == [("Ann", ["Go"], "https://github.com/ann")]


def test_components_set_leaves_aside(spark):
    """A hub with many leaves, leaves of leaves, and a long path: as union-find has them; the rounds work on what is no leaf."""
    from meldspark.operators import components

    rnd = random.Random(3)
    edges = [(10000 + i, 7) for i in range(1500)] + [(20000 + i, 10000 + i) for i in range(50)] + [(5000 - i, 5001 - i) for i in range(40)]
    edges += [(rnd.randrange(6000, 6400), rnd.randrange(6000, 6400)) for _ in range(250)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components.connected_components(df).collect())) == sorted((x, find(x)) for x in parent)
    star = spark.createDataFrame(edges[:1500], "a long, b long")
    leaves, core = components._leaves(star, 1500)
    assert (leaves.count(), core.count(), components._hot(star, "b", 1500)) == (1500, 0, [7])
