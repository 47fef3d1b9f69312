"""Scalars, vocabulary and sources on literal inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import text, versions
from factloom.model import vocabulary
from factloom.sources import codeowners, directory, kubernetes, observations


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(v,) for v in value], f"s {kind}").select(column(F.col("s")).alias("x")).toPandas()["x"].tolist()


def test_lower_bounds(spark):
    cases = {
        ">= 3.8": "3.8", ">=1.2 >=1.4": "1.4", "==3.11.*": "3.11", "^20 || ^18.2": "18.2", "3.12.1+build5": "3.12.1", "~1.2": "1.2", "v1.2.x": "1.2", ">1.5,<2": "1.5",
        "lts/*": None, "*": None, "": None, "<5": None, "!=3.9": None, "20.0.0-rc.1": None, "1.22rc1": None, "18 || lts/iron": None,
    }
    got = one(spark, cases, lambda c: versions.text(versions.lower_bound(c)))
    assert dict(zip(cases, got)) == cases


def test_version_order(spark):
    cases = [("1.22", "1.22.0", 0), ("1.21.9", "1.22", -1), ("20", "18.9", 1), ("1.9", "1.10", -1)]
    df = spark.createDataFrame(cases, "a string, b string, want int")
    a, b = versions.parse_dotted(F.col("a")), versions.parse_dotted(F.col("b"))
    for r in df.select("want", versions.less(a, b).alias("lt"), versions.same(a, b).alias("eq")).collect():
        assert (r.lt, r.eq) == (r.want < 0, r.want == 0)


def test_jaro_winkler():
    match = {("martha", "marhta"): 0.9611, ("dixon", "dicksonx"): 0.8133, ("dwayne", "duane"): 0.84, ("payments", "payroll"): 0.6012, ("abc", "xyz"): 0, ("deadbddbc", "cadeabedc"): 0.6944, ("müller", "muller"): 0.9}
    for (a, b), want in match.items():
        assert abs(text._chars(a, b) - want) < 1e-4
    find = {("martha", "marhta"): 0.9611, ("payments", "payment team"): 0.8917, ("ledger", "legend"): 0.8222, ("müller", "muller"): 0.8643, ("deadbddbc", "cadeabedc"): 0.7222}
    for (a, b), want in find.items():
        assert abs(text._bytes(a, b) - want) < 1e-4
    assert text._chars("", "") == 1 and text._bytes("", "") == 0 and text._chars(None, "a") is None


def test_find_flavour_equals_duckdb():
    import duckdb

    rnd = random.Random(1)
    pairs = [("".join(rnd.choice("abcd é") for _ in range(rnd.randint(1, 9))), "".join(rnd.choice("abcd é") for _ in range(rnd.randint(1, 9)))) for _ in range(400)]
    con = duckdb.connect()
    for a, b in pairs:
        want = con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
        assert abs(text._bytes(a, b) - want) < 1e-9, (a, b)


def test_normalize_capture_jaccard(spark):
    assert one(spark, ["Payments Team", "payments-team", "payments__team", " SRE "], text.normalize) == ["payments team"] * 3 + ["sre"]
    assert one(spark, ["svc-a-x", "svc--x", "other"], lambda c: text.capture(c, "svc-{name}-x")) == ["a", None, None]
    rows = [([], [], 0.0), (["a", "b"], ["b", "c"], 1 / 3), (["a"], ["a"], 1.0)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>, want double")
    assert all(abs(r.x - r.want) < 1e-12 for r in df.select("want", text.jaccard(F.col("a"), F.col("b")).alias("x")).collect())
    assert one(spark, ["aé漢", "ab"], lambda c: text.clip_utf8(c, 4)) == ["aé", "ab"]
    assert one(spark, ["a\x00b\tc"], text.visible) == ["a b c"]


def test_canonical_json(spark):
    cases = {
        '{"b":1,"a":[true,null,"x\\n\\u0001"]}': '{"a":[true,null,"x\\n\\u0001"],"b":1}', "1.0": "1", "-0.0": "0", "1e21": "1e+21", "1e20": "100000000000000000000", "0.000001": "0.000001",
        "1e-7": "1e-7", "123.456": "123.456", "333333333.33333329": "333333333.3333333", "1.5e300": "1.5e+300", '"é/"': '"é/"',
    }
    assert {k: text.canonical_json(json.loads(k)) for k in cases} == cases
    assert one(spark, ['{"b": 1, "a": 2}', "no"], text.jcs) == ['{"a":2,"b":1}', None]
    with pytest.raises(ValueError):
        text.canonical_json(float("nan"))


def test_vocabulary(spark):
    kinds = vocabulary.kinds_frame(spark, {"org.Unit": "Team", "org.Squad": "org.Unit"})
    closure = vocabulary.kind_closure(kinds)
    assert {(r.ancestor, r.depth) for r in closure.where("descendant = 'org.Squad'").collect()} == {("org.Squad", 0), ("org.Unit", 1), ("Team", 2)}
    pairs = spark.createDataFrame([("org.Squad", "Team"), ("Team", "Person"), ("", "Team"), ("Team", "Team")], "a string, b string")
    assert {(r.a, r.b): r.deeper for r in vocabulary.deeper(closure, pairs).collect()} == {("org.Squad", "Team"): "org.Squad", ("Team", "Person"): None, ("", "Team"): "Team", ("Team", "Team"): "Team"}
    for bad in ({"Unit": "Team"}, {"a.B": "a.C", "a.C": "a.B"}, {"a.B": "Nothing"}):
        with pytest.raises(vocabulary.VocabularyError):
            vocabulary.kinds_frame(spark, bad)


def test_vocabulary_grows_only(spark):
    stored = spark.createDataFrame([("A", None, "2024-01-01", None), ("x.B", "A", "2024-01-01", None), ("x.C", "A", "2024-01-01", "2024-02-01")], "name string, parent string, added_at string, retired_at string")
    stored = stored.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("added_at", "retired_at")})
    new = spark.createDataFrame([("A", None), ("x.C", "A"), ("x.D", "A")], "name string, parent string")
    got = {r.name: (str(r.added_at)[:10], r.retired_at and str(r.retired_at)[:10]) for r in vocabulary.sync_kinds(stored, new, "2024-03-01").collect()}
    assert got == {"A": ("2024-01-01", None), "x.B": ("2024-01-01", "2024-03-01"), "x.C": ("2024-01-01", None), "x.D": ("2024-03-01", None)}
    with pytest.raises(vocabulary.VocabularyError):
        vocabulary.sync_kinds(stored, spark.createDataFrame([("x.B", "x.C")], "name string, parent string"), "2024-03-01")


def test_manifests(spark):
    go = {"module m\n\ngo 1.21\n": "1.21", "go 1.21\ntoolchain go1.22.3\n": "1.22.3", "go 1.23\ntoolchain go1.22.3": "1.23", "module m": None}
    assert dict(zip(go, one(spark, go, codeowners.go_mod))) == go
    assert one(spark, ['{"engines": {"node": " >=18 "}}', "{}", "no"], codeowners.package_json) == [">=18", None, None]
    assert one(spark, ["# c\n\nv18.2.0\n", "lts/*", "something", "1" * 70], codeowners.version_file) == ["v18.2.0", "lts/*", None, None]
    assert one(spark, ['[tool.x]\nrequires-python = "1"\n[project]\nname = "a"\nrequires-python = ">=3.9"\n[b]\n', "[project]\nname='x'\n"], codeowners.pyproject) == [">=3.9", None]
    got = one(spark, ["nodejs 18.2 16\n# c\npython 3.11 # d\nbad\n"], codeowners.tool_versions)[0]
    assert [(r["tool"], r["version"]) for r in got] == [("nodejs", "18.2"), ("python", "3.11")]
    assert one(spark, [7, 123456789], lambda c: codeowners.numeric_id(codeowners.node_id("Repository", c)), "long") == [7, 123456789]


def test_dependencies(spark):
    refs = [("w", "n", "c1", 0, "DB_PORT_5432", "tcp://db:5432"), ("w", "n", "c1", 1, "LEDGER", "http://ledger"), ("w", "n", "c1", 2, "LEDGER2", "https://ledger.n"), ("w", "n", "c2", 0, "DB", "postgres://db:5432/x"), ("w", "n", "c2", 1, "SELF", "http://self")]
    r = kubernetes.references(spark.createDataFrame(refs, "workload string, own_namespace string, container string, pos int, name string, value string"), "value")
    services = spark.createDataFrame([("ledger", "n", [(80, "web", None), (443, "tls", None)]), ("db", "n", [(5432, "pg", None)]), ("self", "n", [(80, "", None)])], "service string, namespace string, ports array<struct<port:int,name:string,app_protocol:string>>")
    targets = spark.createDataFrame([("ledger", "n", "t1"), ("db", "n", "t2"), ("self", "n", "w")], "service string, namespace string, target string")
    got = {x.target: json.loads(x.qualifiers) for x in kubernetes.dependencies(r, services, targets).collect()}
    assert got == {"t1": {"port": 80, "protocol": "http", "service": "ledger", "via": "LEDGER"}, "t2": {"port": 5432, "protocol": "postgres", "service": "db", "via": "DB"}}
    hint = spark.createDataFrame([(None, ["docker.io/x", "ghcr.io/acme/api:1.2@sha256:ab"]), (" acme/web ", []), (None, [])], "a string, i array<string>").select(F.struct(*kubernetes.repository_hint(F.col("a"), F.col("i"))).alias("x"))
    assert [tuple(x.x) for x in hint.collect()] == [("acme/api", 0.3), ("acme/web", 0.9), ("", None)] or [tuple(x.x) for x in hint.collect()][:2] == [("acme/api", 0.3), ("acme/web", 0.9)]


def test_directory(spark):
    people = spark.createDataFrame([("u1", "ann", "A@x.org"), ("u1", "ann", "b@x.org"), ("u2", "bob", None)], "uuid string, username string, email string")
    got = {r.key: (r.emails, r.linked_ids) for r in directory.users(people, spark.createDataFrame([("u1", "github:user/ann")], "uuid string, linked string")).collect()}
    assert got == {"dir:user/u1": (["a@x.org", "b@x.org"], ["github:user/ann"]), "dir:user/u2": ([], [])}
    groups = spark.createDataFrame([("g", "u1", "2024-01-01T00:00:00Z", "soon", "lead")], "group string, member string, start string, end string, role string")
    r = directory.memberships(groups).first()
    assert (r.subject, r.object, r.vt, json.loads(r.quals)) == ("dir:user/u1", "dir:group/g", None, {"role": "lead"}) and r.vf.year == 2024

    steady = {None: ([{"i": 1}], "a", 2), "a": ([{"i": 2}], None, 2)}
    assert [len(p) for p in directory.pages(steady.__getitem__)] == [1, 1]
    totals = iter([2, 3, 3, 3])
    assert len(list(directory.pages(lambda c: ([{}], "a" if c is None else None, next(totals))))) == 2
    with pytest.raises(directory.Unstable):
        list(directory.pages(lambda c: ([{}], "same", 1)))


def test_observations(spark, tmp_path):
    data = {
        "entity": {"kind": "Repository", "key": "gh:repo/1", "attributes": {"name": "n", "topic": "t", "gone": None}},
        "relations": [{"type": "owned_by", "to": "gh:team/2", "confidence_ppm": 500_000}, {"type": "member_of", "from": "gh:user/3", "absent": True}],
        "attribute_claims": [{"predicate": "versions", "value": "1", "valid_from": "2024-01-01T00:00:00.000000Z"}],
    }
    lines = [
        {"specversion": "1.0", "id": "o1", "source": "s", "type": "t", "time": "2024-01-01T00:00:00Z", "data": json.dumps(data)},
        {"id": "o2", "source": "s", "data": json.dumps({"entity": {"key": "gh:repo/4", "deleted": True}})},
        {"id": "o3", "source": "s", "data": json.dumps({"entity": {"key": "gh:repo/5"}, "surprise": 1})},
        {"id": "o4", "source": "s", "data": "{"},
    ]
    (tmp_path / "feed.ndjson").write_text("\n".join(map(json.dumps, lines)))
    d = observations.decode(observations.read_ndjson(spark, str(tmp_path))).withColumns({"seq": F.lit(1).cast("long"), "observed_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    assert {r.id: r.malformed for r in d.collect()} == {"o1": False, "o2": False, "o3": True, "o4": True}
    got = sorted((r.obs_id, r.phase, r.pos, r.subject, r.predicate, r.object, r.value, r.op, r.conf) for r in observations.claims(d).collect())
    assert got == [
        ("o1", 1, 0, "gh:repo/1", "owned_by", "gh:team/2", None, "assert", 0.5), ("o1", 1, 1, "gh:user/3", "member_of", "gh:repo/1", None, "absent", 1.0),
        ("o1", 2, 0, "gh:repo/1", "gone", None, None, "close", 1.0), ("o1", 2, 0, "gh:repo/1", "topic", None, "t", "assert", 1.0),
        ("o1", 3, 0, "gh:repo/1", "versions", None, "1", "assert", 1.0), ("o2", 0, 0, "gh:repo/4", "*", None, None, "delete", 1.0),
    ]


def test_names_of_events_and_enums(spark):
    rows = [("SyncRequested", "KIND_PERSON", "KIND_UNSPECIFIED"), ("X", "TEAM", "KIND_UNSPECIFIED"), ("ÄrgerÜber", "KIND_UNSPECIFIED", "KIND_UNSPECIFIED"), ("Header", "", "UNSPECIFIED")]
    df = spark.createDataFrame(rows, "n string, v string, z string")
    got = df.select(text.snake_case(F.col("n")), text.event_type(F.col("n"), "org.events", ["SyncRequested", "X"]), text.short_name(F.col("v"), F.col("z"))).collect()
    assert [tuple(r) for r in got] == [("sync_requested", "org.events.sync_requested.v1", "person"), ("x", "org.events.x.v1", "team"), ("ärger_über", None, "unspecified"), ("header", None, "")]


def test_requests_during_a_run_share_the_next_one():
    import threading

    from factloom.streaming.ingest import Coalesced

    gate, begun, runs, errors = threading.Semaphore(0), threading.Semaphore(0), [], []

    def work():
        begun.release()
        gate.acquire()
        runs.append(1)
        if len(runs) == 2:
            raise ValueError("once")

    after = Coalesced(work, errors.append)
    after(1)
    begun.acquire()
    for k in range(5):
        after(k)
    gate.release()
    gate.release()
    assert after.drain(20) and len(runs) == 2 and len(errors) == 1
    after(9)
    gate.release()
    assert after.drain(20) and len(runs) == 3
    after.close()
