"""A small company's observations, end to end: binding, fold, links, clusters, answers, streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.model.declaration import Declaration, DeclarationError, authoritative, predicates_frame, sync_predicates
from factloom.model.vocabulary import VocabularyError, kind_closure, kinds_frame
from factloom.plans import answers, ingest
from factloom.sources import kubernetes, observations, repositories, store
from factloom.streaming import ingest as stream

START = dt.datetime(2026, 9, 28)


def t(hours):
    return START + dt.timedelta(hours=hours)


def obs(n, hours, source, key, kind="", **more):
    entity = {"kind": kind, "key": key} | {k: more.pop(k) for k in ("aliases", "linked_ids", "attributes", "deleted") if k in more}
    return (f"o{n}", source, n, t(hours), json.dumps({"entity": entity, **more}))


LOG = [
    obs(1, 0, "git", "github:repository/1", "Repository", aliases=["github:name/acme/pay"], attributes={"name": "pay", "topics": '["a","b"]', "language": "Go"}, relations=[{"type": "approves_changes", "to": "github:team/core"}, {"type": "approves_changes", "to": "github:user/ann"}], snapshots=[{"direction": "OUT", "predicates": ["approves_changes"]}]),
    obs(2, 1, "git", "github:team/core", "Team", attributes={"name": "Core"}, relations=[{"type": "member_of", "from": "github:user/ann", "attributes": {"role": "maintainer"}}], snapshots=[{"direction": "IN", "predicates": ["member_of"]}]),
    obs(3, 2, "git", "github:user/ann", "Person", attributes={"name": "Ann"}),
    obs(4, 3, "k8s", "k8s:workload/n/pay", "Component", attributes={"name": "pay"}, relations=[{"type": "defined_in", "to": "github:name/acme/pay"}, {"type": "depends_on", "to": "k8s:workload/n/db"}]),
    obs(5, 4, "k8s", "k8s:workload/n/db", "Component", attributes={"name": "db"}, relations=[{"type": "owned_by", "to": "k8s:team/core", "confidence_ppm": 800000}]),
    obs(6, 5, "dir", "dir:user/u1", "Person", attributes={"name": "Ann Lee"}, linked_ids=["github:user/ann"]),
    obs(7, 24, "git", "github:repository/1", "Repository", aliases=["github:name/acme/payments"], attributes={"name": "payments", "topics": '["b","c"]', "language": None}, relations=[{"type": "approves_changes", "to": "github:team/core"}], snapshots=[{"direction": "OUT", "predicates": ["approves_changes"]}]),
    obs(7, 24, "git", "github:repository/1", "Repository"),  # sent twice
    obs(8, 48, "git", "github:team/core", "Team", deleted=True),
    obs(9, 50, "k8s", "k8s:workload/n/pay", "Component", attributes={"name": "pay"}, relations=[{"type": "depends_on", "to": "k8s:workload/n/db"}]),
]


@pytest.fixture(scope="module")
def world(spark):
    df = spark.createDataFrame([(i, s, n, at, d) for n, (i, s, _, at, d) in enumerate(LOG)], "id string, source string, seq long, observed_at timestamp_ntz, data string")
    return ingest.derive(spark, observations.decode(df), authority=[("dir", "github:user")], completions=[("k8s", ["Component"], str(t(49)))])


def test_records_and_clusters(world):
    alias = {r.key: r.record for r in world.alias.collect()}
    assert alias["github:name/acme/pay"] == alias["github:repository/1"] == alias["github:name/acme/payments"]
    kinds = {r.id: (r.kind, r.name) for r in world.records.collect()}
    assert kinds[alias["github:repository/1"]] == ("Repository", "payments") and kinds[alias["k8s:team/core"]] == ("", "core")
    c = {r.record_id: r.cluster_id for r in world.clusters.collect()}
    assert c[alias["dir:user/u1"]] == c[alias["github:user/ann"]] and c[alias["github:team/core"]] != c[alias["k8s:team/core"]]


def test_facts(world):
    name = {r.record: r.key for r in world.alias.orderBy(F.desc("key")).collect()}
    got = sorted((name[f.subject], f.predicate, name.get(f.object) or f.value, f.valid_from, f.valid_to) for f in world.facts.collect())
    ann, core, pay, repo = "github:user/ann", "github:team/core", "k8s:workload/n/pay", "github:name/acme/pay"
    want = sorted([
        (repo, "approves_changes", core, t(0), t(48)), (repo, "approves_changes", ann, t(0), t(24)), (repo, "language", "Go", t(0), t(24)),
        (repo, "topics", "a", t(0), t(24)), (repo, "topics", "b", t(0), None), (repo, "topics", "c", t(24), None), (ann, "member_of", core, t(1), t(48)),
        (pay, "defined_in", repo, t(3), None), (pay, "depends_on", "k8s:workload/n/db", t(3), None), ("k8s:workload/n/db", "owned_by", "k8s:team/core", t(4), t(49)),
    ])
    assert got == want
    assert world.counters() == {"opened": 10, "closed": 6, "refreshed": 3, "entities": 7}


def test_answers(world):
    rows = {(r.predicate, r.value): r for r in answers.get(world, "github:name/acme/payments").collect()}
    assert set(rows) == {("topics", "b"), ("topics", "c")} and rows["topics", "b"].source_count == 2
    then = answers.get(world, "github:repository/1", at=str(t(10))).collect()
    assert {r.predicate for r in then} == {"approves_changes", "language", "topics"} and len(then) == 5
    walk = answers.related(world, "k8s:workload/n/pay", "depends_on").collect()
    assert [(r.depth, r.confidence) for r in walk] == [(1, 1.0)]
    with pytest.raises(answers.NotFound):
        answers.get(world, "nobody:x/1")
    labels = {r.key: (r.kind, r.name) for r in ingest.label(world.records, world.clusters, world.alias).collect()}
    assert labels["github:name/acme/pay"] == ("Repository", "payments") and labels["dir:user/u1"][0] == "Person"
    assert [r.status for r in answers.links_where(world.links, world.clusters, kind="same_as").collect()] == ["asserted"]
    assert answers.links_where(world.links, world.clusters, status="proposed").count() == 0


def test_evidence(spark, world):
    alias = {r.key: r.record for r in world.alias.collect()}
    pay, db, core = alias["k8s:workload/n/pay"], alias["k8s:workload/n/db"], alias["k8s:team/core"]
    at = str(t(6))
    found = answers.evidence(world, ["k8s:workload/n/pay"], ["depends_on", "owned_by"], depth=3, at=at)
    rows = found.claims.collect()
    assert [(r.start, r.end, r.facts, r.same_as) for r in rows] == [(pay, db, 1, 0), (pay, core, 2, 0)]
    assert [(s.source, s.first_id, s.last_id) for s in rows[0].sources] == [("k8s", "o4", "o9")]
    assert {r.id for r in found.records.collect()} == {pay, db, core} and found.relations.count() == 0
    # the directory's person is one with the code host's: from there it is a hop, whose link is named
    person = answers.evidence(world, ["dir:user/u1"], ["member_of"], at=at).claims.collect()
    assert [(r.same_as, r.end) for r in person] == [(1, alias["github:team/core"])] and len(person[0].path[0].links) == 1
    closure = kind_closure(kinds_frame(spark))
    allowed = spark.createDataFrame([("owned_by", ["Team"]), ("depends_on", ["Component"])], "predicate string, kinds array<string>")
    teams = answers.evidence(world, [pay], ["depends_on", "owned_by"], depth=3, at=at, answer_kind="Team", closure=closure, allowed=allowed)
    assert [r.end for r in teams.claims.collect()] == [core]  # without a kind, but an owner can only be a team


def test_every_supporting_observation_is_a_source(spark):
    """A period in the past, told later, is supported by the observation that told it."""
    log = [obs(1, 24 * 250, "hr", "hr:user/1", "Person", relations=[{"type": "member_of", "to": "hr:team/1", "valid_from": "2026-01-01T00:00:00Z", "valid_to": "2026-02-01T00:00:00Z"}]),
           obs(2, 24 * 251, "hr", "hr:user/1", "Person", attributes={"title": "x"}), obs(3, 24 * 252, "hr", "hr:user/1", "Person", attributes={"title": "x"})]
    df = spark.createDataFrame(log, "id string, source string, seq long, observed_at timestamp_ntz, data string")
    d = ingest.derive(spark, observations.decode(df))
    sources = d.fact_source.groupBy("fact_id").agg(F.array_sort(F.collect_list("observation_id")).alias("o"))
    got = {r.predicate: (r.n_support, r.o) for r in d.facts.join(sources, d.facts.id == sources.fact_id, "left").collect()}
    assert got == {"member_of": (1, ["o1"]), "title": (2, ["o2", "o3"])}


def test_late_snapshots_close_as_every_snapshot_does(spark):
    """Out of order, one close for each touch would not do: the first later snapshot is older than the fact."""
    rel = lambda *to: [{"type": "depends_on", "to": f"k:w/{x}"} for x in to]
    snap = [{"direction": "OUT", "predicates": ["*"]}]
    log = [obs(1, 10, "k", "k:w/a", "Component", relations=rel("x", "y"), snapshots=snap), obs(2, 5, "k", "k:w/a", "Component", relations=rel("y"), snapshots=snap), obs(3, 12, "k", "k:w/a", "Component", relations=rel("y"), snapshots=snap),
           obs(4, 1, "k", "k:w/b", "Component", relations=rel("x", "y"), snapshots=snap), obs(5, 2, "k", "k:w/b", "Component", relations=rel("x"), snapshots=snap), obs(6, 3, "k", "k:w/b", "Component", relations=rel("x", "y"), snapshots=snap), obs(7, 4, "k", "k:w/b", "Component", relations=[], snapshots=snap)]
    df = spark.createDataFrame(log, "id string, source string, seq long, observed_at timestamp_ntz, data string")
    d = ingest.derive(spark, observations.decode(df))
    key = {r.record: r.key[-1] for r in d.alias.collect()}
    got = sorted((key[r.subject], key[r.object], r.valid_from, r.valid_to or dt.datetime.max) for r in d.facts.collect())
    assert got == [("a", "x", t(10), t(12)), ("a", "y", t(10), dt.datetime.max), ("b", "x", t(1), t(4)), ("b", "y", t(1), t(2)), ("b", "y", t(3), t(4))]


def test_a_replay_changes_nothing(spark, world):
    df = spark.createDataFrame([(i, s, n, at, d) for n, (i, s, _, at, d) in enumerate(LOG + LOG)], "id string, source string, seq long, observed_at timestamp_ntz, data string").repartition(5)
    again = ingest.derive(spark, observations.decode(df), authority=[("dir", "github:user")], completions=[("k8s", ["Component"], str(t(49)))])
    key = lambda d: sorted(map(tuple, d.facts.drop("opened_by", "last_by").collect()), key=str)
    assert key(again) == key(world)


def test_binding_in_order():
    m = lambda seq, what, key, aliases=(), kind="", name="": {"seq": seq, "phase": 0, "pos": 0, "what": what, "key": key, "aliases": list(aliases), "kind": kind, "name": name, "source": "s", "at": t(seq)}
    out = ingest.bind_in_order([m(1, "target", "a:x/1"), m(2, "entity", "b:y/2", ["a:x/1"], "Team", "T"), m(3, "entity", "c:z/3", ["b:y/2"], "Team", "U"), m(4, "target", "a:x/1"), m(5, "entity", "d:w/4", ["e:v/5"], "Team", ""), m(6, "entity", "f:u/6", ["e:v/5"], "Team", "V")])
    bound = {r[2]: r[1] for r in out if r[0] == "alias"}
    assert bound["b:y/2"] == bound["a:x/1"] != bound["c:z/3"]  # a kindless record takes the first entity that lists its key
    links = {(r[6], r[7]): r[8] for r in out if r[0] == "link"}
    assert links == {(bound["a:x/1"], bound["c:z/3"]): "asserted", (bound["d:w/4"], bound["f:u/6"]): "proposed"}


def test_stream_of_observations(spark, tmp_path):
    inbox, log = tmp_path / "in", str(tmp_path / "log")
    inbox.mkdir()
    line = lambda i, at, data: json.dumps({"specversion": "1.0", "id": i, "source": "s", "type": "x", "time": at, "data": json.dumps(data)})
    good = {"entity": {"kind": "Team", "key": "a:b/1"}}
    (inbox / "1.ndjson").write_text("\n".join([line("o1", "2026-01-01T00:00:00Z", good), line("o2", "2026-01-01T00:00:00Z", {"nothing": 1}), "not json"]))
    after = []
    go = lambda: stream.ingest(spark, str(inbox), log, checkpoint=str(tmp_path / "cp"), rejected=str(tmp_path / "no"), after=after.append).awaitTermination()
    go()
    (inbox / "2.ndjson").write_text("\n".join([line("o1", "2026-01-01T00:00:00Z", good), line("o3", "2026-01-02T00:00:00Z", good)]))
    go()
    assert sorted(r.id for r in stream.read_log(spark, log).collect()) == ["o1", "o3"] and after == [0, 1]
    assert spark.read.parquet(str(tmp_path / "no")).count() == 2


def test_declarations(spark):
    Declaration("github", {"Repository": "repository"}, {"Repository": {"stars": "FLOAT"}}, ("github:user",)).check()
    for bad in (Declaration("", {"Team": "t"}), Declaration("x", {}), Declaration("x", {"Nope": "t"}), Declaration("x", {"Team": "t"}, {"Team": {"same_as": "STRING"}}), Declaration("x", {"Team": "t"}, {"Team": {"n": "NUMBER"}}), Declaration("x", {"Team": "t"}, links=("user",))):
        with pytest.raises(DeclarationError):
            bad.check()
    p = {r.name: (r.relation, r.cardinality) for r in predicates_frame(spark, [Declaration("x", {"Team": "t"}, {"Team": {"stars": "FLOAT"}})]).collect()}
    assert p["defined_in"] == (True, "ONE") and p["owned_by"] == (True, "MANY") and p["stars"] == (False, "ONE")
    links = spark.createDataFrame([("dir", "github:user/a"), ("git", "github:user/a"), ("dir", "bad")], "source string, linked string")
    assert [r.status for r in authoritative(links, [("dir", "github:user")]).collect()] == ["asserted", "proposed", "proposed"]
    schema = "name string, relation boolean, type string, cardinality string, domain array<string>, range array<string>"
    old = spark.createDataFrame([("r", True, None, "MANY", ["Team"], None)], schema)
    wide = spark.createDataFrame([("r", True, None, "MANY", ["Team", "Person"], None), ("s", False, "STRING", "ONE", None, None)], schema)
    assert {r.name: r.domain for r in sync_predicates(old, wide).collect()} == {"r": ["Team", "Person"], "s": None}
    for worse in (("r", True, None, "ONE", ["Team"], None), ("r", True, None, "MANY", ["Person"], None), ("r", True, None, "MANY", ["Team"], ["Team"])):
        with pytest.raises(VocabularyError):
            sync_predicates(old, spark.createDataFrame([worse], schema))


def test_code_host(spark):
    repos = spark.createDataFrame([(1, "Acme", "Pay", "", "Go", False, None, t(0)), (2, "Acme", "Web", "d", None, True, ["x"], t(0))], "id long, org string, name string, description string, language string, archived boolean, topics array<string>, read_at timestamp_ntz")
    files = spark.createDataFrame([(1, "docs/CODEOWNERS", "* @acme/docs"), (1, "CODEOWNERS", "* @Acme/core a@b.c"), (2, "CODEOWNERS", None)], "id long, path string, text string")
    got = {r.key: r for r in repositories.repositories(repos, files).collect()}
    assert got["github:repository/1"].approves_changes == ["github:team/acme/core"] and got["github:repository/1"].alias == "github:name/acme/pay"
    assert got["github:repository/2"].approves_changes is None and got["github:repository/2"].snapshot_out is None
    teams = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, children_total long")
    members = spark.createDataFrame([("a", "Ann", "MAINTAINER"), ("b", "Bob", "MEMBER")], "slug string, login string, role string")
    kids = spark.createDataFrame([("a", "a1"), ("b", "b1")], "slug string, child string")
    assert {(r.subject, r.role) for r in repositories.teams(teams, members, kids).collect()} == {("github:user/ann", "maintainer"), ("github:team/a1", None)}
    users = spark.createDataFrame([("Ann", None, ["a@x"]), ("ann", "Ann L", ["b@x", "a@x"])], "login string, name string, emails array<string>")
    assert [(r.key, r.name, r.verified_email) for r in repositories.people(users).collect()] == [("github:user/ann", "Ann L", ["a@x", "b@x"])]
    hooks = [("repository", "deleted", "acme", 1, None, None, None, None), ("push", None, "acme", 2, "main", "main", 1, ["README.md"]), ("push", None, "Acme", 3, "main", "main", 1, ["CODEOWNERS"]), ("push", None, "acme", 4, "main", "main", 20, None), ("push", None, "acme", 5, "dev", "main", 20, None), ("team", "edited", "acme", 6, None, None, None, None), ("team", "edited", "other", 7, None, None, None, None)]
    d = spark.createDataFrame(hooks, "event string, action string, org string, id long, branch string, default_branch string, commits int, changed array<string>")
    assert {(r.target, r.id, r.may_be_gone) for r in repositories.triggers(d, "acme").collect()} == {("repository", 1, True), ("repository", 3, False), ("repository", 4, False), ("team", 6, False)}


def test_workloads(spark):
    w = spark.createDataFrame([("pay", "n", {"team": "core"}, None, ["ghcr.io/Acme/pay:1"]), ("db", "n", {}, "acme/db", [])], "workload string, namespace string, labels map<string,string>, annotation string, images array<string>")
    got = {(r.subject, r.predicate): (r.object, r.confidence) for r in kubernetes.workloads(w).collect()}
    assert got == {
        ("k8s:workload/n/pay", "deployed_to"): ("k8s:namespace/n", 1.0), ("k8s:workload/n/pay", "owned_by"): ("k8s:team/core", 0.8), ("k8s:workload/n/pay", "defined_in"): ("github:name/acme/pay", 0.3),
        ("k8s:workload/n/db", "deployed_to"): ("k8s:namespace/n", 1.0), ("k8s:workload/n/db", "defined_in"): ("github:name/acme/db", 0.9),
    }
    assert [r.key for r in kubernetes.team_records(w).collect()] == ["k8s:team/core"]
    s = spark.createDataFrame([("a", {"x": "y"}, None), ("b", {"x": "y"}, "ExternalName"), ("c", None, None)], "service string, selector map<string,string>, type string")
    assert [r.service for r in kubernetes.service_index(s).collect()] == ["a"]


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("f", "owned_by"), ("g", "depends_on")], "id string, predicate string")
    for url in ("mem://t", str(tmp_path / "store")):
        s = store.Store(spark, url)
        s.write("fact", df, by=("predicate",))
        assert sorted(r.id for r in s.read("fact").collect()) == ["f", "g"]
    with pytest.raises(ValueError):
        store.Store(spark, "duckdb:///x")
    assert [r.json for r in store.as_json(spark.createDataFrame([("a‮b", None)], "x string, y int")).collect()] == ['{"x":"a\\u202eb","y":null}']
    pages = {None: ([("1", "x"), ("2", "y")], "p2"), "p2": ([("3", "z")], None)}
    store.paged_source(spark, "two_pages", lambda source, cursor: pages[cursor])
    assert spark.read.format("two_pages").option("sources", "a,b").load().count() == 6
