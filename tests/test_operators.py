"""Operators on small worlds, and the fold against a naive one written from its rules."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.model.vocabulary import kind_closure, kinds_frame
from factloom.operators import fold, graph, identity, matching, temporal, validation
from factloom.plans.written import Written
from factloom.streaming import log

DAY = dt.datetime(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


FACT = "id string, subject_id string, predicate string, object_id string, value string, status string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz, source string, qualifiers string"
WORLD = [
    ("f01", "api", "depends_on", "ledger", None, "asserted", 1.0, day(0), None, "s", None), ("f02", "ledger", "depends_on", "db", None, "asserted", 1.0, day(0), None, "s", None),
    ("f03", "db", "depends_on", "ledger", None, "asserted", 1.0, day(0), None, "s", None), ("f04", "db", "owned_by", "team", None, "asserted", 1.0, day(0), day(59), "s", None),
    ("f05", "db", "owned_by", "alice", None, "proposed", 0.5, day(0), None, "s", None), ("f06", "s-old", "depends_on", "api", None, "asserted", 1.0, day(0), None, "s", None),
    ("f07", "api", "version", None, "1.21", "asserted", 1.0, day(0), day(151), "s", None), ("f08", "api", "version", None, "1.22", "asserted", 1.0, day(151), None, "s", None),
]
CLUSTERS = [(r, "api" if r == "s-old" else r) for r in ("api", "ledger", "db", "team", "alice", "s-old")]


@pytest.fixture(scope="module")
def lifted(spark):
    return temporal.lift(spark.createDataFrame(WORLD, FACT), spark.createDataFrame(CLUSTERS, "record_id string, cluster_id string"))


def ids(df):
    return sorted(r.id for r in df.collect())


def test_now_and_then_differ(lifted):
    assert ids(temporal.facts_where(lifted)) == ["f01", "f02", "f03", "f08"]
    assert ids(temporal.facts_where(lifted, at=str(day(31)))) == ["f01", "f02", "f03", "f04", "f06", "f07"]  # the self-loop shows in the past
    assert ids(temporal.facts_where(lifted, predicate="owned_by", at=str(day(31)), with_proposed=True)) == ["f04", "f05"]
    assert ids(temporal.facts_where(lifted, predicate="owned_by", at=str(day(59)))) == []  # half-open


def test_walks(spark, lifted):
    edges = temporal.facts_where(lifted, predicate="depends_on").select("id", F.col("subject_cluster").alias("src"), F.col("object_cluster").alias("dst"))
    got = lambda **k: {r.id: r.depth for r in graph.walk(edges, written=Written(spark, "t"), **k).collect()}
    assert got(start="api") == {"f01": 1, "f02": 2}  # the edge that closes the cycle is hidden
    assert got(start="ledger", inward=True) == {"f01": 1, "f03": 1}
    assert got(start="api", depth=1) == {"f01": 1} and got(start="nobody") == {}


def test_walk_equals_path_enumeration(spark):
    rnd = random.Random(3)
    e = [(f"e{k}", f"n{rnd.randrange(9)}", f"n{rnd.randrange(9)}") for k in range(24)]
    best = {}

    def go(node, path, depth):
        for i, a, b in e:
            if a == node and depth < 5 and (depth == 0 or b not in path):
                best[i] = min(best.get(i, 99), depth + 1)
                go(b, [*path, b], depth + 1)

    go("n0", ["n0"], 0)
    df = spark.createDataFrame(e, "id string, src string, dst string")
    assert {r.id: r.depth for r in graph.walk(df, "n0", depth=5, written=Written(spark, "t")).collect()} == best


def evidence(spark, facts, clusters, starts, **how):
    f = spark.createDataFrame(facts, "id string, subject_id string, object_id string")
    c = spark.createDataFrame(clusters, "record_id string, cluster_id string")
    return graph.evidence(f, c, spark.createDataFrame([(s,) for s in starts], "record_id string"), written=Written(spark, "t"), **how)


def test_evidence_prefers_fewer_hops(spark):
    """A hop is one change of record, however many links lie between; the links are named by the chain."""
    clusters = [("a", "A"), ("b1", "B"), ("b2", "B"), ("b3", "B"), ("b4", "B"), ("c", "C")]
    found = evidence(spark, [("f1", "a", "b1"), ("f2", "b2", "c"), ("f3", "b1", "c"), ("f4", "c", "a"), ("f5", "b2", None)], clusters, ["a"], depth=5)
    assert {r.id: (r.depth, r.hops, r.ids) for r in found.collect()} == {"f1": (1, 0, ["a", "b1"]), "f2": (2, 1, ["a", "b1", "b2", "c"]), "f3": (2, 0, ["a", "b1", "c"]), "f5": (2, 1, ["a", "b1", "b2"])}
    links = spark.createDataFrame([("l1", "b1", "b3"), ("l2", "b2", "b3"), ("l3", "b1", "b4"), ("l4", "b4", "b2"), ("l0", "b2", "b3"), ("l9", "b1", "c")], "id string, a string, b string")
    rows = graph.assembled(found, links, spark.createDataFrame(clusters, "record_id string, cluster_id string"), written=Written(spark, "t")).collect()
    assert [(r.id, r.start, r.end, r.facts, r.same_as) for r in rows] == [("f1", "a", "b1", 1, 0), ("f3", "a", "c", 2, 0), ("f2", "a", "c", 2, 1), ("f5", "a", None, 2, 1)]
    assert [[(*x,) for x in r.path] for r in rows][2:] == [
        [("a", "b1", "f1", None), ("b1", "b2", None, ["l1", "l0"]), ("b2", "c", "f2", None)],
        [("a", "b1", "f1", None), ("b1", "b2", None, ["l1", "l0"]), ("b2", None, "f5", None)],
    ]


def test_evidence_tries_every_arrival(spark):
    """The nearest way to d has been at b; the fact back to b is reached by the other one."""
    facts = [("ab", "a", "b"), ("ac", "a", "c"), ("bd", "b", "d"), ("cd", "c", "d"), ("db", "d", "b")]
    own = [(x, x) for x in "abcd"]
    got = {r.id: (r.depth, r.ids) for r in evidence(spark, facts, own, ["a"], depth=10).collect()}
    assert got == {"ab": (1, list("ab")), "ac": (1, list("ac")), "bd": (2, list("abd")), "cd": (2, list("acd")), "db": (3, list("acdb"))}
    back = {r.id: (r.depth, r.ids) for r in evidence(spark, [*facts, ("dv", "d", None)], own, ["d"], depth=2, reverse=True).collect()}
    assert back == {"bd": (1, list("db")), "cd": (1, list("dc")), "ab": (2, list("dba")), "ac": (2, list("dca"))}
    assert evidence(spark, facts, own, ["a"]).count() == 2 and evidence(spark, facts, own, ["z"]).count() == 0


def test_chains_of_any_length(spark):
    n = 12
    links = spark.createDataFrame([(f"l{k:02d}", f"r{k:02d}", f"r{k + 1:02d}") for k in range(n)] + [("x", "r00", "q")], "id string, a string, b string")
    c = spark.createDataFrame([(f"r{k:02d}", "c") for k in range(n + 1)] + [("q", "other")], "record_id string, cluster_id string")
    wanted = spark.createDataFrame([("r00", f"r{n:02d}"), ("r03", "r01"), ("r00", "q"), ("r05", "r05")], "a string, b string")
    got = {(r.a, r.b): r.links for r in graph.hop_chains(links, c, wanted, written=Written(spark, "t")).collect()}
    assert got == {("r00", "r12"): [f"l{k:02d}" for k in range(n)], ("r03", "r01"): ["l02", "l01"]}


def test_answers_and_relations(spark):
    closure = kind_closure(kinds_frame(spark, {"org.Unit": "Team"}))
    ends = spark.createDataFrame([("1", "Team", "owned_by"), ("2", "org.Unit", "owned_by"), ("3", "Person", "owned_by"), ("4", "", "owned_by"), ("5", "", "mixed"), ("6", "", "unknown")], "id string, kind string, predicate string")
    allowed = spark.createDataFrame([("owned_by", ["Team", "org.Unit"]), ("mixed", ["Team", "Person"])], "predicate string, kinds array<string>")
    assert sorted(r.id for r in graph.answers(ends, closure, allowed, "Team").collect()) == ["1", "2", "4"]
    links = spark.createDataFrame([("p", "u", "v", "same_as", "proposed", None), ("d", "v", "u", "distinct_from", "asserted", None), ("s", "u", "v", "same_as", "asserted", None), ("o", "u", "w", "same_as", "asserted", day(1)), ("q", "u", "w", "same_as", "proposed", None)], "id string, a string, b string, kind string, status string, valid_to timestamp_ntz")
    c = spark.createDataFrame([("u", "U"), ("v", "V"), ("w", "W")], "record_id string, cluster_id string")
    assert {(r.x, r.y, r.relation, tuple(r.links)) for r in graph.relations(links, c).collect()} == {("U", "V", "distinct", ("d", "s", "p")), ("U", "W", "proposed", ("q",))}
    some = spark.createDataFrame([("U",), ("V",)], "cluster_id string")
    assert [r.y for r in graph.relations(links, c, some).collect()] == ["V"]


def test_merge_of_intervals(spark):
    rows = [("x", "i1", day(2), day(4), 0.5, "q1", day(2), 1), ("x", "i2", day(1), day(3), 0.9, "q2", day(3), 1), ("x", "i3", day(6), None, 0.4, "q3", day(6), 2), ("y", "i4", day(1), day(2), 0.1, None, None, 0), ("y", "i5", day(2), None, 0.2, "z", day(2), 1)]
    df = spark.createDataFrame(rows, "k string, id string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, qualifiers string, last_observed timestamp_ntz, source_count long")
    got = sorted((r.k, r.valid_from, r.valid_to, r.confidence, r.qualifiers, r.source_count) for r in temporal.merge_statements(df, ["k"]).collect())
    assert got == [("x", day(1), day(4), 0.9, "q2", 2), ("x", day(6), None, 0.4, "q3", 2), ("y", day(1), None, 0.2, "z", 1)]


# -- fold -----------------------------------------------------------------------------------------------

CLAIM = "source string, seq long, phase int, pos int, subject string, predicate string, object string, value string, op string, observed_at timestamp_ntz, vf timestamp_ntz, vt timestamp_ntz, conf double, quals string, obs_id string"


def claim(seq, value, op="assert", at=None, predicate="one", subject="s", vf=None, vt=None, pos=0, conf=1.0):
    return ("src", seq, 1, pos, subject, predicate, None, value, op, day(seq if at is None else at), vf, vt, conf, f"q{seq}", f"o{seq}")


def facts(df):
    return sorted((r.subject, r.predicate, r.value, r.valid_from, r.valid_to or dt.datetime.max, r.quals, r.n_support) for r in df.collect())


def test_one_value(spark):
    rows = [claim(1, "a"), claim(2, "a"), claim(3, "b"), claim(4, None, "close"), claim(5, "b")]
    got = facts(fold.fold(spark.createDataFrame(rows, CLAIM), ["one"]))
    assert got == [("s", "one", "a", day(1), day(3), "q2", 2), ("s", "one", "b", day(3), day(4), "q3", 1), ("s", "one", "b", day(5), dt.datetime.max, "q5", 1)]


def test_late_claims(spark):
    rows = [claim(1, "a", at=10), claim(2, "b", at=5), claim(3, "a", at=7), claim(4, "a", at=12), claim(5, None, "close", at=11), claim(6, "a", at=11)]
    got = facts(fold.fold(spark.createDataFrame(rows, CLAIM), ["one"]))
    # b is stale; the older repeat supports but keeps the newer qualifiers; a close of before is still a close
    assert got == [("s", "one", "a", day(10), day(11), "q4", 3), ("s", "one", "a", day(11), dt.datetime.max, "q6", 1)]


def test_bounds_and_covered_claims(spark):
    rows = [claim(1, "a", predicate="many", vf=day(0), vt=day(30)), claim(2, "a", predicate="many", vf=day(3)), claim(3, "a", predicate="many", vf=day(31)), claim(4, "b", "absent", predicate="many"), claim(5, "a", "absent", predicate="many", at=40)]
    got = facts(fold.fold(spark.createDataFrame(rows, CLAIM), ["one"]))
    assert got == [("s", "many", "a", day(0), day(30), "q1", 1), ("s", "many", "a", day(31), day(40), "q3", 1)]


def test_deletion_and_completion_spare_newer_support(spark):
    rows = [claim(1, "a", predicate="many"), claim(2, "b", predicate="many", at=9), claim(3, None, "delete", predicate="many", at=5), claim(4, None, "complete", predicate="many", at=9), claim(5, None, "complete", predicate="many", at=10)]
    got = facts(fold.fold(spark.createDataFrame(rows, CLAIM), ["one"]))
    assert [(v, e) for _, _, v, _, e, _, _ in got] == [("a", day(5)), ("b", day(10))]


@pytest.mark.parametrize("seed", range(4))
def test_fast_path_equals_the_state_machine(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for s in range(12):
        for seq in sorted(rnd.sample(range(1, 60), 25)):
            one = rnd.random() < 0.5
            op = rnd.choice(["assert"] * 5 + (["close"] if one else ["absent"]))
            rows.append(claim(seq, None if op == "close" else rnd.choice("abc"), op, predicate="one" if one else "many", subject=f"s{s}"))
    df = spark.createDataFrame(rows, CLAIM)
    assert facts(fold.fold_in_order(df, ["one"])) == facts(fold.fold_exact(df, ["one"])) == facts(fold.fold(df, ["one"]))


def test_dedupe(spark):
    o = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "id string, seq long, v string")
    assert sorted(tuple(r) for r in fold.dedupe(o).collect()) == [("a", 1, "x"), ("b", 3, "z")]
    assert [r.id for r in fold.dedupe(o, spark.createDataFrame([("a",)], "id string")).collect()] == ["b"]


# -- identity -------------------------------------------------------------------------------------------

LINK = "id string, a string, b string, kind string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"


def test_constrained_clusters(spark):
    entities = spark.createDataFrame([("r1", "Person", "n", 1), ("r2", "Person", "n", 2), ("r3", "", "n", 3), ("r4", "Team", "n", 4), ("r5", "Person", "n", 5), ("r6", "Person", "n", 0)], "id string, kind string, name string, created_seq long")
    links = spark.createDataFrame([
        ("l1", "r1", "r2", "same_as", "asserted", day(1), None), ("l2", "r2", "r3", "same_as", "asserted", day(2), None), ("l3", "r3", "r4", "same_as", "asserted", day(3), None),
        ("l4", "r2", "r5", "same_as", "asserted", day(4), None), ("l5", "r1", "r5", "distinct_from", "asserted", day(0), None), ("l6", "r1", "r6", "same_as", "proposed", day(0), None),
    ], LINK)
    got = {r.record_id: r.cluster_id for r in identity.clusters(entities, links, kind_closure(kinds_frame(spark)), Written(spark, "t")).collect()}
    assert got == {"r1": "r1", "r2": "r1", "r3": "r1", "r4": "r4", "r5": "r5", "r6": "r6"}


def test_decisions():
    def book(*links):
        return identity.IdentityBook([{"id": f"r{k}", "kind": "Person", "created_seq": k} for k in range(1, 5)], {("Person", "Person"): "Person"}, [dict(zip(("id", "a", "b", "kind", "status", "valid_from", "valid_to", "promoted_from"), x)) for x in links])

    p = ("p", "r1", "r2", "same_as", "proposed", day(0), None, None)
    b = book(p)
    assert b.decide("d1", "accept", "r1", "r2", day(1)) == "joined" and b.decide("d1", "accept", "r1", "r2", day(1)) == "replay"
    assert b.links[1]["promoted_from"] == "p" and b.links[0]["valid_to"] == day(1)
    assert b.decide("d2", "split", "r1", "r2", day(2)) == "split" and len(set(b.clusters().values())) == 4
    with pytest.raises(identity.DecisionRefused):
        b.decide("d3", "split", "r1", "r2", day(3))
    assert b.decide("d4", "undo_distinct", "r1", "r2", day(4)) == "none" and b.decide("d5", "join", "r1", "r2", day(5)) == "joined"
    b = book(p)
    assert b.decide("d", "reject", "r1", "r2", day(1)) == "none"
    with pytest.raises(identity.DecisionRefused):
        b.decide("e", "accept", "r1", "r2", day(1))
    b = book(("x", "r1", "r3", "distinct_from", "asserted", day(0), None, None), ("y", "r2", "r3", "same_as", "asserted", day(0), None, None))
    with pytest.raises(identity.DecisionRefused):  # r1 and r3 are held distinct, r3 is with r2
        b.decide("f", "join", "r1", "r2", day(1))
    assert all(x["valid_to"] is None for x in b.links) and "f" not in b.done
    b = book(("x", "r1", "r2", "same_as", "asserted", day(0), None, None), ("y", "r2", "r3", "same_as", "asserted", day(0), None, None))
    with pytest.raises(identity.DecisionRefused):  # the pair would stay together through r2
        book(("x", "r1", "r2", "same_as", "asserted", day(0), None, None), ("y", "r2", "r3", "same_as", "asserted", day(0), None, None), ("z", "r1", "r4", "same_as", "asserted", day(0), None, None)).decide("g", "split", "r1", "r9", day(1))
    assert b.decide("h", "split", "r1", "r2", day(1)) == "split"


def test_throttle(spark):
    rows = [("a", "b", "s", day(k)) for k in (0, 1, 5, 10, 11, 40)] + [("a", "b", "t", day(1))]
    got = sorted((r.source, (r.at - DAY).days) for r in identity.throttle(spark.createDataFrame(rows, "a string, b string, source string, at timestamp_ntz"), 10 * 86_400).collect())
    assert got == [("s", 0), ("s", 10), ("s", 40), ("t", 1)]


# -- matching -------------------------------------------------------------------------------------------


def test_name_pairs_lose_nothing(spark):
    from factloom.functions.text import _chars

    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 9))).strip() for _ in range(120)} - {""})
    base = list(names)
    names = sorted({*names, *(n[:-1] + "x" for n in base if len(n) > 5), *(n[1] + n[0] + n[2:] for n in base if len(n) > 6)} - {""})
    import re

    norm = sorted({re.sub("[-_ ]+", " ", n.lower()).strip() for n in names})
    want = {(a, b) for i, a in enumerate(norm) for b in norm[i + 1 :] if _chars(a, b) >= 0.9}
    got = {(r.x, r.y) for r in matching.name_pairs(spark.createDataFrame([("K", n) for n in names], "kind string, name string")).collect()}
    assert got == want and len(want) > 10


def test_scores_and_settings(spark):
    c = spark.createDataFrame([("1", "Person", "Ann Lee"), ("2", "Person", "ann-lee"), ("3", "Team", "ann lee"), ("4", "Person", "Zed"), ("5", "", "ann lee")], "cluster_id string, kind string, name string")
    m = spark.createDataFrame([("1", "g"), ("4", "g"), ("3", "g")], "cluster_id string, member string")
    none = spark.createDataFrame([], "a string, b string")
    pairs = matching.candidates(c, m, none)
    assert {(r.a, r.b) for r in pairs.collect()} == {("1", "2"), ("1", "4")}
    assert {(r.a, r.b) for r in matching.candidates(c, m, spark.createDataFrame([("1", "4")], "a string, b string")).collect()} == {("1", "2")}
    e = spark.createDataFrame([("1", "A@x"), ("2", "a@X")], "cluster_id string, email string")
    got = {(r.a, r.b): r.score for r in matching.score(pairs, c, m, e).collect()}
    assert got[("1", "2")] == 1.0 and abs(got[("1", "4")] - (0.6 * 0 + 0.3)) < 0.2
    matching.check_settings()
    with pytest.raises(ValueError):
        matching.check_settings(floor=0.4)


def test_deposits(spark):
    scored = spark.createDataFrame([(k, "x", s, day(d) if d is not None else None, f) for k, s, d, f in [("new", 0.7, 5, "f"), ("low", 0.5, 5, "f"), ("gone", 0.9, None, "f"), ("same", 0.9, 9, "f"), ("changed", 0.9, 9, "g"), ("old", 0.9, 50, "f"), ("undone", 0.9, 9, "f")]], "a string, b string, score double, dated_at timestamp_ntz, features string")
    last = spark.createDataFrame([(k, "x", day(8), "f", day(20) if k == "undone" else None) for k in ("same", "changed", "old", "undone")], "a string, b string, last_at timestamp_ntz, last_features string, undone_at timestamp_ntz")
    got = {r.a: (r.dated_at - DAY).days for r in matching.deposits_due(scored, last).collect()}
    assert got == {"new": 5, "changed": 9, "old": 50, "undone": 20}


def test_decay(spark):
    d = spark.createDataFrame([("p", day(0), 1.0, False), ("p", day(30), 1.0, False), ("p", day(30), 0.25, True), ("q", day(-90), 0.7, False)], "id string, deposited_at timestamp_ntz, weight double, against boolean")
    s = matching.decayed(d, str(day(30)), key=["id"])
    got = {r.id: round(r.strength, 9) for r in s.collect()}
    assert got == {"p": 1.25, "q": round(0.7 / 16, 9)}
    assert [r.id for r in matching.review(s).collect()] == ["p"] and [r.id for r in matching.to_close(s).collect()] == ["q"]
    closure = kind_closure(kinds_frame(spark, {"o.Unit": "Team"}))
    hl = {r.kind: r.half_life for r in matching.half_lives(closure, spark.createDataFrame([("Team", 7.0)], "kind string, half_life double")).collect()}
    assert hl["o.Unit"] == hl["Team"] == 7.0 and hl["Person"] == 30.0


# -- validation -----------------------------------------------------------------------------------------


def test_overlapping_one(spark):
    rows = [("a", "x", day(0), day(5)), ("a", "x", day(3), day(9)), ("a", "y", day(9), None), ("b", "x", day(0), day(5)), ("b", "x", day(1), day(2)), ("b", "y", day(3), day(4)), ("c", "x", day(0), None), ("c", "y", day(-1), day(1)), ("d", "x", day(0), day(9)), ("d", "y", day(20), day(21)), ("d", "x", day(8), day(20))]
    df = spark.createDataFrame(rows, "k string, v string, vf timestamp_ntz, vt timestamp_ntz")
    assert sorted(r.k for r in validation.overlapping_one(df, ["k"], "v").collect()) == ["b", "c"]


def test_claim_codes(spark):
    base = {"registered": True, "core_only": False, "is_relation": True, "used_as_relation": True, "domain": ["Team"], "range": None, "subject_kinds": ["o.Unit", "Team"], "object_kinds": ["Person"], "vf": day(0), "vt": day(1), "confidence_ppm": 5}
    cases = {
        (): {}, ("core_predicate",): {"core_only": True, "registered": False}, ("not_declared",): {"registered": False}, ("type_mismatch",): {"used_as_relation": False}, ("domain_mismatch",): {"subject_kinds": ["Person"]},
        ("range_mismatch",): {"range": ["Team"]}, ("invalid_interval",): {"vt": day(0)}, ("invalid_value",): {"confidence_ppm": 0}, ("domain_mismatch", "invalid_value"): {"domain": ["Person"], "confidence_ppm": 1_000_001},
    }
    schema = "registered boolean, core_only boolean, is_relation boolean, used_as_relation boolean, domain array<string>, range array<string>, subject_kinds array<string>, object_kinds array<string>, vf timestamp_ntz, vt timestamp_ntz, confidence_ppm int, want string"
    rows = [(*(base | x).values(), ",".join(want)) for want, x in cases.items()]
    got = spark.createDataFrame(rows, schema).select("want", F.array_join(validation.problems(validation.claim_checks()), ",").alias("x")).collect()
    assert all(r.x == r.want for r in got) and len(got) == len(cases)


def test_rejected_claims_uncover_snapshots(spark):
    claims = spark.createDataFrame([("o", "OUT", "p", 1), ("o", "OUT", "q", 2), ("o", "IN", "r", 3)], "obs_id string, direction string, predicate string, pos int")
    snaps = spark.createDataFrame([("o", "OUT", ["p", "q"]), ("o", "IN", ["*"]), ("n", "OUT", ["p"])], "obs_id string, direction string, predicates array<string>")
    kept, left = validation.drop_rejected(claims, snaps, claims.where("predicate IN ('q', 'r')"), ["obs_id", "direction", "predicate", "pos"])
    assert [r.predicate for r in kept.collect()] == ["p"]
    assert sorted((r.obs_id, r.direction, tuple(r.predicates)) for r in left.collect()) == [("n", "OUT", ("p",)), ("o", "OUT", ("p",))]


def test_duplicates_bounds_and_caps(spark):
    c = spark.createDataFrame([("o", "k", 1, None), ("o", "k", 1, None), ("o", "l", 1, None), ("o", "l", 1, 2)], "obs string, key string, vf int, vt int")
    assert [r.key for r in validation.duplicate_claims(c, ["obs", "key"], ["vf", "vt"]).collect()] == ["l"]
    texts = ["1", "[" * 40 + "]" * 40, '{"a": [1, 2]}', "{", "NaN", None, "[" + "1," * 10_001 + "1]"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(validation.value_bounds(F.col("s")).alias("x")).collect()
    assert [r.x for r in got] == [0, 1, 0, 1, 1, None, 1]
    some, more = validation.capped(F.array(*[F.lit("x")] * 25))
    r = spark.range(1).select(F.size(some).alias("n"), more.alias("m")).first()
    assert (r.n, r.m) == (20, 5)


# -- log ------------------------------------------------------------------------------------------------


def test_log_contract(spark):
    events = spark.createDataFrame([("p", "a", 1, day(0), 10, False), ("p", "b", 2, day(1), 10, True), ("q", "c", 3, day(2), 99, False), ("p", "a", 4, day(3), 10, False)], "part string, id string, seq long, at timestamp_ntz, bytes long, retain boolean")
    rows = log.append(None, events)
    assert sorted((r.part, r.off, r.id) for r in rows.collect()) == [("p", 1, "a"), ("p", 2, "b"), ("q", 1, "c")]
    more = log.append(rows, events.withColumn("id", F.concat("id", F.when(F.col("seq") > 2, "x").otherwise(""))))
    assert sorted((r.part, r.off, r.id) for r in more.collect()) == [("p", 3, "ax"), ("q", 2, "cx")]
    assert sorted((r.part, r.off) for r in log.read_page(rows, most_bytes=15).collect()) == [("p", 1), ("q", 1)]
    none = spark.createDataFrame([], "grp string, part string, off long")
    done = log.commit(none, rows, "g", spark.createDataFrame([("p", 2)], "part string, off long"))
    again = log.commit(done, rows, "g", spark.createDataFrame([("p", 1)], "part string, off long"))
    assert [r.off for r in again.collect()] == [2]
    with pytest.raises(log.LogError):
        log.commit(done, rows, "g", spark.createDataFrame([("p", 9)], "part string, off long"))
    assert [r.id for r in log.trimmable(rows, done, ["g"], str(day(9))).collect()] == ["a"]
    free = log.release(rows, spark.createDataFrame([("b",)], "id string"))
    assert sorted(r.id for r in log.trimmable(free, done, ["g"], str(day(9))).collect()) == ["a", "b"]
    assert log.trimmable(rows, done, ["g", "h"], str(day(9))).count() == 0


def test_stream_applies_once_and_keeps_what_fails(spark, tmp_path):
    src, out = tmp_path / "log", tmp_path / "out"
    schema = "part string, id string, bytes long"
    for k in range(3):
        spark.createDataFrame([("p", f"e{k}", 1), ("p", "", 1)], schema).coalesce(1).write.parquet(f"{src}/f{k}")
    calls = []

    def apply(df, batch_id):
        calls.append(batch_id)
        if batch_id == 1:
            raise ValueError("cannot take this one")
        df.write.mode("overwrite").parquet(f"{out}/b={batch_id}")

    go = lambda: log.follow(spark, f"{src}/*", schema, apply, checkpoint=str(tmp_path / "cp"), dead_letters=str(tmp_path / "dead")).awaitTermination()
    go()
    assert sorted(calls) == [0, 1, 2]
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert dead.where("reason = 'contract'").count() == 3 and dead.where("reason LIKE 'cannot%'").count() == 1
    go()  # nothing new, nothing applied again
    assert len(calls) == 3 and spark.read.parquet(str(out)).count() == 2


def test_lag_and_completions(spark):
    from factloom.streaming.ingest import completions

    rows = spark.createDataFrame([("p", 1, day(0)), ("p", 2, day(1)), ("q", 1, day(2))], "part string, off long, at timestamp_ntz")
    done = spark.createDataFrame([("g", "p", 1)], "grp string, part string, off long")
    got = {r.part: (r.unapplied, r.lag_seconds) for r in log.lag(rows, done, "g", str(day(3))).collect()}
    assert got == {"p": (1, 2 * 86_400.0), "q": (1, 86_400.0)}
    kept = spark.createDataFrame([("a", day(1)), ("a", day(0)), ("b", day(0))], "source string, observed_at timestamp_ntz")
    assert [(r.source, r.started) for r in completions(kept, spark.createDataFrame([("b",)], "source string")).collect()] == [("a", day(0))]


def test_stale_lag_and_flapping(spark):
    rows = [("p", day(7 * k), k < 4, k < 13) for k in range(16)] + [("q", day(7 * k), True, True) for k in range(16)] + [("r", day(7 * k), k < 4, True) for k in range(16)]
    df = spark.createDataFrame(rows, "k string, at timestamp_ntz, same boolean, proposed boolean")
    assert {r.k: r.lag_days for r in matching.stale_lag(df, ["k"]).collect()} == {"p": 63.0, "r": None}
    flaps = matching.flapping(df.withColumnRenamed("at", "round"), ["k"])
    assert {r.k: r.changes for r in flaps.collect()} == {"p": 1, "q": 0, "r": 0}


def test_decision_log():
    book = identity.IdentityBook([{"id": f"r{k}", "kind": "Person", "created_seq": k} for k in (1, 2)], {("Person", "Person"): "Person"})
    d = lambda i, what, at: {"id": i, "what": what, "a": "r1", "b": "r2", "at": day(at)}
    out = identity.apply_decisions(book, [d("1", "accept", 0), d("2", "join", 1), d("2", "join", 1), d("3", "split", 2)])
    assert [(x["effect"], x["refused"] is None) for x in out] == [("none", False), ("joined", True), ("replay", True), ("split", True)]


def test_linked_ids(spark):
    o = spark.createDataFrame([("r1", "s", ["k1", "k2", "none"], day(0))], "record string, source string, linked array<string>, at timestamp_ntz")
    a = spark.createDataFrame([("k1", "r1"), ("k2", "r0")], "key string, record string")
    assert [(r.a, r.b, r.linked) for r in identity.linked_ids(o, a).collect()] == [("r0", "r1", "k2")]


def test_times():
    from factloom.functions.times import canonical, parse_when

    now = dt.datetime(2026, 3, 10, 12)
    assert parse_when("72h", now) == dt.datetime(2026, 3, 7, 12) and parse_when("7d", now) == dt.datetime(2026, 3, 3, 12) and parse_when("2026-01-02", now) == dt.datetime(2026, 1, 2)
    assert parse_when("2026-01-02T03:04:05+02:00", now) == dt.datetime(2026, 1, 2, 1, 4, 5) and canonical(dt.datetime(2026, 1, 2)) == "2026-01-02T00:00:00.000000Z"
    with pytest.raises(ValueError):
        parse_when("soon", now)


def test_intermediates_never_go_to_one_machine_of_a_cluster(spark):
    class Cluster:
        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "none"

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="checkpoint"):
        Written(Cluster, "x")
    assert Written(spark, "x").root


def test_components_that_do_not_settle_are_an_error(spark):
    from factloom.operators.components import connected_components

    path = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert connected_components(path, Written(spark, "t")).where("component <> 0").count() == 0
    with pytest.raises(RuntimeError, match="settle"):
        connected_components(path, Written(spark, "t"), most_rounds=2)


def test_crews_meet_their_teams_after_they_are_cut(spark):
    from factloom.plans import questions

    teams = spark.createDataFrame([("t1", 1), ("t2", 1), ("t2", 1), ("t3", 2), ("t4", 3), ("t5", None)], "team string, crew int")
    people = [(1 + k % 2, f"p{k:02}", f"n{k % 7}", (None, "maintainer", "dev", "")[k % 4], k % 5, k % 3) for k in range(40)] + [(None, "p99", "n", "dev", 1, 1)]
    people = spark.createDataFrame(people, "crew int, person string, name string, role string, last_observed int, position int")
    sources = people.unionByName(people.withColumn("role", F.lit(None).cast("string")).withColumn("last_observed", F.lit(9)))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    columns = ["team", "person", "role", "position", "truncated"]
    got = questions.crew_members(teams, people.drop("position"), limit=3)
    assert rows(got.select(*columns)) == rows(questions.members(teams.join(people.drop("position"), "crew"), limit=3).select(*columns))
    assert rows(questions.crew_roles(teams, sources)) == rows(questions.roles(teams.join(sources, "crew")))


@pytest.mark.parametrize("name", ["owner_members", "member_role_latest"])
def test_members_are_cut_and_settled_before_the_join(spark, sf_dir, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # the last join of all with all stands above the ranking, or the aggregate, of people
    assert plan.index("Join Inner") < plan.rindex("Window" if name == "owner_members" else "Aggregate")


@pytest.mark.parametrize("block", [7, 1000])
def test_clusters_that_share_much_meet_in_blocks(spark, monkeypatch, block):
    rnd, sets = random.Random(block), {}
    for k in range(120):
        sets[f"u{k}"] = set(rnd.sample(range(20), rnd.randint(1, 20)))
    sets["alone"], sets["none"] = {1_000}, {None, 3}
    rows = [(c, m) for c, s in sets.items() for m in s] * 2 + [(None, 3)]
    for name, value in (("BLOCK", block), ("BLOCK_MEMBERS", 2_000), ("SET_ROW", 6), ("PAIRS", 50), ("WIDE", 16)):
        monkeypatch.setattr(matching, name, value)
    made = []
    monkeypatch.setattr(matching, "_overlap_by_blocks", lambda *a, f=matching._overlap_by_blocks: made.append(a) or f(*a))
    got = sorted((r.a, r.b, r.shared, r.jaccard) for r in matching.member_overlap(spark.createDataFrame(rows, "cluster_id string, member int")).collect())
    want = []
    for a in sets:
        for b in sets:
            both = len((sets[a] & sets[b]) - {None})
            if a < b and both:
                want.append((a, b, both, both / (len(sets[a]) + len(sets[b]) - both)))
    assert made and got == sorted(want)
