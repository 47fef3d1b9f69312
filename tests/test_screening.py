"""Every invalid shape gives its one code; valid ones give none."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from factloom.model.declaration import Declaration, predicates_frame
from factloom.model.vocabulary import kind_closure, kinds_frame
from factloom.plans import screening
from factloom.sources import observations

REPO = {"kind": "Repository", "key": "github:repository/1"}
TEAM = "github:team/core"
REL = {"type": "approves_changes", "to": TEAM}
VALID = {
    "plain": {"entity": REPO | {"attributes": {"name": "n", "topics": ["a"], "description": None}}, "relations": [REL], "snapshots": [{"direction": "OUT", "predicates": ["*"]}]},
    "inward": {"entity": {"kind": "Team", "key": TEAM}, "relations": [{"type": "member_of", "from": "github:user/a", "valid_from": "2026-01-01T00:00:00Z", "valid_to": "2026-02-01T00:00:00Z", "confidence_ppm": 1}]},
    "handoff": {"entity": REPO, "relations": [{"type": "defined_in", "to": TEAM, "valid_from": "2026-01-01T00:00:00Z", "valid_to": "2026-02-01T00:00:00Z"}, {"type": "defined_in", "to": "github:team/b", "valid_from": "2026-02-01T00:00:00Z"}]},
    "same twice": {"entity": REPO, "relations": [REL, REL]}, "unregistered attribute": {"entity": REPO | {"attributes": {"stars": 5}}}, "typed": {"entity": REPO | {"attributes": {"score": 1.5, "seen": "2026-01-01T00:00:00.000000Z"}}},
    "linked": {"entity": {"kind": "Person", "key": "dir:user/1", "linked_ids": ["github:user/a"]}}, "deleted": {"entity": REPO | {"deleted": True}},
}
INVALID = {
    "malformed": [
        {"relations": [REL]}, {"entity": REPO, "surprise": 1}, {"entity": REPO | {"key": "nokey"}}, {"entity": REPO, "relations": [REL | {"to": "bad key"}]}, {"entity": REPO, "relations": [{"type": "owned_by"}]},
        {"entity": REPO, "snapshots": [{"predicates": ["*"]}]}, {"entity": REPO | {"attributes": {"exists": True}}}, {"entity": REPO, "attribute_claims": [{"predicate": "versions", "absent": True}]}, {"entity": REPO, "relations": [REL | {"valid_from": "soon"}]},
        {"entity": REPO, "snapshots": [{"direction": "UP", "predicates": ["*"]}]},
    ],
    "duplicate_claim": [{"entity": REPO, "relations": [REL, REL | {"confidence_ppm": 5}]}, {"entity": REPO | {"attributes": {"versions": ["1"]}}, "attribute_claims": [{"predicate": "versions", "value": "1"}]}],
    "cardinality_mismatch": [
        {"entity": REPO, "relations": [{"type": "defined_in", "to": TEAM}, {"type": "defined_in", "to": "github:team/b"}]}, {"entity": REPO | {"attributes": {"seen": ["2026-01-01T00:00:00.000000Z"]}}},
        {"entity": REPO, "attribute_claims": [{"predicate": "score", "value": 1, "valid_from": "2026-01-01T00:00:00Z"}, {"predicate": "score", "value": 2, "valid_from": "2026-01-02T00:00:00Z"}]},
    ],
    "invalid_value": [{"entity": REPO, "relations": [REL | {"confidence_ppm": 0}]}, {"entity": REPO, "relations": [REL | {"confidence_ppm": 1_000_001}]}, {"entity": REPO | {"attributes": {"seen": "2026-01-01"}}}],
    "invalid_interval": [{"entity": REPO, "relations": [REL | {"valid_from": "2026-02-01T00:00:00Z", "valid_to": t}]} for t in ("2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z")],
    "not_declared": [{"entity": REPO | {"kind": "Nothing"}}, {"entity": REPO, "relations": [{"type": "likes", "to": TEAM}]}],
    "core_predicate": [{"entity": REPO, "relations": [{"type": "same_as", "to": TEAM}]}], "domain_mismatch": [{"entity": REPO, "relations": [{"type": "member_of", "to": TEAM}]}],
    "type_mismatch": [{"entity": REPO | {"attributes": {"score": "high"}}}, {"entity": REPO | {"attributes": {"owned_by": "x"}}}, {"entity": REPO, "relations": [{"type": "versions", "to": TEAM}]}],
}
CLAIM_SCOPED = {"invalid_value", "invalid_interval", "core_predicate", "domain_mismatch", "type_mismatch"}


@pytest.fixture(scope="module")
def found(spark):
    cases = [(f"valid {k}", v) for k, v in VALID.items()] + [(f"{code} {i}", v) for code, some in INVALID.items() for i, v in enumerate(some)]
    df = spark.createDataFrame([(i, "s", "t", json.dumps(v), dt.datetime(2026, 3, 1)) for i, v in cases] + [("malformed json", "s", "t", "{", dt.datetime(2026, 3, 1)), ("malformed time", "s", None, json.dumps(VALID["plain"]), None)], "id string, source string, time string, data string, observed_at timestamp_ntz")
    p = predicates_frame(spark, [Declaration("x", {"Repository": "r"}, {"Repository": {"score": "FLOAT", "seen": "TIME"}})])
    p = p.withColumn("domain", F.when(F.col("name") == "member_of", F.array(F.lit("Person")))).withColumn("range", F.lit(None).cast("array<string>"))
    kinds = kinds_frame(spark)
    return observations.decode(df), screening.screen(observations.decode(df), p, kinds, kind_closure(kinds), spark.createDataFrame([("github:user/a", "Person")], "key string, kind string")).cache()


def test_one_code_each(found):
    got = {}
    for r in found[1].collect():
        got.setdefault(r.obs_id, set()).add((r.code, r.scope))
    want = {f"{code} {i}": code for code, some in INVALID.items() for i in range(len(some))} | {"malformed json": "malformed", "malformed time": "malformed"}
    assert {k: {c for c, _ in v} for k, v in got.items()} == {k: {v} for k, v in want.items()}
    for k, v in got.items():
        (code, scope), = v
        assert (scope == "claim") == (code in CLAIM_SCOPED or k == "not_declared 1"), k


def test_what_stays(found):
    decoded, problems = found
    stays = {r.id for r in screening.kept(decoded, problems).collect()}
    assert {f"valid {k}" for k in VALID} <= stays and "invalid_value 0" in stays and "duplicate_claim 0" not in stays
    assert {r.obs_id: r.more for r in screening.summary(problems).collect()}["malformed json"] == 0
