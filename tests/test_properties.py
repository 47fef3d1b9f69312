"""Properties of the sequential cores, for arbitrary inputs."""

import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions.text import _chars, canonical_json
from factloom.operators.fold import fold_claims
from factloom.operators.identity import constrained_union
from factloom.plans.ingest import bind_in_order

DAY = dt.datetime(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def claim(seq, value, op, at):
    return {"seq": seq, "object": None, "value": value, "op": op, "observed_at": day(at), "vf": None, "vt": None, "conf": 1.0, "quals": None, "obs_id": f"o{seq}"}


ops = st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["assert", "assert", "assert", "close", "absent"])), max_size=25)


def naive(rows, one):
    """In-order logs: what is open, by value, and what was."""
    live, past = {}, []
    for seq, (value, op) in enumerate(rows):
        if op == "close":
            past += [(v, f, seq) for v, f in live.items()]
            live = {}
        elif op == "absent":
            if value in live:
                past.append((value, live.pop(value), seq))
        elif value not in live:
            if one:
                past += [(v, f, seq) for v, f in live.items()]
                live = {}
            live[value] = seq
    return sorted(past + [(v, f, 99) for v, f in live.items()])


@given(ops, st.booleans())
def test_fold_of_ordered_logs(rows, one):
    claims = [claim(k, None if op == "close" else v, op, k) for k, (v, op) in enumerate(rows)]
    got = sorted((f["what"][1], (f["valid_from"] - DAY).days, (f["valid_to"] - DAY).days if f["valid_to"] else 99) for f in fold_claims(claims, one=one))
    assert got == naive(rows, one)


@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["assert", "close", "delete"]), st.integers(0, 9)), max_size=20), st.booleans())
def test_fold_of_any_log_keeps_its_invariants(rows, one):
    facts = fold_claims([claim(k, None if op != "assert" else v, op, at) for k, (v, op, at) in enumerate(rows)], one=one)
    for f in facts:
        assert f["valid_to"] is None or f["valid_to"] >= f["valid_from"]
    live = [f for f in facts if f["valid_to"] is None]
    assert len({f["what"] for f in live}) == len(live) and (not one or len(live) <= 1)


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(0, 5)), max_size=20), st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=5))
def test_clusters_keep_pairs_apart(links, distinct):
    records = [{"id": f"r{k}", "kind": "P", "created_seq": k} for k in range(8)]
    rows = [{"a": f"r{a}", "b": f"r{b}", "valid_from": t, "id": f"l{k}"} for k, (a, b, t) in enumerate(links)]
    apart = [(f"r{a}", f"r{b}") for a, b in distinct if a != b]
    got = constrained_union(records, rows, apart, {("P", "P"): "P"})
    assert all(got[a] != got[b] for a, b in apart)
    free = constrained_union(records, rows, [], {("P", "P"): "P"})
    assert all(free[f"r{a}"] == free[f"r{b}"] for a, b, _ in links)
    for r in free:  # named by the oldest
        assert free[r] == min((x for x in free if free[x] == free[r]), key=lambda x: int(x[1:]))


@given(st.lists(st.tuples(st.booleans(), st.sampled_from("abcde"), st.lists(st.sampled_from("abcde"), max_size=3)), max_size=12))
def test_a_bound_key_never_moves(events):
    mentions = [{"seq": k, "phase": 0, "pos": 0, "what": "entity" if e else "target", "key": f"n:t/{key}", "aliases": [f"n:t/{x}" for x in also], "kind": "P" if e else "", "name": "", "source": "s", "at": None} for k, (e, key, also) in enumerate(events)]
    out = bind_in_order(mentions)
    keys = [r[2] for r in out if r[0] == "alias"]
    assert len(keys) == len(set(keys))
    mentioned = {m["key"] for m in mentions} | {a for m in mentions if m["what"] == "entity" for a in m["aliases"]}
    assert set(keys) == mentioned
    full = bind_in_order(mentions + [dict(m, seq=m["seq"] + 100) for m in mentions])
    before, after = ({r[2]: r[1] for r in x if r[0] == "alias"} for x in (out, full))
    assert before == after


values = st.recursive(st.none() | st.booleans() | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=("Cs",))), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=("Cs",)), max_size=4), x, max_size=4), max_leaves=12)


@given(values)
@settings(max_examples=200)
def test_canonical_json_round_trips(value):
    text = canonical_json(value)
    again = json.loads(text)
    assert canonical_json(again) == text

    def same(a, b):
        if isinstance(a, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
        if isinstance(a, list):
            return len(a) == len(b) and all(map(same, a, b))
        return a == (float(b) if isinstance(a, float) else b)

    assert same(value, again)


@given(st.text(max_size=8), st.text(max_size=8))
def test_similarity_is_bounded(a, b):
    x = _chars(a, b)
    assert 0 <= x <= 1 and (x == 1) >= (a == b)
