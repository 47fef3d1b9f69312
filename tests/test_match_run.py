"""A matching run, and the next ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.plans.match_run import Settings, run

DAY = dt.datetime(2026, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def world(spark):
    f = spark.createDataFrame
    return {
        "entities": f([("1", "Team", "pay"), ("2", "Team", "pay"), ("3", "Team", "pay"), ("4", "Team", "ops"), ("5", "Team", "Ops"), ("6", "Team", "pay")], "cluster_id string, kind string, name string"),
        "keys": f([("4", "git:team/ops"), ("5", "dir:group/ops-x"), ("1", "git:team/pay")], "cluster_id string, key string"), "members": f([("1", "m")], "cluster_id string, member string"),
        "emails": f([], "cluster_id string, email string"), "seen": f([("1", day(9)), ("2", day(8)), ("3", day(9)), ("4", day(9)), ("5", day(9)), ("6", None)], "cluster_id string, last_seen timestamp_ntz"),
        "links": f([("l", "1", "3", "distinct_from", "proposed", day(0), None)], "id string, a string, b string, kind string, status string, valid_from timestamp_ntz, valid_to timestamp_ntz"),
        "clusters": f([(k, k) for k in "123456"], "record_id string, cluster_id string"),
    }


DEPOSIT = "id string, a string, b string, deposited_at timestamp_ntz, weight double, against boolean, features string"


def test_first_and_second_run(spark, world):
    s = Settings(rules=(("names", "git:team/{name}", "dir:group/{name}-x"),))
    one = run(spark, str(day(10)), deposits=spark.createDataFrame([], DEPOSIT), settings=s, **world)
    assert [(r.a, r.b, r.rule) for r in one.asserted.collect()] == [("4", "5", "rule/names")]
    due = {(r.a, r.b): r for r in one.deposits.collect()}
    assert set(due) == {("1", "2"), ("2", "3")}  # 1 and 3 are held distinct, 6 is gone, 4 and 5 are ruled
    assert due["1", "2"].score >= 0.6 and due["1", "2"].dated_at == day(8)
    assert {r.id for r in one.review.collect()} == {"1/2", "2/3"} and one.closed.count() == 0
    made = spark.createDataFrame([("", r.a, r.b, r.dated_at, r.score, False, r.features) for r in due.values()], DEPOSIT)
    two = run(spark, str(day(10)), deposits=made, settings=s, **world)
    assert two.deposits.count() == 0  # a rerun adds nothing
    later = run(spark, str(day(108)), deposits=made, settings=s, **world)
    assert {r.id for r in later.closed.collect()} == {"1/2", "2/3"} and later.review.count() == 0


def test_half_lives_by_kind(spark, world):
    """The same deposits as above: a long half-life keeps what the default lets go."""
    from factloom.model.vocabulary import kind_closure, kinds_frame

    closure = kind_closure(kinds_frame(spark, {"org.Squad": "Team"}))
    deposits = spark.createDataFrame([("", "1", "2", day(8), 0.9, False, ""), ("", "4", "5", day(8), 0.9, False, "")], DEPOSIT)
    world = world | {"seen": world["seen"].where("false"), "entities": world["entities"].withColumn("kind", F.when(F.col("cluster_id").isin("4", "5"), "org.Squad").otherwise(F.col("kind")))}
    s = Settings(half_lives=(("Team", 400.0), ("org.Squad", 20.0)))
    out = run(spark, str(day(108)), deposits=deposits, settings=s, closure=closure, **world)
    assert {r.id for r in out.closed.collect()} == {"4/5"} and [r.id for r in out.review.collect()] == ["1/2"]


def test_settings():
    with pytest.raises(ValueError):
        Settings(floor=0.5)
