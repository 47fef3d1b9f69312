"""One matching run as a batch: key rules, candidates, scores, deposits, closing by decay, review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from ..operators.temporal import ts
from .written import Written


@dataclass
class Settings:
    floor: float = matching.FLOOR
    review_at: float = matching.REVIEW_AT
    propose_at: float = matching.PROPOSE_AT
    half_life_days: float = matching.HALF_LIFE_DAYS
    rules: tuple[tuple[str, str, str], ...] = ()
    """(name, left key pattern, right key pattern), each with ``{name}``"""
    half_lives: tuple[tuple[str, float], ...] = ()
    """(kind, days): for things of that kind or below, unless a nearer kind has its own"""

    def __post_init__(self) -> None:
        matching.check_settings(self.floor, self.review_at, self.propose_at)


@dataclass
class Outcome:
    asserted: DataFrame
    """(a, b, rule): pairs that a key rule asserts"""
    deposits: DataFrame
    """(a, b, score, dated_at, features): proposals that are made or reinforced"""
    closed: DataFrame
    """(id): open proposals that have decayed below the floor"""
    review: DataFrame


def skip(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b) of clusters that an open distinct_from, of any status, or an open asserted same_as connects."""
    c = clusters.select("record_id", "cluster_id")
    live = links.where("valid_to IS NULL AND (kind = 'distinct_from' OR status = 'asserted')")
    j = live.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b").where("ca <> cb")
    return j.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()


def features(scored: DataFrame) -> DataFrame:
    """Features as one canonical text: a matcher deposits again when it changes."""
    parts = [F.concat(F.lit(f"{c}="), F.round(F.col(c).cast("double"), 6).cast("string")) for c in ("name_jw", "members", "shared_email")]
    return scored.withColumn("features", F.concat_ws(";", *parts))


def run(
    spark: SparkSession, now: str, entities: DataFrame, keys: DataFrame, members: DataFrame, emails: DataFrame, seen: DataFrame, links: DataFrame, clusters: DataFrame, deposits: DataFrame,
    settings: Settings | None = None, matcher: matching.Matcher | None = None, closure: DataFrame | None = None,
) -> Outcome:
    """``entities(cluster_id, kind, name)``, ``keys(cluster_id, key)``, ``members(cluster_id, member)``, ``emails(cluster_id, email)``,
    ``seen(cluster_id, last_seen)`` (null: gone), ``links(id, a, b, kind, status, valid_from, valid_to)`` of records,
    ``clusters(record_id, cluster_id)``, ``deposits(id, a, b, deposited_at, weight, against, features)`` of links between clusters,
    ``closure`` of kinds, for half-lives by kind.
    """
    s, w = settings or Settings(), Written(spark, "match")
    barred = w.write(skip(links, clusters), "barred")
    ruled = None
    for name, left, right in s.rules:
        pairs = matching.key_rule_pairs(keys, left, keys, right).select("a", "b").join(barred, ["a", "b"], "left_anti").withColumn("rule", F.lit(f"rule/{name}"))
        ruled = pairs if ruled is None else ruled.unionByName(pairs)
    ruled = w.write(ruled.groupBy("a", "b").agg(F.min("rule").alias("rule")) if ruled is not None else barred.limit(0).withColumn("rule", F.lit("")), "ruled")
    pairs = w.write(matching.candidates(entities, members, barred.unionByName(ruled.select("a", "b"))), "candidates")
    scored = matcher(pairs, entities) if matcher is not None else features(matching.score(pairs, entities, members, emails))
    date = seen.select("cluster_id", "last_seen")
    scored = scored.join(date.toDF("a", "da"), "a", "left").join(date.toDF("b", "db"), "b", "left")
    scored = scored.withColumn("dated_at", matching.evidence_date(F.col("da"), F.col("db"))).drop("da", "db")
    # both ends of a pair are of one kind, so the first tells its half-life
    kind = F.lit(s.half_life_days)
    life = entities.select(F.col("cluster_id").alias("a"), "kind").distinct()
    if s.half_lives:
        own = matching.half_lives(closure, spark.createDataFrame(list(s.half_lives), "kind string, half_life double"), s.half_life_days)
        life = life.join(F.broadcast(own), "kind", "left")  # kinds are configuration
        kind = F.coalesce("half_life", kind)
    life = w.write(life.select("a", kind.alias("half_life")), "half-lives")
    lasting = lambda df: df.join(life, "a", "left").withColumn("half_life", F.coalesce("half_life", F.lit(s.half_life_days)))
    undone = links.where("kind = 'distinct_from' AND valid_to IS NOT NULL").groupBy("a", "b").agg(F.max("valid_to").alias("undone_at"))
    last = deposits.groupBy("a", "b").agg(F.max("deposited_at").alias("last_at"), F.max_by("features", "deposited_at").alias("last_features")).join(undone, ["a", "b"], "full_outer")
    due = w.write(matching.deposits_due(lasting(scored), last, propose_at=s.propose_at, half_life_days=F.col("half_life")), "due")
    made = due.select("a", "b", F.col("dated_at").alias("deposited_at"), F.col("score").alias("weight"), F.lit(False).alias("against"))
    every = lasting(deposits.select("a", "b", "deposited_at", "weight", "against").unionByName(made).where(F.col("deposited_at") <= ts(now)))
    every = every.withColumn("id", F.concat_ws("/", "a", "b"))
    strengths = w.write(matching.decayed(every, now, key=["id"], half_life_days=F.col("half_life")), "strengths")
    gone = matching.to_close(strengths, floor=s.floor).select("id")
    return Outcome(ruled, due, gone, matching.review(strengths, review_at=s.review_at))
