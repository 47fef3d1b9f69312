"""Reads over facts with validity intervals: as-of filters, changes, merging, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = "9999-12-31 23:59:59.999999"


def lift(facts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Facts with ``subject_cluster`` and ``object_cluster`` (null for attributes), from ``clusters(record_id, cluster_id)``."""
    s = clusters.select(F.col("record_id").alias("subject_id"), F.col("cluster_id").alias("subject_cluster"))
    o = clusters.select(F.col("record_id").alias("object_id"), F.col("cluster_id").alias("object_cluster"))
    return facts.join(s, "subject_id").join(o, "object_id", "left")


def ts(at: str | Column) -> Column:
    return F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at


def holds_at(at: str | Column | None = None, *, asserted_only: bool = True) -> Column:
    """Now: the interval is open and the fact no self-loop of one cluster. At a time: the interval holds it.

    The two differ on purpose: a closed interval that ends in the future is no "now" answer, and
    self-loops are seen only at past times.
    """
    if at is None:
        holds = F.col("valid_to").isNull() & (F.col("object_cluster").isNull() | (F.col("object_cluster") != F.col("subject_cluster")))
    else:
        holds = (F.col("valid_from") <= ts(at)) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts(at)))
    return holds & (F.col("status") == "asserted") if asserted_only else holds


def facts_where(lifted: DataFrame, *, subject: str | None = None, predicate: str | None = None, obj: str | None = None, at: str | None = None, with_proposed: bool = False) -> DataFrame:
    """Facts that hold, about clusters; conditions that are not given are not part of the plan."""
    out = lifted.where(holds_at(at, asserted_only=not with_proposed))
    for column, value in (("subject_cluster", subject), ("predicate", predicate), ("object_cluster", obj)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def resolve(refs: DataFrame, clusters: DataFrame, alias: DataFrame) -> DataFrame:
    """``refs(ref)`` with ``cluster_id``: of the record with that id, else of the record that the key names, else null."""
    by_id = clusters.select(F.col("record_id").alias("ref"), F.col("cluster_id").alias("by_id"))
    by_key = alias.select(F.col("key").alias("ref"), F.col("entity_id").alias("record_id")).join(clusters, "record_id").select("ref", F.col("cluster_id").alias("by_key"))
    return refs.join(by_id, "ref", "left").join(by_key, "ref", "left").select("ref", F.coalesce("by_id", "by_key").alias("cluster_id"))


def changes(lifted: DataFrame, since: str, until: str, *, about: str | None = None, limit: int | None = None) -> DataFrame:
    """Openings and closings in [since, until): a fact may appear twice. One pass, no union of two scans."""
    rows = lifted.where(F.col("status") == "asserted")
    if about is not None:
        rows = rows.where((F.col("subject_cluster") == about) | (F.col("object_cluster") == about))
    inside = lambda c: (F.col(c) >= ts(since)) & (F.col(c) < ts(until))
    rows = rows.where(inside("valid_from") | inside("valid_to"))
    both = F.array(F.struct(F.lit("closed").alias("change"), F.col("valid_to").alias("at")), F.struct(F.lit("opened").alias("change"), F.col("valid_from").alias("at")))
    rows = rows.withColumn("c", F.explode(F.filter(both, lambda x: x["at"].isNotNull() & (x["at"] >= ts(since)) & (x["at"] < ts(until)))))
    rows = rows.select("*", F.col("c.change").alias("change"), F.col("c.at").alias("at")).drop("c")
    return rows.orderBy(F.desc("at"), "id", "change").limit(limit) if limit else rows


def merge_statements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per statement and island of overlapping or touching intervals.

    ``rows``: keys, valid_from, valid_to (null: open), confidence, qualifiers, last_observed, source_count.
    An island has the earliest from, the latest to (open wins), the largest confidence, the qualifiers
    observed last, and the *sum* of its rows' source counts.
    """
    end = F.coalesce("valid_to", ts(INF))
    w = Window.partitionBy(*keys).orderBy("valid_from", "valid_to", "id")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col("valid_from") > F.col("before")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).withColumn("before", before).withColumn("island", island)
    return rows.groupBy(*keys, "island").agg(
        F.min("valid_from").alias("valid_from"), F.when(F.max("end") == ts(INF), F.lit(None)).otherwise(F.max("end")).alias("valid_to"),
        F.max("confidence").alias("confidence"), F.max_by("qualifiers", F.struct("last_observed", "id")).alias("qualifiers"),
        F.sum("source_count").alias("source_count"), F.count("*").alias("merged"),
    ).drop("island")


def first_and_last_sources(fact_source: DataFrame, observation: DataFrame) -> DataFrame:
    """Per fact and source its first and last observation, and how many the fact has in all.

    Columns fact_id, source, first_id, first_at, last_id, last_at, source_count. A fact's sources are gathered (there are as many as
    systems), its observations never: they are aggregated where they lie after one shuffle by fact.
    """
    own = fact_source.join(observation.select(F.col("id").alias("observation_id"), "source", "observed_at"), "observation_id")
    seen = F.struct("observed_at", "observation_id")
    per = own.repartition("fact_id").groupBy("fact_id", "source").agg(F.min(seen).alias("first"), F.max(seen).alias("last"), F.count("*").alias("n"))
    per = per.groupBy("fact_id").agg(F.collect_list(F.struct("source", "first", "last")).alias("s"), F.sum("n").alias("source_count"))
    return per.select("fact_id", F.explode("s").alias("s"), "source_count").select(
        "fact_id", "s.source", F.col("s.first.observation_id").alias("first_id"), F.col("s.first.observed_at").alias("first_at"),
        F.col("s.last.observation_id").alias("last_id"), F.col("s.last.observed_at").alias("last_at"), "source_count",
    )


def support(fact_source: DataFrame, observation: DataFrame) -> DataFrame:
    """fact_id, source_count and last_observed of every supported fact."""
    own = fact_source.join(observation.select(F.col("id").alias("observation_id"), "observed_at"), "observation_id")
    return own.groupBy("fact_id").agg(F.count("*").alias("source_count"), F.max("observed_at").alias("last_observed"))


def backed_by_active(facts: DataFrame, fact_source: DataFrame, observation: DataFrame, active: list[str]) -> DataFrame:
    """Facts that some observation of an active kind backs (all, for no kinds)."""
    if not active:
        return facts
    ids = fact_source.join(observation.where(F.col("kind").isin(active)).select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
    return facts.join(ids.select(F.col("fact_id").alias("id")), "id", "left_semi")
