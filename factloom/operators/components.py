"""Connected components of an edge table, without gathering the graph in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import Written


def connected_components(edges: DataFrame, written: Written, *, name: str = "cc", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every node of ``edges(a, b)``: component is the smallest id it reaches.

    Alternating large-star and small-star steps: each replaces a node's links by links to its
    smallest neighbour, so the graph shrinks to stars in a few rounds. Every round is a written
    table; one aggregate per round reaches the driver. A star's centre may have any number of links:
    each step is a partially aggregated minimum and one join back. Labels that have not settled after
    ``most_rounds`` are an error, never a result.
    """
    e = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    now = written.write(e, f"{name}-0")
    state = _state(now)
    for k in range(1, most_rounds + 1):
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small-star: every node's smaller neighbours, and itself, to the smallest of them
        small_low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("x"))
        new = written.write(small.select("x.a", "x.b").where("a <> b").distinct(), f"{name}-{k}")
        written.drop(f"{name}-{k - 1}")
        now, last = new, state
        state = _state(now)
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    stars = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h
