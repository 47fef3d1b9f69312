"""Kinds, predicates and the operators on the kind hierarchy: the vocabulary is data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The core kinds, relations (domain -> range) and attributes that answers depend on.
CORE_KINDS = ("Person", "Team", "Repository", "Component", "Package", "Environment", "CloudResource", "Change", "Incident", "Schedule", "Document")
RELATIONS = (
    "member_of", "owned_by", "approves_changes", "depends_on", "publishes", "consumes", "deployed_to",
    "runs_on", "on_call_for", "affected_by", "documents", "changed_by", "defined_in",
)
ONE_RELATIONS = ("defined_in",)
MANY_ATTRIBUTES = ("email", "verified_email", "commit_email", "topics", "runtime", "versions")
CORE_ONLY = ("same_as", "distinct_from")
IMPLICIT = ("exists",)


class VocabularyError(ValueError):
    """A change to the vocabulary that would lose or narrow what is stored."""


def check_kinds(kinds: dict[str, str | None]) -> None:
    """Refuse unknown parents, cycles and configured kinds without a namespace."""
    for name, parent in kinds.items():
        if name not in CORE_KINDS and "." not in name:
            raise VocabularyError(f"{name}: a configured kind is <namespace>.<Kind>")
        seen, k = {name}, parent
        while k is not None:
            if k not in kinds:
                raise VocabularyError(f"{name}: unknown parent {k}")
            if k in seen:
                raise VocabularyError(f"{name}: its parents form a cycle")
            seen.add(k)
            k = kinds[k]


def kinds_frame(spark: SparkSession, configured: dict[str, str | None] | None = None) -> DataFrame:
    kinds: dict[str, str | None] = {k: None for k in CORE_KINDS} | (configured or {})
    check_kinds(kinds)
    return spark.createDataFrame(list(kinds.items()), "name string, parent string")


def kind_closure(kinds: DataFrame) -> DataFrame:
    """(descendant, ancestor, depth) of ``kinds(name, parent)``, every kind being its own at depth 0.

    Kinds are configuration, so the table is small; it grows by one level a round.
    """
    level = kinds.select(F.col("name").alias("descendant"), F.col("name").alias("ancestor"), F.lit(0).alias("depth"))
    out, depth = level, 0
    parents = kinds.where("parent IS NOT NULL").select(F.col("name").alias("ancestor"), F.col("parent").alias("up"))
    while not (level := level.join(parents, "ancestor").select("descendant", F.col("up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))).isEmpty():
        depth += 1
        if depth > 64:
            raise VocabularyError("kinds nest deeper than 64 levels")
        out = out.unionByName(level)
    return out


def with_descendants(rows: DataFrame, closure: DataFrame, kinds: list[str], column: str = "kind") -> DataFrame:
    """Rows whose kind is one of ``kinds`` or below; all rows for no kinds."""
    if not kinds:
        return rows
    own = closure.where(F.col("ancestor").isin(kinds)).select(F.col("descendant").alias(column)).distinct()
    return rows.join(F.broadcast(own), column, "left_semi")  # as many rows as configured kinds, at most


def deeper(closure: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``deeper``: the one below the other, null if they are not on one line; '' gives way."""
    c = closure.select(F.col("descendant").alias("x"), F.col("ancestor").alias("y"), F.lit(True).alias("below"))
    j = pairs.join(F.broadcast(c.toDF("a", "b", "a_below")), ["a", "b"], "left").join(F.broadcast(c.toDF("b", "a", "b_below")), ["a", "b"], "left")
    pick = F.when(F.col("a") == "", F.col("b")).when(F.col("b") == "", F.col("a")).when(F.col("a_below"), F.col("a")).when(F.col("b_below"), F.col("b"))
    return j.select("a", "b", pick.alias("deeper"))


def sync_kinds(stored: DataFrame, configured: DataFrame, now: str) -> DataFrame:
    """Grow-only persistence: new kinds are added, missing ones are retired at ``now``, returning ones revived.

    ``stored(name, parent, added_at, retired_at)``, ``configured(name, parent)``. A changed parent is refused.
    """
    own = configured.select("name", F.col("parent").alias("new_parent"), F.lit(True).alias("here"))
    j = stored.join(own, "name", "full_outer")
    wrong = j.where("added_at IS NOT NULL AND here AND NOT (parent <=> new_parent)")
    if bad := wrong.select("name").head(5):
        raise VocabularyError(f"parent changed: {[r.name for r in bad]}")
    at = F.lit(now).cast("timestamp_ntz")
    return j.select(
        "name", F.coalesce("parent", "new_parent").alias("parent"), F.coalesce("added_at", at).alias("added_at"),
        F.when(F.col("here"), F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce("retired_at", at)).alias("retired_at"),
    )
