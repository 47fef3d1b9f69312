"""How well the transparent matcher does on labelled pairs: precision, recall and candidate recall by group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching


def evaluate(clusters: DataFrame, members: DataFrame, emails: DataFrame, labels: DataFrame, *, propose_at: float = matching.PROPOSE_AT) -> DataFrame:
    """grp, cases, true_pairs, proposed_true, proposed_false, candidates_true; the group ``all`` sums the others.

    ``clusters(cluster_id, kind, name)``, ``members(cluster_id, member)``, ``emails(cluster_id, email)``,
    ``labels(grp, a, b, same)`` with a < b. Pairs without a label are different things; they are the group ``unlabelled``.
    """
    none = clusters.sparkSession.createDataFrame([], "a string, b string")
    found = matching.score(matching.candidates(clusters, members, none), clusters, members, emails)
    found = found.select("a", "b", (F.col("score") >= propose_at).alias("proposed"))
    j = labels.join(found, ["a", "b"], "full_outer").select(
        F.coalesce("grp", F.lit("unlabelled")).alias("grp"), F.col("grp").isNotNull().alias("labelled"), F.coalesce("same", F.lit(False)).alias("same"),
        F.col("proposed").isNotNull().alias("candidate"), F.coalesce("proposed", F.lit(False)).alias("proposed"),
    )
    per = j.groupBy("grp").agg(
        F.count_if("labelled").alias("cases"), F.count_if("same").alias("true_pairs"), F.count_if(F.col("same") & F.col("proposed")).alias("proposed_true"),
        F.count_if(~F.col("same") & F.col("proposed")).alias("proposed_false"), F.count_if(F.col("same") & F.col("candidate")).alias("candidates_true"),
    )
    numbers = per.columns[1:]
    return per.unionByName(per.agg(*[F.sum(n).alias(n) for n in numbers]).select(F.lit("all").alias("grp"), *numbers))
