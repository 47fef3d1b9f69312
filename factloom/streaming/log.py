"""The partitioned event log: ordered within a partition, at-least-once, deduplicated by id.

A log is a folder of files; a micro-batch is one file. Batch operators work on ``log(part, off, id, at,
bytes, retain)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_BYTES, PAGE_EVENTS, PAGE_BYTES = 8 << 20, 1_000, 32 << 20


class LogError(ValueError):
    """A request that the log's contract does not allow."""


def read_page(log: DataFrame, *, after: int | DataFrame = 0, limit: int = PAGE_EVENTS, most_bytes: int = PAGE_BYTES) -> DataFrame:
    """Per partition the events after an offset, up to ``limit`` and ``most_bytes``, but at least one.

    ``after`` is one offset for all, or ``(part, off)`` committed offsets (no row: from the start).
    """
    if not 1 <= limit <= PAGE_EVENTS:
        raise LogError(f"a page has 1 to {PAGE_EVENTS} events")
    if isinstance(after, int):
        rows = log.where(F.col("off") > after)
    else:
        rows = log.join(after.withColumnRenamed("off", "done"), "part", "left").where(F.col("off") > F.coalesce("done", F.lit(0))).drop("done")
    w = Window.partitionBy("part").orderBy("off")
    # row_number() <= limit is cut on the map side, before the running sum's sort
    first = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("total", total).where((F.col("n") == 1) | (F.col("total") <= most_bytes)).drop("n", "total")


def heads(log: DataFrame) -> DataFrame:
    return log.groupBy("part").agg(F.max("off").alias("head"), F.sum(F.col("retain").cast("long")).alias("retained"), F.min("at").alias("oldest"))


def append(log: DataFrame | None, events: DataFrame) -> DataFrame:
    """New rows with offsets after each partition's head; ids that the log or the batch has already are left out.

    ``events(part, id, seq, ...)``: seq orders the batch.
    """
    first = events.groupBy("id").agg(F.min_by(F.struct(*events.columns), "seq").alias("e")).select("e.*")
    if log is not None:
        first = first.join(log.select("id"), "id", "left_anti")
        first = first.join(log.groupBy("part").agg(F.max("off").alias("head")), "part", "left")
    else:
        first = first.withColumn("head", F.lit(None).cast("long"))
    n = F.row_number().over(Window.partitionBy("part").orderBy("seq", "id"))
    return first.withColumn("off", F.coalesce("head", F.lit(0)) + n).drop("head")


def commit(commits: DataFrame, log: DataFrame, group: str, offsets: DataFrame) -> DataFrame:
    """``commits(grp, part, off)`` after a group commits ``offsets(part, off)``: never back, never beyond the head."""
    over = offsets.join(heads(log).select("part", "head"), "part", "left").where(F.col("off") > F.coalesce("head", F.lit(0)))
    if bad := over.select("part").head(3):
        raise LogError(f"a commit beyond the head of {[r.part for r in bad]}")
    new = offsets.select(F.lit(group).alias("grp"), "part", "off")
    return commits.select("grp", "part", "off").unionByName(new).groupBy("grp", "part").agg(F.max("off").alias("off"))


def trimmable(log: DataFrame, commits: DataFrame, groups: list[str], before: str) -> DataFrame:
    """Rows that may go: not retained, older than ``before``, and committed by every required group."""
    own = commits.where(F.col("grp").isin(groups)).groupBy("part").agg(F.min("off").alias("done"), F.countDistinct("grp").alias("n")).where(F.col("n") == len(set(groups)))
    old = log.where(~F.col("retain") & (F.col("at") < F.lit(before).cast("timestamp_ntz")))
    return old.join(own, "part").where(F.col("off") <= F.col("done")).drop("done", "n")


def release(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The log with ``retain`` cleared for ``ids(id)``."""
    return log.join(ids.select("id", F.lit(True).alias("free")), "id", "left").withColumn("retain", F.col("retain") & ~F.coalesce("free", F.lit(False))).drop("free")


def check_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) events: bad ones have no id, no partition, or more than 8 MiB."""
    bad = F.col("id").isNull() | (F.col("id") == "") | F.col("part").isNull() | (F.col("part") == "") | (F.coalesce("bytes", F.lit(0)) > EVENT_BYTES)
    return events.where(~bad), events.where(bad)


def follow(spark: SparkSession, path: str, schema: str, apply: Callable[[DataFrame, int], None], *, checkpoint: str, dead_letters: str, files: int = 1, attempts: int = 5):
    """A streaming query over the log's files: ``apply(batch, id)`` in order, what it cannot take to a side folder.

    A batch that fails for good is not lost and does not stop the stream: its rows go to ``dead_letters``
    with the reason. The checkpoint holds the committed offsets; a replayed batch has the same id.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        good, bad = check_events(df)
        reason = None
        for k in range(attempts):
            try:
                apply(good, batch_id)
                reason = None
                break
            except ValueError as e:  # what no retry mends
                reason = str(e)
                break
            except Exception as e:
                reason = str(e)
                if k + 1 == attempts:
                    break
        lost = bad.withColumn("reason", F.lit("contract"))
        if reason is not None:
            lost = lost.unionByName(good.withColumn("reason", F.lit(reason[:1024])))
        lost.write.mode("overwrite").parquet(f"{dead_letters}/batch={batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letter_count(spark: SparkSession, dead_letters: str) -> int:
    return spark.read.parquet(dead_letters).count()


def lag(log: DataFrame, commits: DataFrame, group: str, now: str) -> DataFrame:
    """part, unapplied, oldest, lag_seconds of what a group has not committed yet."""
    own = commits.where(F.col("grp") == group).select("part", F.col("off").alias("done"))
    rest = log.join(own, "part", "left").where(F.col("off") > F.coalesce("done", F.lit(0)))
    age = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))
    return rest.groupBy("part").agg(F.count("*").alias("unapplied"), F.min("at").alias("oldest"), (age / 1e6).alias("lag_seconds"))
