"""Structured Streaming ingest: files of observations become the append-only log, one idempotent micro-batch at a time.

There is no watermark: late observations are handled by their values when the log is folded, and ids are
deduplicated for ever by an anti-join with the log.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.schemas import ENVELOPE
from ..sources import observations


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def apply_batch(spark: SparkSession, log: str, rejected: str, batch: DataFrame, batch_id: int) -> None:
    """Append what is new of a batch under ``batch=<id>``; malformed observations go to ``rejected``.

    A replayed batch overwrites its own folder, and earlier batches alone are the log it is compared with.
    """
    d = observations.decode(batch).withColumn("observed_at", F.try_to_timestamp("time").cast("timestamp_ntz"))
    d = d.withColumn("malformed", d.malformed | F.col("observed_at").isNull() | F.col("id").isNull())
    d.where("malformed").drop("o").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")
    good = d.where("NOT malformed").withColumn("seq", F.lit(batch_id).cast("long") * F.lit(1 << 33) + F.monotonically_increasing_id() % F.lit(1 << 33))
    try:
        earlier = spark.read.parquet(log).where(F.col("batch") < batch_id)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        earlier = None
    observations.append(earlier, good.select("id", "source", "type", "observed_at", "seq", "malformed", "o")).write.mode("overwrite").parquet(f"{log}/batch={batch_id}")


def ingest(spark: SparkSession, inbox: str, log: str, *, checkpoint: str, rejected: str, after: Callable[[int], None] | None = None, files: int = 100):
    """A query that drains ``inbox`` (NDJSON files) into ``log``; ``after`` runs once per batch, e.g. to match again."""

    def batch(df: DataFrame, batch_id: int) -> None:
        apply_batch(spark, log, rejected, df, batch_id)
        if after is not None:
            after(batch_id)

    stream = spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files).json(inbox)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Coalesced:
    """Runs ``work`` after requests, one run at a time and at most one more pending: what asks during a run shares the next one.

    For ``after`` of :func:`ingest`: matching then never holds up a batch. A run that fails is told to ``failed`` and does not end the worker.
    """

    def __init__(self, work: Callable[[], None], failed: Callable[[Exception], None] | None = None):
        self._work, self._failed = work, failed
        self._wake, self._stop, self._idle = threading.Event(), threading.Event(), threading.Condition()
        self._asked = self._done = 0
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def __call__(self, batch_id: int | None = None) -> None:
        with self._idle:
            self._asked += 1
        self._wake.set()

    def _loop(self) -> None:
        while self._wake.wait() and not self._stop.is_set():
            self._wake.clear()
            with self._idle:
                upto = self._asked
            try:
                self._work()
            except Exception as e:  # the next request may do better
                if self._failed is not None:
                    self._failed(e)
            with self._idle:
                self._done = upto
                self._idle.notify_all()

    def drain(self, timeout: float | None = None) -> bool:
        """Wait until a run has begun after the last request and ended."""
        with self._idle:
            return self._idle.wait_for(lambda: self._done >= self._asked, timeout)

    def close(self) -> None:
        self._stop.set()
        self._wake.set()
        self._thread.join()


def completions(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """(source, started) of complete reads: the earliest time that was kept, unless anything of the source was rejected."""
    whole = kept.groupBy("source").agg(F.min("observed_at").alias("started"))
    return whole.join(rejected.select("source").distinct(), "source", "left_anti")
