"""Stores by URL, JSON answers, and a Python data source for paged APIs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = ("observation", "entity", "alias", "fact", "fact_source", "identity_link", "link_deposit", "link_decision", "kind", "kind_predicate", "event_log", "event_commit")


class Store:
    """Tables of one store: ``mem://name`` are temporary views, any other URL or path is a folder of Parquet tables."""

    def __init__(self, spark: SparkSession, url: str):
        parts = urlparse(url)
        if parts.scheme == "mem":
            self.prefix, self.path = f"mem_{parts.netloc or 'store'}_", None
        elif url and not url.startswith("duckdb:"):
            self.prefix, self.path = "", url.rstrip("/")
        else:
            raise ValueError(f"no store for {url!r}")
        self.spark = spark

    def read(self, table: str) -> DataFrame:
        if table not in TABLES:
            raise ValueError(f"unknown table {table}")
        return self.spark.table(self.prefix + table) if self.path is None else self.spark.read.parquet(f"{self.path}/{table}")

    def write(self, table: str, df: DataFrame, *, by: tuple[str, ...] = ()) -> None:
        """Facts are partitioned ``by`` predicate, so that a question reads what it asks for."""
        if table not in TABLES:
            raise ValueError(f"unknown table {table}")
        if self.path is None:
            df.createOrReplaceTempView(self.prefix + table)
        else:
            df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{table}")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row; characters that terminals act on are escaped."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    acts = r"[\u0080-\u009f\u200b-\u200f\u2028-\u202e\u2066-\u2069]"
    chars = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(acts), F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c))), 4, "0"))).otherwise(c))
    return df.select(F.when(text.rlike(acts), F.array_join(chars, "")).otherwise(text).alias("json"))


class _Source(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagedSource(DataSource):
    """``spark.read.format("paged").option("sources", "a,b").load()``: one partition per source.

    A subclass or :func:`paged_source` gives ``fetch(source, cursor) -> (rows, next cursor)``; rows are tuples of the
    schema. A cursor that does not move ends the read with an error, so a half read never looks complete.
    """

    fetch: Callable[[str, str | None], tuple[list[tuple], str | None]]
    columns = "source string, id string, data string"

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(type(self).fetch, self.options.get("sources", "").split(","), int(self.options.get("pages", "1000")))


class _PagedReader(DataSourceReader):
    def __init__(self, fetch, sources: list[str], most: int):
        self.fetch, self.sources, self.most = fetch, [s for s in sources if s], most

    def partitions(self) -> list[_Source]:
        return [_Source(s) for s in self.sources]

    def read(self, partition: _Source) -> Iterator[tuple]:
        cursor, seen = None, set()
        for _ in range(self.most):
            rows, following = self.fetch(partition.name, cursor)
            yield from ((partition.name, *r) for r in rows)
            if following is None:
                return
            if following in seen:
                raise RuntimeError(f"{partition.name}: the cursor did not move")
            seen.add(following)
            cursor = following
        raise RuntimeError(f"{partition.name}: more than {self.most} pages")


def paged_source(spark: SparkSession, label: str, fetch: Callable[[str, str | None], tuple[list[tuple], str | None]]) -> None:
    """Register a paged source under ``label``."""
    cls = type(f"Paged_{label}", (PagedSource,), {"fetch": staticmethod(fetch), "name": classmethod(lambda c: label)})
    spark.dataSource.register(cls)
