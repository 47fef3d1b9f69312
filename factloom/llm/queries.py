"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .annsearch import nearest
from .bitplane import token_planes
from .decontam import leaks
from .hostrep import judge, labels_of
from .htmlcut import extract
from .jaccard_join import jaccard_components
from .langid import identify
from .licenses import scan
from .oracle import ORACLE
from .packing import pack
from .quotes import reply_order

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as shuffled planes and read back."""
    return token_planes(spark, table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those outside the held-out fold."""
    return identify(spark, table(spark, sf_dir, "documents"))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector, among all."""
    return nearest(spark, table(spark, sf_dir, "embeddings"))


def op4_min_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark, table(spark, sf_dir, "pages"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return scan(spark, table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that link by the Jaccard similarity of their shingles."""
    return jaccard_components(spark, table(spark, sf_dir, "documents"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, with the message it replies to."""
    return reply_order(spark, table(spark, sf_dir, "conversations"))


def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url, by rules and then by its host's labelled pages."""
    return judge(spark, table(spark, sf_dir, "pages"), labels_of(table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences."""
    return pack(spark, table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, exactly or edited."""
    return leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    own = (
        op1_bit_planes, op2_language_id, op3_additive_quantisation, op4_min_cut, op5_license_scan,
        op6_jaccard_join, op7_quotation_linking, op8_host_reputation, op9_packing, op10_decontamination,
    )
    return {q.__name__: q for q in own}


def oracle_sql() -> dict[str, str]:
    """Op3 is exact where a block scores all its vectors exactly, as at the size that is compared."""
    return dict(ORACLE)
