"""The corpus pipeline: stages over ``documents``, each written and read again before the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), docs being all that its
predecessor kept, and returns what it keeps. All but the last return the columns of documents.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import Scratch
from factloom.llm.decontam import without_leaks
from factloom.llm.jaccard_join import without_copies
from factloom.llm.langid import in_some_language
from factloom.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Predictions below this share are rejected; on held-out documents none of the right ones are.
LEAST_SCORE = 0.4
#: What links near copies.
SHINGLE_WORDS, SIMILARITY = 5, Fraction(4, 5)
#: Items of one or two words stand in clean text by chance; op10 reports them, the filter does not go by them.
LEAST_ITEM_WORDS = 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: those without a letter, and those no language is likely for."""
    return in_some_language(spark, docs.select(*COLUMNS), least_score=LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join (five words, similarity of 0.8 or more) the text with the smallest doc_id stays.

    Rows that repeat doc_id and text count once; other texts of a doc_id are judged by themselves. Rows without
    doc_id take no part in links and stay.
    """
    return without_copies(spark, docs.select(*COLUMNS), words=SHINGLE_WORDS, similarity=SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item of at least ``LEAST_ITEM_WORDS`` words, exactly or edited, go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_leaks(spark, docs.select(*COLUMNS), items, least_words=LEAST_ITEM_WORDS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents, packed: one row for each piece."""
    return pack(spark, docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Learned language identification and tokenizing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
