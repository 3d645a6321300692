"""From raw documents to tokens: language, exact and near duplicates, mixture, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet in
the shared folder and read back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitaframe.llm import bpe, exact, langid, mixing, simhash
from vitaframe.llm.common import written
from vitaframe.llm.queries import RANKS
from vitaframe.sources.tables import table


#: Texts that go to Python at a time.
BATCH = 500


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that no learned language has, null texts and texts without a letter go; a short text of doubtful language stays."""
    few_texts_at_a_time(spark)
    return langid.of_known_language(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact.one_of_each_text(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (fingerprints of three-word shingles, 2 differing bits) the one with the smallest id stays."""
    few_texts_at_a_time(spark)
    return simhash.one_of_each_group(docs, shingle=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their weights: a document comes as often as the mix takes it."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and a check of the way back, per row of the mixture."""
    few_texts_at_a_time(spark)
    return bpe.round_trip(docs, RANKS).withColumnRenamed("id", "doc_id")


def few_texts_at_a_time(spark: SparkSession) -> None:
    """Whole texts go to Python in small batches: a batch lies in the memory of the JVM and of its Python worker, which keep it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(now, BATCH) if now > 0 else BATCH))


STAGES = [
    ("language", known_language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL has neither the language model nor SimHash nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
