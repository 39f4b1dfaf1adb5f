"""From raw documents to tokens: toxicity, line dedup, near-duplicates, decontamination, BPE.

Each stage takes all rows that the one before kept. Toxic documents go; lines that
documents repeat go from all but the first of them, and so do documents that such lines made up whole; one document of each group of
near-duplicates stays; documents that hold a passage of the benchmark go; the last stage
gives each document's tokens as counts and digests.

Defined cases, beyond what the stages' modules state: a NULL text goes through as an empty one
from the second stage on, and of all texts without words one stays. Rows that repeat are
copies, of which one stays. Rows without a doc_id stay if no row with one has their
fingerprint. Very long texts are worked on whole. Other columns are carried to the last stage, whatever their names.
An empty table, of documents, labels or items, gives what the others leave: no rows, no toxic
documents, no passages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kartei.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from kartei.plans.storage import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeated_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can not say the scores of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
