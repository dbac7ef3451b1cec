"""Cleaning of a document corpus: five operators, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.llm import op1_toxicity, op3_line_dedup, op4_minhash, op5_sentencepiece, op6_decontamination
from forja.llm.common import documents, table, unused, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the grammar learns from the labels of these documents.

    Null and empty texts score the bias and stay; repeated rows stay or go together; an empty table gives no row.
    """
    point = unused(docs, "_score")
    scored = op1_toxicity.score(docs, op1_toxicity.trained(spark, docs, sf_dir), out=point)
    return scored.filter(F.col(point) < op1_toxicity.THRESHOLD).drop(point)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their source's boilerplate lines; ``n_chars`` follows the text, emptied texts stay as ''."""
    cut = op3_line_dedup.drop_lines(docs).drop("n_lines", "n_dropped")
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return op4_minhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; repeated rows stay or go together; without documents or items nothing goes.
    """
    return op6_decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, their number, and whether the ids decode to the very text."""
    rows = op5_sentencepiece.encode(docs, op5_sentencepiece.load(), exact="exact")
    return rows.withColumn("n_tokens", F.coalesce(F.size("ids"), F.lit(0)))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash", minhash),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: The grammar of the first stage and the encoder of the last are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of a data folder."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(spark, docs, name)
    return docs
