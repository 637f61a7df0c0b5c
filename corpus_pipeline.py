"""Corpus pipeline: language ID, line dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return documents with
its columns. Stages 7, 8, 6, 5 and 10 of the operator list, in this order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jumpmark.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from jumpmark.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined (null text or no letter) go; lang becomes the prediction.

    Rows with a null key teach nothing but are judged as any other; repeated rows are judged alike.
    """
    model = language_id.train(docs, ~language_id.held_out() & F.col("doc_id").isNotNull())
    out = language_id.label(docs, model)
    predicted = F.col(out.columns[-2])
    return out.where(predicted != language_id.UND).withColumn("lang", predicted).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; a document that loses lines and has no word left goes with them. n_chars follows the text.

    Null text and rows with a null key stay as they are; repeated rows of a key are one document and change alike.
    """
    out = line_dedup.dedup(docs)
    gone = F.col(out.columns[-1])
    out = out.where((gone == 0) | line_dedup.has_words())
    out = out.withColumn("n_chars", F.when(gone > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest id stays.

    Documents without words and rows with a null key stay; repeated rows of the key that stays stay all.
    """
    return ngram_join.keep_one(docs, shingle=5, threshold=80)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, all rows of their key with them. Null text holds none."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"), mode="document")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's pieces and their bins; null text and text without words give a piece without a bin."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("packing", pack),
]
#: Language ID and packing cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
