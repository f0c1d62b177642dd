"""The cleaning pipeline: documents in, packed sequences out.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written and
read again before the next one. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontamination, language_id, line_dedup, near_dedup, packing
from veilspark.llm.tables import bucket, table
from veilspark.session import store


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: null texts and texts without a letter.

    Ambiguous texts stay: the flag says that two languages are close, not that the text is bad.
    The model is learned from the given documents outside the held-out quarter.
    """
    training = table(spark, sf_dir, "documents").where(bucket("doc_id", 4) != 2).select("doc_id", "text", "lang")
    found = language_id.identify(docs, training)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of passages; documents of which nothing is left go. n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs)
    kept = cleaned.where("n_deleted_lines = 0 OR trim(text) != ''")
    changed = F.when(F.col("n_deleted_lines") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", changed).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest id."""
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(store(gone, "near-duplicates"), F.col("doc_id") == F.col("gone"), "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the benchmark contaminates."""
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(store(gone, "contaminated"), F.col("doc_id") == F.col("gone"), "left_anti")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", languages),
    ("line dedup", lines),
    ("near dedup", near_duplicates),
    ("decontamination", benchmark),
    ("packing", sequences),
]

#: The classifier and the tokenizer have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
