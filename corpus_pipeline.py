"""Cleaning of a text corpus in stages, each over what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's ``docs``. All but the last return
the columns of ``documents``. Ids tell rows apart; rows whose id is null pass a
stage that decides by id.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import decontaminate, line_dedup, near_dedup, pieces, quality
from matchlake.llm.common import remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those whose id has ``kept`` false."""
    gone = verdicts.where(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the perplexity band of their language."""
    return _without(docs, quality.assess(docs).select("doc_id", "kept"))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand in ten documents or more.

    The lines go from every document, so ten or more whole copies all end without text and none of them stays
    for near dedup to keep.
    """
    found = line_dedup.keep_bitmaps(docs, extra=["lang", "source"])
    text = line_dedup.kept_text(F.col("text"), F.col("n_dropped"), F.col("keep_runs"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more): the one with the smallest id."""
    return _without(docs, near_dedup.near_duplicates(docs, percent=80).select("doc_id", "kept"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, number of ids, and digests of the ids and of the text they decode to."""
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", repeated_lines),
    ("near dedup", near_copies),
    ("decontamination", benchmark_leaks),
    ("pieces", piece_ids),
]

# The perplexity model of the first stage cannot be stated in SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The stages over ``documents``; stage n's table is written to ``folder/n``.

    ``folder`` defaults to a new one under ``spark.checkpoint.dir``. A stage's
    table is deleted as soon as the next one is written; the last one written
    stays, as the returned DataFrame reads it: the caller removes ``folder``
    once done with the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            remove(spark, f"{folder}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
