"""A corpus pipeline: five stages that turn ``documents`` into token ids, each written as Parquet and read again.

1. quality        documents that the quality classifier rejects go;
2. near_dedup     one document of each group of near copies stays (shingles of five words, similarity 0.8);
3. decontaminate  documents that share ten consecutive words with a benchmark item go;
4. secrets        secrets in the texts are masked;
5. bpe            texts become token ids, which are decoded again to show that nothing is lost.  Special tokens in a text are ordinary text.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables, and returns the columns of ``documents`` (and
any others that it is given, whatever their names) but for the last one.  Null texts have no words: they are judged as empty texts, have no copies and
are never contaminated; a document without doc_id has no copies either.  Rows that repeat a doc_id are one document: the least by text stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, decontamination, near_dedup, quality_model, secret_scan
from terrafold.llm.common import removed, shared_folder, table


#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> bool:
    """Let batches of texts be small, unless the session says how large they are; returns whether it didn't.

    A stage's result is written by whoever runs it, so a stage leaves this set; ``run`` takes it back.
    """
    unset = spark.conf.get(BATCH_ROWS, None) is None
    if unset:
        spark.conf.set(BATCH_ROWS, "1000")
    return unset


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    small_batches(spark)
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, name="__score")
    return scored.where(F.col("__score") >= quality_model.THRESHOLD).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return near_dedup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with masked secrets; n_chars, where there is such a column, counts the new text."""
    small_batches(spark)
    found = secret_scan.find_secrets(docs, names=("__base", "__found"))
    masked = secret_scan.masked(found, spans="__found")
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars")))
    return masked.select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document (binary, little-endian unsigned 32-bit integers), and whether they decode to its text."""
    small_batches(spark)
    made = bpe.encode_and_decode(docs.select("doc_id", "lang", "source", "text"), bpe.vocabulary_path(), specials=False)
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return made.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids", exact.alias("exact"))


STAGES = [("quality", quality), ("near_dedup", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("bpe", encode)]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written in the shared folder and read again, and removed once the next one is written."""
    folder, unset = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", small_batches(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            own = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(own)
            docs = spark.read.parquet(own)
            if before:
                removed(spark, before)
            before = own
    finally:
        if unset:
            spark.conf.unset(BATCH_ROWS)
    return docs
