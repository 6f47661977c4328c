"""Token counts of flat, unindexed token files by a separator scan (operator 3).

A flat file is a plain run of little-endian unsigned integers, in which an end-of-document id follows each document.
Files are cut into byte ranges without regard to documents.  Each range is read by itself and searched for
the separator at once; a prefix scan over the ranges of a file, in two levels, then gives the last separator and the number of documents before
each range, which stitches the documents that cross a boundary.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.engine.workers import importable
from terrafold.llm.bpe import encoder, vocabulary_path
from terrafold.llm.common import checkpointed, removed, shared_folder, table

#: Parameters: bytes of a range, and ranges of a group in the first level of the prefix scan.
BLOCK_BYTES, GROUP_RANGES = 4 << 20, 4_096


def _open(path: str):  # noqa: ANN202
    """File system and path for the URI of a shared folder."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return FileSystem.from_uri(path)


def token_type(vocabulary: str) -> str:
    """The narrowest type that holds every id of a vocabulary."""
    return "<u2" if len(encoder(vocabulary).pieces) <= 1 << 16 else "<u4"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, separator: int, dtype: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into flat files below ``folder``; returns file, ordinal, doc_id of each document.

    dtype: of a token (default: ``token_type``); one that can't hold all ids is an error.  One file for each task.  A task
    that runs again writes a file of another name, and only files that the result names count (``forget_others`` removes the rest).
    Null, empty and white texts are documents, those without text without tokens.  Special tokens in a text are ordinary text.
    Rows that repeat, and null doc_ids, are documents each.  An empty table gives no rows.  Other columns of ``docs``, also
    ones named file or ordinal, are left out.  The result is written before it is returned, so that no file is written twice.
    """
    importable(docs.sparkSession)
    dtype = dtype or token_type(vocabulary)
    if max(len(encoder(vocabulary).pieces) - 1, separator) > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} can't hold the ids of {vocabulary}")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fs, where = _open(folder)
    fs.create_dir(where, recursive=True)  # an empty table has no task that would

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _open(folder)
        fs.create_dir(where, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        made, end = 0, np.array([separator], dtype).tobytes()
        with fs.open_output_stream(f"{where}/{name}") as out:
            for batch in batches:
                for ids in encoder(vocabulary).encode(batch.column(1).to_pylist(), specials=False):
                    out.write(np.frombuffer(ids, "<u4").astype(dtype).tobytes() + end)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(made, made + n), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
                made += n

    return checkpointed(docs.select("doc_id", "text").mapInArrow(run, f"file string, ordinal long, doc_id {kind}"))


def forget_others(spark: SparkSession, folder: str, written: DataFrame) -> int:
    """Remove files of ``folder`` that ``written`` doesn't name, which failed attempts left; returns how many."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    stray = [r.path for r in files.join(written.select("file").distinct(), "file", "left_anti").select("path").collect()]  # at most a file for each task
    for path in stray:
        removed(spark, path)
    return len(stray)


def document_lengths(spark: SparkSession, folder: str, separator: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file (its name), ordinal (from 0), n_tokens of each document in the flat files of ``folder``, separators not counted.

    dtype must be the one that the files were written with.  Tokens after the last separator are a document, if there are
    any.  An empty file has no documents, no files give no rows; an incomplete last token is left out.  A document may span any number of ranges.
    """
    importable(spark)
    if separator > np.iinfo(dtype).max:
        raise ValueError(f"{dtype} can't hold the separator {separator}")
    width = np.dtype(dtype).itemsize
    block_bytes = max(1, block_bytes // width) * width
    files = spark.read.format("binaryFile").load(folder).select("path", (F.col("length") - F.col("length") % width).alias("bytes")).where("bytes > 0")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(block_bytes).cast("long"))).alias("at"), "bytes")
    ranges = ranges.select("path", "at", F.least(F.lit(block_bytes), F.col("bytes") - F.col("at")).alias("n")).repartition("path", "at")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, where = _open(path)
                with fs.open_input_file(where) as file:
                    tokens = np.frombuffer(file.read_at(n, at), dtype)
                ends = np.flatnonzero(tokens == separator).astype(np.int64) + at // width
                yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([at // width], pa.int64()), pa.array([len(tokens)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=["file", "start", "tokens", "ends"])

    blocks = checkpointed(ranges.mapInArrow(scan, "file string, start long, tokens long, ends array<long>"))
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1))
    # no lists in the scans' sorts; ranges are scanned inside groups, and groups inside a file, so that no task sorts all ranges of a large file
    group = F.floor(F.col("start") / (block_bytes // width * GROUP_RANGES)).alias("group")
    small = blocks.select("file", "start", group, last.alias("last"), F.size("ends").alias("n_ends"))
    scans = lambda w: (F.max("last").over(w).alias("before"), F.coalesce(F.sum("n_ends").over(w), F.lit(0)).alias("first"))
    rows = (Window.unboundedPreceding, -1)
    inner = small.select("file", "start", "group", *scans(Window.partitionBy("file", "group").orderBy("start").rowsBetween(*rows)))
    outer = small.groupBy("file", "group").agg(F.max("last").alias("last"), F.sum("n_ends").alias("n_ends")).select("file", "group", *scans(Window.partitionBy("file").orderBy("group").rowsBetween(*rows)))
    outer = outer.select("file", "group", F.col("before").alias("before_group"), F.col("first").alias("first_group"))
    carried = inner.join(outer, ["file", "group"]).select("file", "start", F.coalesce("before", "before_group", F.lit(-1)).alias("before"), (F.col("first") + F.col("first_group")).alias("first"))
    own = blocks.where(F.size("ends") > 0).join(carried, ["file", "start"])
    lengths = F.transform("ends", lambda e, i: e - F.coalesce(F.get("ends", i - 1), F.col("before")) - 1)
    whole = own.select("file", "first", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "n_tokens")
    totals = blocks.groupBy("file").agg(F.sum("tokens").alias("all"), F.coalesce(F.max(last), F.lit(-1)).alias("end"), F.sum(F.size("ends")).alias("ordinal"))
    return whole.union(totals.where(F.col("all") > F.col("end") + 1).select("file", "ordinal", (F.col("all") - F.col("end") - 1).alias("n_tokens")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and n_tokens of every document: written to flat files, whose separators are then scanned."""
    path, folder = vocabulary_path(), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    end = encoder(path).specials["<|endoftext|>"]
    written = write_token_files(table(spark, sf_dir, "documents"), folder, path, separator=end)
    counted = checkpointed(written.join(document_lengths(spark, folder, end, token_type(path)), ["file", "ordinal"]).select("doc_id", "n_tokens"))
    removed(spark, folder)
    return counted
