"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.engine.workers import importable


#: Parameters: rows, and bytes of text, that a function gets at once.
PIECE_ROWS, PIECE_BYTES = 2_000, 16 << 20
#: Parameters: rows of one key that a task of a join takes at least, and keys that are dealt to several tasks at most (see ``hot_keys``).
HOT_ROWS, HOT_KEYS = 512, 200_000
#: By module: how to drop what an operator remembers in a worker process.
CACHES: dict[str, Callable[[], object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the one that the session names in ``spark.checkpoint.dir``.

    Only where none is set and all runs on one machine (tests) a temporary one is used.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def removed(spark: SparkSession, folder: str) -> None:
    """Remove a folder of intermediate files that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there, so that a lost executor costs no more than its tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is.  Texts of ASCII alone take a faster way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def give_back() -> None:
    """Hand memory that is free, but kept by the allocators of a worker, back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batch: pa.RecordBatch, inputs: list[int]) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of at most PIECE_ROWS rows and, unless one row alone is longer, PIECE_BYTES of text in ``inputs``."""
    size = np.zeros(batch.num_rows, np.int64)
    for i in inputs:
        if pa.types.is_string(batch.column(i).type) or pa.types.is_binary(batch.column(i).type):
            size += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    reached, at = np.cumsum(size), 0
    while at < batch.num_rows:
        most = (int(reached[at - 1]) if at else 0) + PIECE_BYTES
        end = max(at + 1, min(at + PIECE_ROWS, int(np.searchsorted(reached, most, "right"))))
        yield batch.slice(at, end - at)
        at = end


def map_rows(df: DataFrame, function: Callable[[list, ...], list], inputs: list[str], fields: list[tuple[str, pa.DataType, str]], keep: list[str]) -> DataFrame:
    """Apply ``function`` to the ``inputs`` of pieces of Arrow batches, bounded in rows and bytes; its columns follow those in ``keep``.

    function: gets one list for each input and returns one list for each of ``fields`` (name, Arrow type, Spark type).
    Clashing names: columns of ``df`` other than ``keep`` are not carried, so none can clash with ``fields``.
    Spark bounds the batches that it sends by bytes as well (spark.sql.execution.arrow.maxBytesPerBatch); no setting is changed here.
    """
    importable(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{n}` {sql}" for n, _, sql in fields])
    extra = [c for c in dict.fromkeys(inputs) if c not in keep]
    chosen = df.select(*[F.col(f"`{k}`") for k in keep], *[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(extra)])
    at = [keep.index(c) if c in keep else len(keep) + extra.index(c) for c in inputs]
    owner = function.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for other, clear in CACHES.items():  # a worker is used again: tables that another operator left give way
            if other != owner:
                clear()
        for batch in batches:
            for piece in pieces(batch, at):
                made = function(*[piece.column(i).to_pylist() for i in at])
                columns = [piece.column(i) for i in range(len(keep))] + [pa.array(v, t) for v, (_, t, _) in zip(made, fields, strict=True)]
                made = None
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *[n for n, _, _ in fields]])
                columns = piece = None
                give_back()
            batch = None  # before the next one is read

    return chosen.mapInArrow(run, schema)


def hot_keys(keys: list[str], big: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame | None:
    """``keys`` and __salts of each key with so many rows that several tasks should share them; None if there is no such key.

    Give ``big``, which must be cheap to read again (checkpointed), or its rows by key as ``counted`` (keys, __n).  A key is hot from
    HOT_ROWS rows on; where that gives more than HOT_KEYS keys, from as many rows on as leave at most HOT_KEYS.
    """
    counted = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")) if counted is None else counted
    many = counted.where((F.col("__n") > HOT_ROWS) & F.concat(*[F.col(k).cast("string") for k in keys]).isNotNull()).select(*keys, "__n")
    rows, least = many.limit(HOT_KEYS + 1).collect(), HOT_ROWS
    if not rows:
        return None
    if len(rows) > HOT_KEYS:  # keys of at least this size are fewer, as their rows are part of the sum
        least = -(-many.agg(F.sum("__n")).first()[0] // HOT_KEYS)
        return checkpointed(many.where(F.col("__n") > least).select(*keys, F.ceil(F.col("__n") / least).cast("int").alias("__salts")))
    return many.sparkSession.createDataFrame(rows, many.schema).select(*keys, F.ceil(F.col("__n") / least).cast("int").alias("__salts"))


def dealt(big: DataFrame, hot: DataFrame | None, keys: list[str], by: Column) -> DataFrame:
    """``big`` with __salt: rows of a hot key get one of its numbers by the hash ``by``, all others 0."""
    if hot is None:
        return big.withColumn("__salt", F.lit(0))
    return big.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.coalesce(F.pmod(by, F.col("__salts")).cast("int"), F.lit(0))).drop("__salts")  # at most HOT_KEYS rows


def copied(small: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """``small`` with __salt: rows of a hot key once for each of its numbers."""
    if hot is None:
        return small.withColumn("__salt", F.lit(0))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
    return small.join(F.broadcast(hot), keys, "left").withColumn("__salt", salts).drop("__salts")  # at most HOT_KEYS rows


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", by: Column | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` (few rows for each key) by equal ``keys``, with the rows of a hot key dealt to several tasks.

    by: a hash that tells rows of one key apart (default: of all columns).  See ``hot_keys`` for the others.
    """
    hot = hot_keys(keys, big, counted)
    if hot is None:
        return big.join(small, keys, how)
    by = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]) if by is None else by
    return dealt(big, hot, keys, by).join(copied(small, hot, keys), [*keys, "__salt"], how).drop("__salt")
