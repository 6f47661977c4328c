"""Beyond bounded queries: tumbling windows over a stream of features, with a watermark for late ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_features(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder, with the schema they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def counts_in_windows(stream: DataFrame, time: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """w_start, keys, n, total of each tumbling window; state of windows older than the watermark is dropped."""
    timed = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    out = timed.groupBy(F.window("__t", window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("total"))
    return out.select(F.unix_millis("w.start").alias("w_start"), *keys, "n", "total")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """All that the stream has now, written to a table in memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
