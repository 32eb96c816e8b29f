"""The board's snapshots as a stream, an extension: repeated rows are dropped and events counted in windows as files arrive.

Change events per key are the batch operator's, which reads all snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_snapshots(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files of snapshots as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_rows(rows: DataFrame, keys: list[str], ts: str, late: str = "7 days") -> DataFrame:
    """Rows once by their keys; state older than the watermark is dropped, later repetitions then pass again."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str = "1 day", late: str = "1 day") -> DataFrame:
    """window_start, by, n, total of value: tumbling windows, closed by the watermark."""
    agg = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there into an in-memory table; for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
