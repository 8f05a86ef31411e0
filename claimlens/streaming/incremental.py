"""Incremental processing: resume by processed ids, append-only logs, micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pending(rows: DataFrame, log: str, key: str) -> DataFrame:
    """Rows whose key the log (Parquet, may not exist yet) doesn't hold."""
    spark = rows.sparkSession
    if not exists(spark, log):
        return rows
    return rows.join(spark.read.parquet(log).select(key).distinct(), key, "left_anti")


def process(rows: DataFrame, stage: Callable[[DataFrame], DataFrame], log: str, key: str) -> DataFrame:
    """Run a stage over the pending rows, append to the log, return the whole log."""
    stage(pending(rows, log, key)).write.mode("append").parquet(log)
    return rows.sparkSession.read.parquet(log)


def stream(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], log: str, checkpoint: str, key: str) -> StreamingQuery:
    """The same over a folder that files keep arriving in; each batch is written once even if it is replayed."""

    def batch(rows: DataFrame, number: int) -> None:
        process(rows, stage, log, key)

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, minutes: int = 60, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Tumbling counts and sums of a (streaming or static) event table."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, f"{minutes} minutes").alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total")
