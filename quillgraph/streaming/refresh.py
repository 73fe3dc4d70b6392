"""Incremental refresh with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def refresh_when_grown(
    source: DataFrame, refresh: Callable[[DataFrame, int], None], state: str, checkpoint: str, threshold: int = 100
) -> None:
    """Run ``refresh(rows, pending)`` over the rows that have come since the last refresh, once they are enough.

    Every trigger appends its rows to the pending table in ``state``; the first trigger always refreshes. Each batch
    writes its own folder, so a batch that is repeated after a failure replaces its rows and none is lost or counted twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state}/pending/batch={batch_id}")
        marks = spark.createDataFrame([(batch_id,)], "upto long")
        done = _last_mark(spark, state)
        rows = spark.read.parquet(f"{state}/pending").filter(F.col("batch") > done)
        pending = rows.count()
        if done < 0 or pending >= threshold:
            refresh(rows.drop("batch"), pending)
            marks.write.mode("overwrite").parquet(f"{state}/marks/at={batch_id}")

    query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _last_mark(spark: SparkSession, state: str) -> int:
    """Last batch that a refresh covered, or -1."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/marks")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return -1
    last = spark.read.parquet(f"{state}/marks").agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by kind and window with a watermark for late ones."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("window.start").alias("start"), "event_type", "n", "total")
