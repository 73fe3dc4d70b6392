"""A cascade of jobs behind a stream: enough new rows start all of them, in order, each once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Job = Callable[[DataFrame, str], None]


def cascade(source: DataFrame, jobs: Sequence[tuple[str, Job]], state: str, checkpoint: str, threshold: int = 100) -> None:
    """Take what has come and, once ``threshold`` rows wait, run every job over the waiting rows, one after the other.

    A job is (name, run(rows, folder)); it writes its result below its own folder, which belongs to this batch and is
    emptied of an earlier attempt by the job's own overwrite. Each finished job leaves a mark of (batch, job). A batch that
    fails on the way is handed out again by the stream with the same id and the same rows: jobs with a mark are passed over, the others
    run, and only then the rows count as done. So every row goes through every job once, whatever stops in between.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{state}/pending/batch={batch_id}")
        done = last_done(spark, state)
        rows = spark.read.parquet(f"{state}/pending").filter(F.col("batch").between(done + 1, batch_id))
        if rows.count() < threshold:
            return
        for name, run in jobs:
            if not _exists(spark, f"{state}/marks/{name}/upto={batch_id}/_SUCCESS"):
                run(rows.drop("batch"), f"{state}/out/{name}/upto={batch_id}")
                _mark(spark, f"{state}/marks/{name}/upto={batch_id}", batch_id)
        _mark(spark, f"{state}/done/upto={batch_id}", batch_id)

    query = source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def results(spark: SparkSession, state: str, job: str) -> DataFrame:
    """What a job has written for all finished batches."""
    done = spark.read.parquet(f"{state}/done").select("upto")
    return spark.read.parquet(f"{state}/out/{job}").join(done, "upto", "left_semi")


def last_done(spark: SparkSession, state: str) -> int:
    """The last batch that all jobs have covered, or -1."""
    if not _exists(spark, f"{state}/done"):
        return -1
    last = spark.read.parquet(f"{state}/done").agg(F.max("upto")).first()[0]
    return -1 if last is None else last


def _mark(spark: SparkSession, path: str, batch_id: int) -> None:
    spark.range(1).select(F.lit(batch_id).alias("batch")).coalesce(1).write.mode("overwrite").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
