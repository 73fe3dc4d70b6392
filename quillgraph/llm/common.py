"""Shared plumbing: shared-folder tables, global row numbers, stored models."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: monotonically_increasing_id keeps the partition above and the row below this bit.
ROW_BITS = 33
#: Rows and bytes of one Arrow batch between Spark and a Python worker, so that a batch of long texts fits a worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Only a session without one, as in tests, gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillgraph-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor later costs a re-read, not a recomputation,
    and several consumers see the same rows.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in BATCHES}
    small_batches(df)  # while this table is written
    try:
        df.write.parquet(path)
    finally:
        for setting, value in before.items():
            spark.conf.set(setting, value)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)  # the session's results may still read it
    del df
    release(spark)
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of :func:`materialize` tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does as the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tables that a Python worker keeps from one task to the next.
KEPT: dict = {}


def trim(keep: bool = False) -> None:
    """Have a Python worker, which lives on for other steps, drop ``KEPT`` and return what is free to the system (glibc only)."""
    if not keep:
        KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand rows to Python in ``BATCHES``."""
    for setting, value in BATCHES.items():
        df.sparkSession.conf.set(setting, value)
    return df


def global_row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rn") -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order; returns (table, number of rows).

    Rows are range-partitioned and sorted, so no task holds more than its range. The
    range key ends in the input position, so even one key shared by a third of all rows
    is spread over partitions; rows that tie in ``order`` are numbered among themselves
    in an arbitrary way. Only one count per partition reaches the driver.
    """
    keys = [c.alias(f"_k{i}") for i, c in enumerate(order)]
    tie = F.monotonically_increasing_id().alias("_tie")
    by = [F.col(f"_k{i}") for i in range(len(keys))]
    # a descending key sorts by its negated rank, so callers pass sortable ascending columns
    dealt = df.select("*", *keys, tie).repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie")
    at = F.monotonically_increasing_id()
    placed = materialize(
        dealt.select(
            *df.columns,
            F.shiftright(at, ROW_BITS).cast("int").alias("_pid"),
            at.bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_pos"),
        ),
        "rows",
    )
    counts = {r["_pid"]: r["n"] for r in placed.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for pid in range(max(counts, default=-1) + 1):
        offsets.append(before)
        before += counts.get(pid, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [0]]), F.col("_pid") + 1)
    return placed.select(*df.columns, (base + F.col("_pos")).alias(name)), before


def runs(texts: list[str | None], limit: int = 1 << 20) -> Iterator[slice]:
    """Slices of consecutive texts of about ``limit`` code points (one text at least), so that a batch is worked on in parts."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
