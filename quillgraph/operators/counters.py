"""Counters that a job takes of its own rows while it writes them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.operators.stored import stored


def counted(job: str, rows: DataFrame, counters: Mapping[str, Column]) -> tuple[DataFrame, dict]:
    """The rows written to the shared folder, and the job's counters taken on the way: no second scan."""
    observation = Observation(f"{job}-counters")
    table = stored(rows.observe(observation, *(c.alias(n) for n, c in counters.items())))
    return table, observation.get


def ledger(spark, counted_jobs: Mapping[str, dict]) -> DataFrame:
    """(job, counter, value) of several jobs' counters."""
    rows = [(job, name, float(value or 0)) for job, own in counted_jobs.items() for name, value in own.items()]
    return spark.createDataFrame(rows, "job string, counter string, value double").withColumn("value", F.round("value", 6))
