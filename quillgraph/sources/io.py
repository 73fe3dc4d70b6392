"""Readers and writers: whole-table scans, snapshots, partition refresh, typed JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Parquet scan with pruned columns and a pushed-down filter."""
    df = spark.read.parquet(path)
    df = df.filter(where) if where is not None else df
    return df.select(*columns) if columns is not None else df


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table as JSON lines below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def refresh_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace the partitions that ``df`` has rows for and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


#: Typed shapes of vendor payloads.
PAYLOADS = {
    "profile": "fullName string, headline string, linkedinUrl string, experiences array<struct<title:string,companyName:string,startYear:int,endYear:int>>, educations array<struct<school:string,degree:string>>",
    "repository": "login string, company string, followers int, public_repos int",
    "news": "title string, url string, publishedAt string",
    "executives": "executives array<struct<name:string,title:string>>",
    "press": "headline string, mentioned_executives array<string>",
}


def parse_payload(df: DataFrame, column: str, kind: str) -> DataFrame:
    """The JSON payload's typed fields in place of ``column``; broken payloads give nulls."""
    rest = [c for c in df.columns if c != column]
    return df.withColumn("_p", F.from_json(column, PAYLOADS[kind])).select(*rest, "_p.*")
