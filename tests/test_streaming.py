"""Incremental refresh over a file stream."""

from pyspark.sql import functions as F

from quillgraph.sources.io import parse_payload, refresh_partitions
from quillgraph.streaming.refresh import refresh_when_grown, windowed_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_refresh_sees_every_row_once(spark, tmp_path):
    src, seen = tmp_path / "in", []
    rows = spark.range(250).withColumn("v", F.col("id") * 2)
    schema = rows.schema
    for low, high in ((0, 40), (40, 90), (90, 250)):
        rows.filter(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        refresh_when_grown(stream, lambda df, n: seen.append((n, df.agg(F.sum("id")).first()[0])), str(tmp_path / "state"), str(tmp_path / "cp"))
    assert seen[0] == (40, sum(range(40)))  # the first pass always refreshes
    assert seen[1] == (210, sum(range(40, 250)))  # 50 rows waited for the threshold


def test_windowed_counts_batch_equals_stream(spark, tmp_path):
    batch = spark.read.parquet(EVENTS)
    batch.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == batch.count()


def test_partition_refresh_and_payload(spark, tmp_path):
    p = str(tmp_path / "t")
    refresh_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), p, "k")
    refresh_partitions(spark.createDataFrame([(2, "c")], "k int, v string"), p, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(p).collect()} == {(1, "a"), (2, "c")}
    df = spark.createDataFrame([(1, '{"headline": "x", "mentioned_executives": ["p", "q"]}'), (2, "broken"), (3, None)], "id int, raw string")
    got = {r.id: (r.headline, r.mentioned_executives) for r in parse_payload(df, "raw", "press").collect()}
    assert got == {1: ("x", ["p", "q"]), 2: (None, None), 3: (None, None)}
