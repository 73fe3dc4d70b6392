from datetime import datetime

from pyspark.sql import functions as F

from quillgraph.operators import versions as ops


def test_weights_move_within_limits_and_only_far_enough(spark):
    rows = [(1, 1, {"a": 0.5, "b": 0.5}, True), (2, 1, {"a": 0.54, "b": 0.54}, True), (3, 1, {"a": 0.5}, False), (4, 1, {"a": 0.9}, True), (4, 2, {"a": 0.5, "b": 0.5}, True), (5, 1, {}, True), (6, 1, {"a": 0.5, "b": 0.5}, True)]
    v = spark.createDataFrame(rows, "account_id int, version int, weights map<string,double>, is_active boolean")
    a = spark.createDataFrame([(1, 0.0), (2, 0.7), (3, 0.0), (4, 1.0), (5, 0.0)], "account_id int, accuracy double")
    got = {(r.account_id, r.version): (r.is_active, r.weights) for r in ops.next_versions(v, a).collect()}
    assert got[1, 1][0] is False and got[1, 2] == (True, {"a": 0.54, "b": 0.54})
    assert got[4, 1][0] is got[4, 2][0] is False and got[4, 3] == (True, {"a": 0.54, "b": 0.54})
    assert got[2, 1][0] and got[5, 1][0] and got[6, 1][0] and not got[3, 1][0] and len(got) == 9
    shift = spark.createDataFrame([({"a": 0.5, "b": 0.1}, {"a": 0.45, "c": 0.3})], "o map<string,double>, n map<string,double>").select(ops.largest_shift(F.col("o"), F.col("n"))).first()[0]
    assert shift == 0.3


def test_stale_and_promoted(spark):
    now = datetime(2026, 3, 31)
    rows = [(1, "done", datetime(2026, 2, 28)), (2, "done", datetime(2026, 3, 2)), (3, "pending", datetime(2020, 1, 1)), (4, "done", None), (5, None, datetime(2020, 1, 1))]
    assert [r.id for r in ops.stale_companies(spark.createDataFrame(rows, "id int, status string, last_run timestamp"), now).collect()] == [1]
    people = spark.createDataFrame([(1, 1, None), (2, 3, None), (3, None, None), (4, 1, None)], "id int, tier int, updated_at timestamp")
    chosen = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "id int")
    assert sorted((r.id, r.tier, r.updated_at) for r in ops.promoted(people, chosen, now).collect()) == [(1, 3, now), (2, 3, None), (3, None, None), (4, 1, None)]
