"""Weights that learn from accuracy, kept as versions; rows marked for another round of enrichment; members of companies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Accuracies between which nothing moves, rate, limits and sum of the weights, the least shift worth a version, the highest tier.
LOW, HIGH, RATE, FLOOR, CEILING, TOTAL, LEAST_SHIFT, TOP_TIER = 0.60, 0.85, 0.05, 0.01, 0.40, 1.08, 0.02, 3


def moved_weights(weights: Column, accuracy: Column) -> Column:
    """A map of weights moved by accuracy, each within its limits, scaled to their sum and rounded; as they were if nothing moves (also for no accuracy or no weights)."""
    delta = F.when(accuracy < LOW, -RATE * (LOW - accuracy)).when(accuracy > HIGH, RATE * (accuracy - HIGH)).otherwise(0.0)
    nudged = F.transform_values(weights, lambda _, w: F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), w + delta)))
    total = F.aggregate(F.map_values(nudged), F.lit(0.0), lambda s, w: s + w)
    return F.when((delta == 0) | (F.size(weights) == 0), weights).otherwise(F.transform_values(nudged, lambda _, w: F.round(w * (TOTAL / total), 4)))


def largest_shift(old: Column, new: Column) -> Column:
    """Largest change of any key of two maps; a key that lacks counts as 0."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0.0))
    keys = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.coalesce(F.array_max(F.transform(keys, lambda k: F.abs(at(new, k) - at(old, k)))), F.lit(0.0))


def next_versions(versions: DataFrame, accuracies: DataFrame) -> DataFrame:
    """Versions (account_id, version, weights, is_active) after a round of learning from (account_id, accuracy).

    The latest active version is moved; where a weight shifts by more than 0.02 the account's versions are all turned off and one more, active, is
    added. Accounts without an active version or without accuracy stay as they are.
    """
    latest = versions.filter("is_active").groupBy("account_id").agg(F.max_by("weights", "version").alias("old"))
    top = versions.groupBy("account_id").agg((F.max("version") + 1).alias("version"))
    moved = latest.join(accuracies, "account_id").withColumn("weights", moved_weights(F.col("old"), F.col("accuracy"))).filter(largest_shift(F.col("old"), F.col("weights")) > LEAST_SHIFT)
    new = moved.join(top, "account_id").select("account_id", "version", "weights", F.lit(True).alias("is_active"))
    off = versions.join(new.select("account_id", F.lit(True).alias("_moved")), "account_id", "left")
    return off.withColumn("is_active", F.col("is_active") & F.col("_moved").isNull()).drop("_moved").unionByName(new)


def stale_companies(companies: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Companies (id, status, last_run) that are done and were last run more than ``days`` before ``as_of``."""
    return companies.filter((F.col("status") == "done") & (F.col("last_run") < F.lit(as_of) - F.make_dt_interval(F.lit(days)))).select("id")


def promoted(persons: DataFrame, chosen: DataFrame, as_of: datetime) -> DataFrame:
    """``persons`` with the highest tier and ``updated_at`` as of now for those of ``chosen`` (id) below it; the rest, tiers unknown too, untouched."""
    marked = persons.join(chosen.select("id").distinct().withColumn("_up", F.lit(True)), "id", "left")
    up = F.coalesce(F.col("_up") & (F.col("tier") < TOP_TIER), F.lit(False))
    return marked.withColumns({"tier": F.when(up, TOP_TIER).otherwise(F.col("tier")), "updated_at": F.when(up, F.lit(as_of)).otherwise(F.col("updated_at"))}).drop("_up")


def company_members(persons: DataFrame, stints: DataFrame) -> DataFrame:
    """(person_id, company_id, title, domain, team): each person with every stint at the present company, current or not; the person's own title and domain come first."""
    s = stints.select("person_id", "company_id", F.col("title").alias("_t"), F.col("domain").alias("_d"), "team")
    j = persons.dropna(subset=["company_id"]).join(s, ["person_id", "company_id"], "left")
    return j.select("person_id", "company_id", F.coalesce("title", "_t").alias("title"), F.coalesce("domain", "_d").alias("domain"), "team")
