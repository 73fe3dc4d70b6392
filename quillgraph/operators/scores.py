"""Weighted sub-scores of prospects and where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.scoring import json_scalar, normalize, or_one

SUBS = ("authenticity", "authority", "warmth")
OVERALL = {"authenticity": 0.4, "authority": 0.4, "warmth": 0.2}


def weighted(signals: DataFrame, weights: DataFrame, clamped: bool = True) -> DataFrame:
    """Signals of weighted kinds with their normalised value ``v`` (from 0 to 100 if ``clamped``) and base weight ``base``."""
    n = json_scalar(F.col("value"))
    # the weights are one row for each kind of signal: a fixed few rows
    return signals.join(F.broadcast(weights), "signal_type").withColumns(
        {"v": normalize(n) if clamped else 100 * (1 - F.exp(-n / 15)), "base": or_one(F.col("weight")) * or_one(F.col("confidence"))}
    )


def prospect_scores(signals: DataFrame, weights: DataFrame, key: str = "prospect_id", clamped: bool = True) -> DataFrame:
    """Three sub-scores and the overall score of each prospect; one shuffle on the key. One scorer takes values unclamped."""
    sums = []
    for sub in SUBS:
        w = F.col(f"{sub}_weight")
        sums += [F.sum(F.col("v") * F.col("base") * w).alias(f"{sub}_num"), F.sum(F.col("base") * w).alias(f"{sub}_den")]
    totals = weighted(signals, weights, clamped).groupBy(key).agg(*sums)
    raw = {s: F.when(F.col(f"{s}_den") != 0, F.col(f"{s}_num") / F.col(f"{s}_den")).otherwise(0.0) for s in SUBS}
    overall = sum((raw[s] * OVERALL[s] for s in SUBS), F.lit(0.0))
    return totals.select(key, *[F.round(raw[s], 1).alias(f"{s}_score") for s in SUBS], F.round(overall, 1).alias("overall_score"))


def contributions(signals: DataFrame, weights: DataFrame) -> DataFrame:
    """Percentage of each sub-score that each signal's weight makes up."""
    subs = F.explode(F.array(*[F.struct(F.lit(s).alias("sub"), F.col(f"{s}_weight").alias("w")) for s in SUBS])).alias("s")
    rows = weighted(signals, weights).select("prospect_id", "id", "base", subs).filter("s.w > 0")
    share = F.col("base") * F.col("s.w")
    total = F.sum(share).over(W.partitionBy("prospect_id", "s.sub"))
    return rows.select("prospect_id", "id", F.col("s.sub").alias("sub"), F.when(total > 0, share / total * 100).otherwise(0.0).alias("pct"))
