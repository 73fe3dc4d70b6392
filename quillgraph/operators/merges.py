"""State changes as whole-table expressions: insert-or-ignore, overwrite, coalesce and history-keeping merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Old rows, and new rows whose key isn't there."""
    return old.unionByName(new.join(old.select(*key), list(key), "left_anti").select(*old.columns))


def overwrite(old: DataFrame, new: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row for each key: new over old, the last by ``order`` among new ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    by = W.partitionBy(*key).orderBy(F.desc("_new"), order.desc())
    return both.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_new")


def coalesce_merge(old: DataFrame, new: DataFrame, key: Sequence[str], overwrite_columns: Sequence[str] = ()) -> DataFrame:
    """Full outer merge: a new value if there is one, else the old one; ``overwrite_columns`` always take the new row's."""
    rest = [c for c in old.columns if c not in key]
    right = new.select(*key, *[F.col(c).alias(f"_{c}") for c in rest], F.lit(True).alias("_there"))
    joined = old.join(right, list(key), "full_outer")
    merged = [
        (F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) if c in overwrite_columns else F.coalesce(f"_{c}", c)).alias(c) for c in rest
    ]
    return joined.select(*key, *merged)


def history_merge(current: DataFrame, new: DataFrame, today: Column, epsilon: float = 0.02) -> DataFrame:
    """Close changed edges and open new ones; equal manager and method with nearly the same confidence is no change.

    ``current`` and ``new`` are (report_id, manager_id, method, confidence), one row for each report. Returns rows with
    action ``keep``, ``close`` or ``open`` and valid_to / valid_from.
    """
    right = new.select("report_id", *[F.col(c).alias(f"n_{c}") for c in ("manager_id", "method", "confidence")])
    j = current.join(right, "report_id", "full_outer")
    had, has = F.col("manager_id").isNotNull(), F.col("n_manager_id").isNotNull()
    same = had & has & (F.col("manager_id") == F.col("n_manager_id")) & (F.col("method") == F.col("n_method")) & (F.abs(F.col("confidence") - F.col("n_confidence")) < epsilon)
    row = lambda p, action: F.struct(F.col(f"{p}manager_id").alias("manager_id"), F.col(f"{p}method").alias("method"), F.col(f"{p}confidence").alias("confidence"), F.lit(action).alias("action"))
    out = F.when(same | ~has, F.array(row("", "keep"))).when(~had, F.array(row("n_", "open"))).otherwise(F.array(row("", "close"), row("n_", "open")))
    flat = j.select("report_id", F.explode(out).alias("e")).select("report_id", "e.*")
    return flat.withColumns(
        {"valid_to": F.when(F.col("action") == "close", today), "valid_from": F.when(F.col("action") == "open", today)}
    )


def rule_merge(old: DataFrame, new: DataFrame, key: Sequence[str], rules: dict[str, str], now: Column) -> DataFrame:
    """Full outer merge with a rule for each column, and ``updated_at`` for the rows that the new table touches.

    Rules: ``old`` keeps what is there and fills nulls, ``new`` takes the new value unless it is null, ``replace`` takes the new row's in any case,
    ``union`` is the sorted set of both arrays, ``greatest`` the larger one. ``new`` has one row for each key; ``old`` has ``updated_at``.
    """
    right = new.select(*key, *[F.col(c).alias(f"_{c}") for c in rules], F.lit(True).alias("_there"))
    none = lambda c: F.coalesce(F.col(c), F.array().cast(old.schema[c.lstrip("_")].dataType))
    how = {
        "old": lambda c: F.coalesce(c, f"_{c}"),
        "new": lambda c: F.coalesce(f"_{c}", c),
        "replace": lambda c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)),
        "union": lambda c: F.array_sort(F.array_union(none(c), none(f"_{c}"))),
        "greatest": lambda c: F.greatest(c, f"_{c}"),
    }
    joined = old.join(right, list(key), "full_outer")
    return joined.select(*key, *[how[rule](c).alias(c) for c, rule in rules.items()], F.when(F.col("_there"), now).otherwise(F.col("updated_at")).alias("updated_at"))


def activate(versions: DataFrame, incoming: DataFrame, account: str = "account_id") -> DataFrame:
    """Versions with ``incoming`` as the only active one of its accounts; those of other accounts stay as they are.

    Both have the same columns, ``is_active`` among them; of several incoming ones of one account the caller keeps the last.
    """
    flip = incoming.select(account, F.lit(True).alias("_flip")).distinct()
    kept = versions.join(flip, account, "left").withColumn("is_active", F.col("is_active") & F.col("_flip").isNull()).select(*versions.columns)
    return kept.unionByName(incoming.withColumn("is_active", F.lit(True)).select(*versions.columns))
