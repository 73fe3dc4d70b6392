"""Appending what users correct: checked, split and stamped in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.orgchart import COMPONENTS

# Kinds of correction, and those that need a value.
KINDS = ("not_reports_to", "reports_to_other", "are_peers", "team_wrong")
NEED_VALUE = ("reports_to_other", "team_wrong")


def problem(allowed: tuple[str, ...] = COMPONENTS) -> Column:
    """The first rule that a correction (person_a_id, kind, submitted_by, value, attributions) breaks, or null.

    ``attributions`` is JSON text: null, or an object of known components with numbers from 0 to 1.
    """
    text = F.col("attributions")
    shares = F.from_json(text, "map<string,variant>")
    number = F.exists(F.map_values(shares), lambda v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"))
    inside = F.forall(F.map_values(shares), lambda v: F.try_variant_get(v, "$", "double").between(0, 1))
    return (
        F.when(F.col("person_a_id").isNull(), "no person")
        .when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(F.coalesce(F.trim("submitted_by"), F.lit("")) == "", "nobody submitted it")
        .when(F.col("kind").isin(*NEED_VALUE) & (F.coalesce("value", F.lit("")) == ""), "needs a value")
        .when(text.isNotNull() & shares.isNull(), "attributions are no object")
        .when(F.exists(F.map_keys(shares), lambda k: ~k.isin(*allowed)), "unknown component")
        .when(number, "attribution is no number")
        .when(~inside, "attribution outside 0 to 1")
    )


def checked(corrections: DataFrame, now: Column) -> DataFrame:
    """Corrections with ``problem`` (null: accepted), ``accepted`` (1 or 0) and ``updated_at``."""
    return corrections.withColumn("problem", problem()).withColumns({"accepted": F.col("problem").isNull().cast("int"), "updated_at": now})


def append_corrections(corrections: DataFrame, path: str, now: Column) -> None:
    """Append accepted and refused rows below ``path``, one partition each, in one pass over the input."""
    checked(corrections, now).write.mode("append").partitionBy("accepted").parquet(path)
