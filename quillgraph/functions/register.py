"""SQL access to the scoring and title functions: temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import scoring, texts


def _rules(argument: str, rules, otherwise: str) -> str:
    value = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    quoted = lambda p: "r\"(?iU)" + p + "\""
    return "CASE " + " ".join(f"WHEN {argument} RLIKE {quoted(p)} THEN {value(v)}" for p, v in rules) + f" ELSE {otherwise} END"


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    k, c = scoring.FREQUENCY_COEFFICIENT, scoring.CORROBORATION_COEFFICIENT
    functions = {
        "connection_strength(base DOUBLE, decay DOUBLE, years DOUBLE, corroborations INT, sources INT)": (
            "DOUBLE",
            f"least({scoring.STRENGTH_CAP}D, base * exp(-decay * years) * (1 + ln(corroborations) * {k}D) * (1 + sources * {c}D))",
        ),
        "normalized_score(n DOUBLE)": ("DOUBLE", "greatest(0D, least(100D, 100 * (1 - exp(-n / 15))))"),
        "seniority_tier(score INT)": (
            "STRING",
            "CASE WHEN score >= 85 THEN 'c_suite' WHEN score >= 75 THEN 'svp' WHEN score >= 65 THEN 'vp' WHEN score >= 55 THEN 'director' ELSE 'manager' END",
        ),
        "domain_from_title(title STRING)": ("STRING", _rules("title", texts.DOMAIN_RULES, "NULL")),
        "seniority_from_title(title STRING)": ("INT", _rules("title", texts.SENIORITY_RULES, "NULL")),
        "attribution_keys_ok(attributions MAP<STRING, DOUBLE>, allowed ARRAY<STRING>)": (
            "BOOLEAN",
            "forall(map_keys(attributions), k -> array_contains(allowed, k)) AND forall(map_values(attributions), v -> v BETWEEN 0 AND 1)",
        ),
    }
    for signature, (kind, body) in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in functions]
