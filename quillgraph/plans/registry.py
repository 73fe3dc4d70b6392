"""Queries and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function under ``name`` with the SQL for its rows."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


from . import aggregates, backfill, bundles, cohorts, graphs, matching, merges, mining, network, discovery, orgchart, pairs, profiles, scores, search, texts, upserts, versions, wordings  # noqa: E402, F401
