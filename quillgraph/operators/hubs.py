"""Hubs that people meet in, and what each hub looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.texts import company_key, role_text
from quillgraph.operators.stored import stored

# What counts as a high score, and how many roles, industries and people a hub shows.
HIGH, TOP_LABELS, TOP_PEOPLE = 75, 3, 8


def hub_key(text: Column) -> Column:
    """A hub's key: trimmed, lower-case; null for empty text."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def hub_members(prospects: DataFrame) -> DataFrame:
    """(hub, id) of every hub that a prospect belongs to, once each.

    ``prospects`` is (id, company, past array, industry, schools array, role, talks array of (venue, year), city). A company has
    its present and past people; a conference is a venue with the year, if there is one.
    """
    named = lambda kind, key: F.when(key.isNotNull() & (key != ""), F.concat(F.lit(f"{kind}:"), key))
    each = lambda kind, values, key: F.transform(F.coalesce(values, F.array()), lambda v: named(kind, key(v)))
    talk = lambda t: hub_key(F.concat_ws(" ", t["venue"], t["year"].cast("string")))
    talks = F.transform(F.filter("talks", lambda t: F.coalesce(t["venue"], F.lit("")) != ""), lambda t: named("conference", talk(t)))
    single = F.array(named("company", company_key(F.col("company"))), named("industry", hub_key(F.col("industry"))), named("role", hub_key(role_text(F.col("role")))), named("city", hub_key(F.col("city"))))
    every = F.concat(single, each("company", F.col("past"), company_key), each("school", F.col("schools"), hub_key), F.coalesce(talks, F.array().cast("array<string>")))
    return prospects.select("id", F.explode(F.array_distinct(F.array_compact(every))).alias("hub")).select("hub", "id")


def hub_summaries(prospects: DataFrame) -> DataFrame:
    """(hub, total, avg_score, high, roles, industries, people) of every hub; ``prospects`` has a score (null: none) besides.

    The mean is over those with a score. Roles and industries are the ``TOP_LABELS`` commonest as ``label=count``, ties by label; people the ids
    of the ``TOP_PEOPLE`` best, no score counting 0, ties by id. Tallies are counted before they are ranked, and ranks cut before they move.
    """
    facts = prospects.select("id", F.nullif(role_text(F.col("role")), F.lit("")).alias("role"), F.nullif(F.trim("industry"), F.lit("")).alias("industry"), "score")
    met = stored(hub_members(prospects).join(facts, "id"))
    out = met.groupBy("hub").agg(F.count("*").alias("total"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"), F.count_if(F.col("score") >= HIGH).alias("high"))

    def listed(rows: DataFrame, order: list[Column], most: int, text: Column, name: str) -> DataFrame:
        ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("hub").orderBy(*order))).filter(F.col("r") <= most)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("r", text.alias("t")))), lambda s: s["t"])
        return ranked.groupBy("hub").agg(F.array_join(lines, ", ").alias(name))

    for column, name in (("role", "roles"), ("industry", "industries")):
        tally = met.filter(F.col(column).isNotNull()).groupBy("hub", column).agg(F.count("*").alias("n"))
        out = out.join(listed(tally, [F.desc("n"), F.col(column)], TOP_LABELS, F.concat(column, F.lit("="), F.col("n").cast("string")), name), "hub", "left")
    best = listed(met, [F.coalesce("score", F.lit(0.0)).desc(), F.col("id")], TOP_PEOPLE, F.col("id").cast("string"), "people")
    return out.join(best, "hub", "left").fillna("", ["roles", "industries", "people"])
