"""Score queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scoring as fs
from quillgraph.operators import scores as ops
from quillgraph.sources import adapters as src

from .registry import query

_V = "greatest(0.0, least(100.0, 100 * (1 - exp(-value / 15))))"
_SCORED = f"""scored AS (SELECT prospect_id, id, signal_type, collected_at, {_V} AS v, confidence AS base,
  authenticity_weight AS wa, authority_weight AS wu, warmth_weight AS ww FROM signals JOIN signal_weights USING (signal_type))"""
_SUMS = """sums AS (SELECT prospect_id, sum(v * base * wa) / sum(base * wa) AS a, sum(v * base * wu) / sum(base * wu) AS u,
  sum(v * base * ww) / sum(base * ww) AS w FROM scored GROUP BY prospect_id)"""
SCORES_SQL = f"""{src.with_ctes('signals', 'signal_weights')}, {_SCORED}, {_SUMS}
SELECT prospect_id, round(a, 1) AS authenticity_score, round(u, 1) AS authority_score, round(w, 1) AS warmth_score,
  round(0.4 * a + 0.4 * u + 0.2 * w, 1) AS overall_score FROM sums"""


@query("prospect_scores", SCORES_SQL)
def prospect_scores(spark, sf_dir):
    """A1: sub-scores and overall score of every prospect."""
    return ops.prospect_scores(src.signals(spark, sf_dir), src.signal_weights(spark))


@query(
    "score_contributions",
    f"""{src.with_ctes('signals', 'signal_weights')}, {_SCORED},
long AS (SELECT prospect_id, id, 'authenticity' AS sub, base * wa AS d FROM scored UNION ALL
  SELECT prospect_id, id, 'authority', base * wu FROM scored UNION ALL SELECT prospect_id, id, 'warmth', base * ww FROM scored)
SELECT prospect_id, id, sub, round(d / sum(d) OVER (PARTITION BY prospect_id, sub) * 100, 6) AS pct FROM long WHERE d > 0""",
)
def score_contributions(spark, sf_dir):
    """A2: share of every signal in every sub-score."""
    out = ops.contributions(src.signals(spark, sf_dir), src.signal_weights(spark))
    return out.withColumn("pct", F.round("pct", 6))


@query(
    "signal_only_breakdown",
    f"""{src.with_ctes('signals', 'signal_weights')}, {_SCORED}, d AS (SELECT prospect_id, id, greatest(0.05, base) AS d FROM scored)
SELECT prospect_id, id, round(d / sum(d) OVER (PARTITION BY prospect_id) * 100, 6) AS pct FROM d""",
)
def signal_only_breakdown(spark, sf_dir):
    """A3: share of each signal by weight and confidence alone, at least 0.05 each."""
    d = F.greatest(F.lit(0.05), F.col("base"))
    rows = ops.weighted(src.signals(spark, sf_dir), src.signal_weights(spark))
    return rows.select("prospect_id", "id", F.round(d / F.sum(d).over(W.partitionBy("prospect_id")) * 100, 6).alias("pct"))


@query(
    "stale_prospects",
    f"""{src.with_ctes('signals')}, newest AS (SELECT prospect_id, max(collected_at) AS newest_at FROM signals GROUP BY 1),
scored AS (SELECT prospect_id, max(collected_at) AS scored_at FROM signals WHERE signal_type = 'view' GROUP BY 1)
SELECT n.prospect_id FROM newest n LEFT JOIN scored s USING (prospect_id) WHERE scored_at IS NULL OR newest_at > scored_at""",
)
def stale_prospects(spark, sf_dir):
    """T4: prospects whose newest signal is newer than their newest score (views stand for scorings)."""
    s = src.signals(spark, sf_dir)
    per = s.groupBy("prospect_id").agg(
        F.max("collected_at").alias("at"), F.max(F.when(F.col("signal_type") == "view", F.col("collected_at"))).alias("scored_at")
    )
    return per.filter(F.col("scored_at").isNull() | (F.col("at") > F.col("scored_at"))).select("prospect_id")


@query(
    "best_scorer_row",
    f"""{src.with_ctes('signals')} SELECT prospect_id, id, signal_type FROM signals QUALIFY row_number() OVER (PARTITION BY prospect_id
ORDER BY CASE signal_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 9 END, collected_at DESC, id) = 1""",
)
def best_scorer_row(spark, sf_dir):
    """The row of the preferred model, the newest among equals."""
    t = F.col("signal_type")
    rank = F.when(t == "purchase", 1).when(t == "signup", 2).when(t == "click", 3).otherwise(9)
    by = W.partitionBy("prospect_id").orderBy(rank, F.desc("collected_at"), "id")
    rows = src.signals(spark, sf_dir).withColumn("rn", F.row_number().over(by)).filter("rn = 1")
    return rows.select("prospect_id", "id", "signal_type")


@query(
    "latest_signal",
    f"""{src.with_ctes('signals')} SELECT prospect_id, id, signal_type FROM signals
QUALIFY row_number() OVER (PARTITION BY prospect_id ORDER BY collected_at DESC, id DESC) = 1""",
)
def latest_signal(spark, sf_dir):
    """Newest row of each prospect as one aggregate."""
    newest = F.max(F.struct("collected_at", "id", "signal_type")).alias("m")
    return src.signals(spark, sf_dir).groupBy("prospect_id").agg(newest).select("prospect_id", "m.id", "m.signal_type")


_KINDS = ", ".join(f"('{k}', {b}, {d})" for k, (b, d) in fs.STRENGTHS.items())


@query(
    "strength_model",
    f"""WITH kinds AS (SELECT * FROM (VALUES {_KINDS}) t(kind, base, decay))
SELECT c_custkey, kind, round(least(0.99, base * exp(-decay * (c_custkey % 20)) * (1 + 0.15 * ln(1 + c_custkey % 5)) * (1 + 0.10 * (1 + c_custkey % 3))), 9) AS strength
FROM customer JOIN kinds ON hash_kind = c_custkey % 17""".replace("kinds AS (SELECT *", "kinds AS (SELECT *, row_number() OVER (ORDER BY kind) - 1 AS hash_kind"),
)
def strength_model(spark, sf_dir):
    """Strength of a connection kind after decay and corroboration."""
    rows = [(i, k, *fs.STRENGTHS[k]) for i, k in enumerate(sorted(fs.STRENGTHS))]
    kinds = spark.createDataFrame(rows, "i long, kind string, base double, decay double")
    c = src.table(spark, sf_dir, "customer")
    joined = c.withColumn("i", F.col("c_custkey") % 17).join(F.broadcast(kinds), "i")  # 17 rows
    k = F.col("c_custkey")
    s = fs.strength(F.col("base"), F.col("decay"), k % 20, 1 + k % 5, 1 + k % 3)
    return joined.select("c_custkey", "kind", F.round(s, 9).alias("strength"))


@query(
    "cohort_strength",
    """SELECT o_orderkey, round(least(0.99, CASE o_orderpriority WHEN '1-URGENT' THEN 0.85 WHEN '2-HIGH' THEN 0.78 WHEN '3-MEDIUM' THEN 0.70 ELSE 0.62 END
  * CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 ELSE 0.5 END * CASE WHEN o_custkey <= 100 THEN 1.10 WHEN o_custkey <= 500 THEN 1.0 ELSE 0.85 END
  * CASE WHEN o_orderstatus = 'F' THEN 1.05 ELSE 1.0 END), 9) AS strength FROM orders""",
)
def cohort_strength(spark, sf_dir):
    """base x year x size x program, capped."""
    p, k = F.col("o_orderpriority"), F.col("o_orderkey") % 4
    base = F.when(p == "1-URGENT", 0.85).when(p == "2-HIGH", 0.78).when(p == "3-MEDIUM", 0.70).otherwise(0.62)
    year = F.when(k == 0, 1.0).when(k == 1, 0.8).otherwise(0.5)
    size = F.when(F.col("o_custkey") <= 100, 1.10).when(F.col("o_custkey") <= 500, 1.0).otherwise(0.85)
    program = F.when(F.col("o_orderstatus") == "F", 1.05).otherwise(1.0)
    return src.table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.least(F.lit(0.99), base * year * size * program), 9).alias("strength"))


@query(
    "signal_json_scalars",
    """SELECT event_id, coalesce(json_extract(props, '$.k')::DOUBLE, 0.0) AS k, coalesce(json_extract_string(props, '$.missing')::DOUBLE, 0.0) AS missing FROM events""",
)
def signal_json_scalars(spark, sf_dir):
    """Numbers out of JSON payloads, 0 where there is none."""
    e = src.table(spark, sf_dir, "events")
    at = lambda path: F.coalesce(F.get_json_object("props", path).try_cast("double"), F.lit(0.0))
    return e.select("event_id", at("$.k").alias("k"), at("$.missing").alias("missing"))


@query(
    "full_outer_profiles",
    f"""{src.with_ctes('persons')} SELECT coalesce(p.person_id, s.s_suppkey) AS id, coalesce(name, s_name) AS name, (person_id IS NOT NULL)::INTEGER AS in_left,
(s_suppkey IS NOT NULL)::INTEGER AS in_right FROM persons p FULL OUTER JOIN supplier s ON p.person_id = s.s_suppkey * 3""",
)
def full_outer_profiles(spark, sf_dir):
    """Full outer join of two profile sources with coalesced fields."""
    p, s = src.persons(spark, sf_dir), src.table(spark, sf_dir, "supplier")
    j = p.join(s, F.col("person_id") == F.col("s_suppkey") * 3, "full_outer")
    return j.select(
        F.coalesce("person_id", "s_suppkey").alias("id"),
        F.coalesce("name", "s_name").alias("name"),
        F.col("person_id").isNotNull().cast("int").alias("in_left"),
        F.col("s_suppkey").isNotNull().cast("int").alias("in_right"),
    )
