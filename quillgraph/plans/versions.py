"""Queries of weights kept as versions, stale companies, promotions and members."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from quillgraph.operators import versions as ops
from quillgraph.sources import adapters as src

from .registry import query

AS_OF = datetime(1997, 1, 1)


@query("weight_versions", """WITH a AS (SELECT o_custkey AS account_id, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM orders GROUP BY 1),
v AS (SELECT c_custkey AS account_id, x AS version, x = 2 AND c_custkey % 7 > 0 OR x = 1 AND c_custkey % 5 = 0 AS is_active, k, CASE k WHEN 'a' THEN 0.02 * x WHEN 'b' THEN 0.39 ELSE 0.3 + x / 100 END AS w FROM customer, (SELECT unnest([1, 2]) AS x), (SELECT unnest(['a', 'b', 'c']) AS k)),
l AS (SELECT * FROM v WHERE is_active QUALIFY version = max(version) OVER (PARTITION BY account_id)), d AS (SELECT l.*, CASE WHEN accuracy < 0.6 THEN -0.05 * (0.6 - accuracy) WHEN accuracy > 0.85 THEN 0.05 * (accuracy - 0.85) ELSE 0 END AS delta FROM l JOIN a USING (account_id)),
n AS (SELECT *, greatest(0.01, least(0.4, w + delta)) AS m FROM d), r AS (SELECT account_id, k, w, CASE WHEN delta = 0 THEN w ELSE round(m * (1.08 / sum(m) OVER (PARTITION BY account_id)), 4) END AS nw FROM n),
moved AS (SELECT account_id FROM r GROUP BY 1 HAVING max(abs(nw - w)) > 0.02)
SELECT account_id, version, is_active AND account_id NOT IN (SELECT account_id FROM moved) AS is_active, round(sum(w * CASE k WHEN 'a' THEN 1 WHEN 'b' THEN 10 ELSE 100 END), 6)::DOUBLE AS told FROM v GROUP BY account_id, version, is_active
UNION ALL SELECT account_id, 3, true, round(sum(nw * CASE k WHEN 'a' THEN 1 WHEN 'b' THEN 10 ELSE 100 END), 6) FROM r WHERE account_id IN (SELECT account_id FROM moved) GROUP BY 1""")
def weight_versions(spark, sf_dir):
    """G21, U-6, U7, W13: the latest active weights moved by accuracy, and a new version only where a weight shifts by more than 0.02."""
    k, x = F.col("c_custkey"), F.col("version")
    v = src.table(spark, sf_dir, "customer").select(k.alias("account_id"), k, F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    weights = F.create_map(F.lit("a"), 0.02 * x, F.lit("b"), F.lit(0.39), F.lit("c"), 0.3 + x / 100)
    v = v.select("account_id", "version", weights.alias("weights"), ((x == 2) & (k % 7 > 0) | (x == 1) & (k % 5 == 0)).alias("is_active"))
    a = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("account_id")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("accuracy"))
    w = F.col("weights")
    return ops.next_versions(v, a).select("account_id", "version", "is_active", F.round(w["a"] + 10 * w["b"] + 100 * w["c"], 6).alias("told"))


@query("stale_companies", """SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY""")
def stale_companies(spark, sf_dir):
    """Companies that are done and not run for 30 days (orders stand for them)."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("pending").alias("status"), F.col("o_orderdate").cast("timestamp").alias("last_run"))
    return ops.stale_companies(o, AS_OF)


@query("tier_promotions", """SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey % 5 < 3 THEN 3 WHEN c_custkey % 5 < 4 THEN c_custkey % 5 END::INTEGER AS tier, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey % 5 < 3 AS touched FROM customer""")
def tier_promotions(spark, sf_dir):
    """Chosen persons below the highest tier get it and a new time."""
    k = F.col("c_custkey")
    p = src.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 < 4, k % 5).cast("int").alias("tier"), F.lit(None).cast("timestamp").alias("updated_at"))
    chosen = src.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return ops.promoted(p, chosen, AS_OF).select("id", "tier", F.col("updated_at").isNotNull().alias("touched"))


@query("company_members", f"""{src.with_ctes('employment')} SELECT c_custkey AS person_id, c_nationkey AS company_id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, e.domain) AS title, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, e.team) AS domain, e.team
FROM customer LEFT JOIN employment e ON e.person_id = c_custkey AND e.company_id = c_nationkey""")
def company_members(spark, sf_dir):
    """Persons with their stints at the present company, current or not."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    p = src.table(spark, sf_dir, "customer").select(k.alias("person_id"), F.col("c_nationkey").alias("company_id"), F.when(k % 2 == 0, seg).alias("title"), F.when(k % 3 == 0, seg).alias("domain"))
    s = src.employment(spark, sf_dir).select("person_id", "company_id", F.col("domain").alias("title"), F.col("team").alias("domain"), "team")
    return ops.company_members(p, s)
