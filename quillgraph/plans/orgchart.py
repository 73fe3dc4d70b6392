"""Org-chart queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scoring as fs
from quillgraph.operators import forest
from quillgraph.operators import graphs as gops
from quillgraph.operators import orgchart as ops
from quillgraph.sources import adapters as src

from .registry import query

_M = f"{src.with_ctes('persons')}, members AS (SELECT *, person_id % 4 = 0 AS is_manager_title FROM persons)"
_TIER = "CASE WHEN {0} >= 85 THEN 'c_suite' WHEN {0} >= 75 THEN 'svp' WHEN {0} >= 65 THEN 'vp' WHEN {0} >= 55 THEN 'director' ELSE 'manager' END"
_CAP = "CASE WHEN {0} >= 85 THEN 8 WHEN {0} >= 75 THEN 7 WHEN {0} >= 65 THEN 8 WHEN {0} >= 55 THEN 10 ELSE 12 END"
_SCORED = """scored AS (SELECT m.company_id, m.domain, m.person_id AS manager_id, r.person_id AS report_id, m.seniority AS ms, m.seniority - r.seniority AS gap,
 CASE WHEN m.team = r.team THEN 0.15 ELSE 0.0 END AS sub, CASE WHEN m.is_manager_title THEN 0.10 ELSE 0.0 END AS title
 FROM members m JOIN members r ON m.company_id = r.company_id AND m.domain = r.domain AND m.seniority > r.seniority AND (r.is_ic_track OR NOT m.is_ic_track)),
cand AS (SELECT *, least(0.95, g + 0.25 + sub + title + 0.05 + 0.08)::DOUBLE AS confidence, CASE WHEN g >= 0.25 THEN 'seniority_gap' ELSE 'domain_match' END AS dominant FROM (
 SELECT *, (CASE WHEN gap BETWEEN 8 AND 15 THEN 0.30 WHEN gap BETWEEN 5 AND 7 THEN 0.18 WHEN gap BETWEEN 16 AND 25 THEN 0.12 ELSE 0 END)::DOUBLE AS g FROM scored) WHERE g > 0)"""
_BEST = "best AS (SELECT company_id, domain, report_id, manager_id, round(confidence, 9) AS confidence, dominant FROM cand QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY round(confidence, 9) DESC, manager_id) = 1)"


def members(spark, sf_dir):
    """Cluster members: persons; every fourth has a manager's title."""
    return src.persons(spark, sf_dir).withColumn("is_manager_title", F.col("person_id") % 4 == 0)


@query("functional_clusters", f"""{_M} SELECT company_id, domain, -1 AS team, count(*) AS members, 0.95::DOUBLE AS confidence FROM members GROUP BY 1, 2
UNION ALL SELECT company_id, domain, team, count(*), 0.90::DOUBLE FROM members GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def functional_clusters(spark, sf_dir):
    """Functional clusters and their team sub-clusters (team -1: the main cluster)."""
    return ops.clusters(members(spark, sf_dir)).withColumn("team", F.coalesce("team", F.lit(-1)))


@query("pair_scores", f"{_M}, {_SCORED} SELECT manager_id, report_id, round(confidence, 6) AS confidence, dominant FROM cand")
def pair_scores(spark, sf_dir):
    """Confidence and leading component of every candidate edge."""
    return ops.pair_scores(members(spark, sf_dir)).select("manager_id", "report_id", F.round("confidence", 6).alias("confidence"), "dominant")


@query("best_managers", f"{_M}, {_SCORED}, {_BEST} SELECT company_id, domain, report_id, manager_id, confidence, dominant FROM best")
def best_managers(spark, sf_dir):
    """G9 without binding limits: each report's best manager."""
    return ops.best_of_members(members(spark, sf_dir))


#: The greedy loop itself: each cluster's candidates in order, with the list of edges taken so far.
_GREEDY = f"""listed AS (SELECT company_id, domain, list({{'m': manager_id, 'r': report_id, 'c': round(confidence, 6), 'd': dominant, 'cap': {_CAP.format('ms')}}} ORDER BY round(confidence, 9) DESC, manager_id, report_id) AS l FROM cand GROUP BY ALL),
taken AS (SELECT company_id, domain, l, 1::BIGINT AS i, l[1:0] AS t FROM listed UNION ALL SELECT company_id, domain, l, i + 1,
 CASE WHEN len(list_filter(t, lambda x: x.r = l[i].r)) = 0 AND len(list_filter(t, lambda x: x.m = l[i].m)) < l[i].cap THEN list_append(t, l[i]) ELSE t END FROM taken WHERE i <= len(l))"""


@query("assigned_tree", f"""{_M.replace('WITH', 'WITH RECURSIVE', 1)}, {_SCORED}, {_GREEDY}
SELECT company_id, domain, e.m AS manager_id, e.r AS report_id, e.c AS confidence, e.d AS dominant FROM (SELECT company_id, domain, unnest(t) AS e FROM taken WHERE i = len(l) + 1)""")
def assigned_tree(spark, sf_dir):
    """Greedy assignment with span limits, by profiles."""
    edges = ops.assign_members(members(spark, sf_dir))
    return edges.withColumn("confidence", F.round("confidence", 6))


@query("explicit_over_implicit", f"{_M}, {_SCORED}, {_BEST} SELECT b.report_id, b.manager_id FROM best b WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = b.report_id AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def explicit_over_implicit(spark, sf_dir):
    """Implicit edges of reports without an explicit one."""
    o = src.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("report_id"))
    return best_managers(spark, sf_dir).join(o, "report_id", "left_anti").select("report_id", "manager_id")


_WALK = """walk AS (SELECT DISTINCT manager_id AS node, 1.0::DOUBLE AS v, 0 AS depth FROM best WHERE manager_id NOT IN (SELECT report_id FROM best)
 UNION ALL SELECT b.report_id, v * b.confidence, depth + 1 FROM walk JOIN best b ON b.manager_id = walk.node)"""


@query("propagated_confidence", f"{_M.replace('WITH', 'WITH RECURSIVE', 1)}, {_SCORED}, {_BEST}, {_WALK} SELECT node, round(v, 9) AS path_confidence, depth FROM walk")
def propagated_confidence(spark, sf_dir):
    """Confidence multiplied down from the roots, and the depth."""
    e = best_managers(spark, sf_dir)
    return gops.down_the_tree(e, F.col("confidence")).select("node", F.round("value", 9).alias("path_confidence"), "depth")


@query("scope_estimates", f"""{_M.replace('WITH', 'WITH RECURSIVE', 1)}, {_SCORED}, {_BEST}, sub AS (SELECT manager_id AS root, report_id AS tip, 1 AS d FROM best UNION ALL SELECT root, b.report_id, d + 1 FROM sub JOIN best b ON b.manager_id = sub.tip WHERE d < 8)
SELECT root, count(DISTINCT tip) FILTER (d = 1) AS direct, count(DISTINCT tip) AS subtree, {_TIER.format('seniority')} AS budget FROM sub JOIN members ON person_id = root WHERE root <> tip GROUP BY root, seniority""")
def scope_estimates(spark, sf_dir):
    """Direct and transitive reports and the budget tier of every manager."""
    s = gops.subtree_sizes(best_managers(spark, sf_dir))
    p = members(spark, sf_dir).select(F.col("person_id").alias("root"), fs.seniority_tier(F.col("seniority")).alias("budget"))
    return s.join(p, "root")


@query("span_violations", f"""{_M}, {_SCORED}, {_BEST} SELECT manager_id, tier, reports, cap FROM (SELECT manager_id, {_TIER.format('seniority')} AS tier, count(*) AS reports, {_CAP.format('seniority')} AS cap
FROM best JOIN members ON person_id = manager_id GROUP BY manager_id, seniority) WHERE reports > cap""")
def span_violations(spark, sf_dir):
    """Managers over their span limit."""
    return ops.span_violations(best_managers(spark, sf_dir), members(spark, sf_dir))


@query("ic_misclassification", f"{_M} SELECT m.person_id AS manager_id, count(*) AS reports FROM members m JOIN members r ON r.person_id = m.person_id + 1 AND m.is_ic_track AND NOT r.is_ic_track GROUP BY 1")
def ic_misclassification(spark, sf_dir):
    """IC-track managers of people who aren't (a chain of neighbours stands for the edges)."""
    m = members(spark, sf_dir)
    one = m.filter("is_ic_track").select(F.col("person_id").alias("manager_id"), (F.col("person_id") + 1).alias("report_id"))
    two = m.filter("NOT is_ic_track").select(F.col("person_id").alias("report_id"))
    return one.join(two, "report_id").groupBy("manager_id").agg(F.count("*").alias("reports"))


_LOOP = "e AS (SELECT c_custkey AS report_id, CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 4 ELSE c_custkey + 1 END AS manager_id FROM customer)"


@query("reporting_cycles", f"""WITH RECURSIVE {_LOOP}, w AS (SELECT report_id AS start, manager_id AS tip, report_id::VARCHAR AS cycle FROM e WHERE manager_id >= report_id
UNION ALL SELECT start, e.manager_id, cycle || '>' || tip FROM w JOIN e ON e.report_id = w.tip WHERE tip > start AND e.manager_id >= start)
SELECT start AS least, cycle FROM w WHERE tip = start""")
def reporting_cycles(spark, sf_dir):
    """Cycles of five members among reporting edges, each once."""
    c = src.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return forest.find_cycles(c.select(k.alias("report_id"), F.when(k % 5 == 4, k - 4).otherwise(k + 1).alias("manager_id")))


@query("all_reporting_cycles", """WITH RECURSIVE e AS (SELECT c_custkey AS report_id, CASE WHEN c_custkey % 7 = 6 THEN c_custkey - 6 ELSE c_custkey + 1 END AS manager_id FROM customer),
w AS (SELECT report_id AS start, manager_id AS tip, report_id::VARCHAR AS cycle FROM e WHERE manager_id >= report_id
UNION ALL SELECT start, e.manager_id, cycle || '>' || tip FROM w JOIN e ON e.report_id = w.tip WHERE tip > start AND e.manager_id >= start)
SELECT start AS least, cycle FROM w WHERE tip = start""")
def all_reporting_cycles(spark, sf_dir):
    """G18 over every customer, with cycles of seven members."""
    k = F.col("c_custkey")
    c = src.table(spark, sf_dir, "customer")
    return forest.find_cycles(c.select(k.alias("report_id"), F.when(k % 7 == 6, k - 6).otherwise(k + 1).alias("manager_id")))


@query("component_nudges", """WITH c AS (SELECT p_brand AS component, count(*) FILTER (l_returnflag <> 'R' AND l_linenumber = 1) AS right_n, count(*) FILTER (l_returnflag = 'R' AND l_linenumber = 1) AS wrong_n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
g AS (SELECT sum(wrong_n) * 1.0 / sum(right_n + wrong_n) AS e FROM c)
SELECT component, right_n, wrong_n, round(greatest(0.01, least(0.5, CASE WHEN right_n + wrong_n >= 5 THEN 0.2 * (1 - 0.15 * wrong_n / (right_n + wrong_n)) ELSE 0.2 * (1 - 0.05 * e) END)), 9) AS weight FROM c, g""")
def component_nudges(spark, sf_dir):
    """Right and wrong corrections of each component and its new weight."""
    li, p = src.table(spark, sf_dir, "lineitem").filter("l_linenumber = 1"), src.table(spark, sf_dir, "part")
    wrong = F.col("l_returnflag") == "R"
    all_parts = p.select(F.col("p_brand").alias("component")).join(
        src.table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("component")).distinct(), "component", "left_semi"
    ).distinct()
    c = li.join(p, li.l_partkey == p.p_partkey).groupBy(F.col("p_brand").alias("component")).agg(F.count_if(~wrong).alias("right_n"), F.count_if(wrong).alias("wrong_n"))
    c = all_parts.join(c, "component", "left").fillna(0, ["right_n", "wrong_n"])
    every = W.partitionBy(F.lit(1))  # one row for each component
    e = F.sum("wrong_n").over(every) / F.sum(F.col("right_n") + F.col("wrong_n")).over(every)
    return c.select("component", "right_n", "wrong_n", F.round(ops.nudged(F.lit(0.2), F.col("right_n"), F.col("wrong_n"), e), 9).alias("weight"))


@query("tuned_weights", """WITH a AS (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS accuracy FROM orders GROUP BY 1),
w AS (SELECT o_custkey, accuracy, unnest([0.30, 0.25, 0.15, 0.10, 0.05, 0.15, 0.08]::DOUBLE[]) AS old, unnest(range(7)) AS i, CASE WHEN accuracy < 0.60 THEN -0.05 * (0.60 - accuracy) WHEN accuracy > 0.85 THEN 0.05 * (accuracy - 0.85) ELSE 0 END AS delta FROM a),
n AS (SELECT *, greatest(0.01, least(0.40, old + delta)) AS moved FROM w)
SELECT o_custkey, i::INTEGER AS i, round(CASE WHEN delta = 0 THEN old ELSE moved * 1.08 / sum(moved) OVER (PARTITION BY o_custkey) END, 4) AS weight FROM n""")
def tuned_weights(spark, sf_dir):
    """G21, U-6: weights moved by accuracy, clamped and renormalised to 1.08."""
    a = src.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("accuracy"))
    acc = F.col("accuracy")
    delta = F.when(acc < 0.60, -0.05 * (0.60 - acc)).when(acc > 0.85, 0.05 * (acc - 0.85)).otherwise(0.0)
    old = F.array(*[F.lit(x) for x in (0.30, 0.25, 0.15, 0.10, 0.05, 0.15, 0.08)])
    moved = F.transform(old, lambda x: F.greatest(F.lit(0.01), F.least(F.lit(0.40), x + F.col("delta"))))
    total = F.aggregate("moved", F.lit(0.0), lambda s, x: s + x)
    rows = a.withColumn("delta", delta).withColumns({"old": old, "moved": moved}).withColumn("total", total)
    new = F.when(F.col("delta") == 0, F.col("old")).otherwise(F.transform("moved", lambda x: x * 1.08 / F.col("total")))
    return rows.select("o_custkey", F.posexplode(new).alias("i", "w")).select("o_custkey", "i", F.round("w", 4).alias("weight"))


@query("zero_cluster_companies", f"{_M} SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT company_id FROM members GROUP BY 1 HAVING count(*) >= 60)")
def zero_cluster_companies(spark, sf_dir):
    """Companies without a large enough cluster."""
    big = members(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n")).filter("n >= 60").select(F.col("company_id").alias("n_nationkey"))
    return src.table(spark, sf_dir, "nation").join(big, "n_nationkey", "left_anti").select("n_nationkey")


@query("org_context", f"""{_M}, {_SCORED}, {_BEST} SELECT b.report_id, b.manager_id, count(p.report_id) AS peers FROM best b LEFT JOIN best p ON p.manager_id = b.manager_id AND p.report_id <> b.report_id GROUP BY 1, 2""")
def org_context(spark, sf_dir):
    """everyone's manager and number of peers, without pairing the peers."""
    b = best_managers(spark, sf_dir).select("report_id", "manager_id")
    return b.withColumn("peers", F.count("*").over(W.partitionBy("manager_id")) - 1)


#: Reporting edges of a company by number: the manager of n is n / 3; in two companies of five the top is bent into cycles.
_LINES = """numbered AS (SELECT c_nationkey AS company_id, c_custkey AS person_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
bent AS (SELECT company_id, person_id, CASE WHEN company_id % 5 = 0 AND i = 0 THEN n - 1 WHEN company_id % 5 = 1 AND i IN (1, 4) THEN 5 - i WHEN i > 0 THEN i // 3 END AS up FROM numbered),
e AS (SELECT a.company_id, a.person_id AS report_id, b.person_id AS manager_id FROM bent a JOIN numbered b ON a.company_id = b.company_id AND a.up = b.i)"""


def lines(spark, sf_dir):
    """Reporting edges with cycles in two companies of five, twin of ``_LINES``."""
    by = W.partitionBy("company_id")
    numbered = src.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("company_id"), F.col("c_custkey").alias("person_id"))
    numbered = numbered.withColumns({"i": F.row_number().over(by.orderBy("person_id")) - 1, "n": F.count("*").over(by).cast("int")})
    i, five = F.col("i"), F.col("company_id") % 5
    up = F.when((five == 0) & (i == 0), F.col("n") - 1).when((five == 1) & i.isin(1, 4), 5 - i).when(i > 0, F.floor(i / 3).cast("int"))
    above = numbered.select("company_id", F.col("person_id").alias("manager_id"), F.col("i").alias("up"))
    return numbered.withColumn("up", up).join(above, ["company_id", "up"]).select("company_id", F.col("person_id").alias("report_id"), "manager_id")


@query("org_layout", f"""{src.with_ctes('persons').replace('WITH', 'WITH RECURSIVE', 1)}, {_LINES},
shown AS (SELECT i.company_id, i.person_id, domain, seniority, name FROM (SELECT company_id, report_id AS person_id FROM e UNION SELECT company_id, manager_id FROM e) i LEFT JOIN persons p ON p.person_id = i.person_id),
tops AS (SELECT company_id, person_id, seniority FROM shown s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.company_id = s.company_id AND e.report_id = s.person_id)),
roots AS (SELECT company_id, person_id FROM tops UNION ALL SELECT company_id, arg_min(person_id, (-coalesce(seniority, 0), person_id)) FROM shown WHERE company_id NOT IN (SELECT company_id FROM tops) GROUP BY 1),
walk AS (SELECT company_id, person_id, 0 AS depth, person_id AS root FROM roots UNION ALL SELECT e.company_id, report_id, depth + 1, root FROM walk JOIN e ON e.company_id = walk.company_id AND e.manager_id = walk.person_id AND e.report_id <> root)
SELECT company_id, person_id, coalesce(depth, 0) AS depth, row_number() OVER (PARTITION BY company_id, coalesce(depth, 0) ORDER BY domain NULLS LAST, seniority DESC NULLS LAST, name NULLS LAST, person_id)::INTEGER AS place
FROM shown LEFT JOIN walk USING (company_id, person_id)""")
def org_layout(spark, sf_dir):
    """Depth and place of everyone in the chart of a company, with stand-in roots and leftovers."""
    return forest.layout(lines(spark, sf_dir), src.persons(spark, sf_dir))
