"""Upserts with keys that hold nulls, and pairs pivoted out of JSON payloads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators import merges as ops
from quillgraph.sources import adapters as src

from .registry import query


@query("employment_upsert", """WITH old AS (SELECT o_custkey AS person_id, o_orderpriority AS company, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS start_year,
 CASE WHEN min(o_totalprice) >= 50000 THEN 'order ' || min(o_orderkey) END AS title, max(year(o_orderdate)) AS end_year, true AS is_current FROM orders GROUP BY ALL),
new AS (SELECT o_custkey AS person_id, o_orderpriority AS company, CASE WHEN l_returnflag <> 'R' THEN year(l_shipdate) END AS start_year,
 CASE WHEN min(l_discount) > 0 THEN 'line ' || min(l_linenumber) END AS title, CASE WHEN max(l_discount) >= 0.05 THEN max(year(l_shipdate)) END AS end_year, min(l_returnflag) = 'N' AS is_current
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT coalesce(n.person_id, o.person_id) AS person_id, coalesce(n.company, o.company) AS company, coalesce(n.start_year, o.start_year) AS start_year, coalesce(n.title, o.title) AS title,
 coalesce(n.end_year, o.end_year) AS end_year, (CASE WHEN n.person_id IS NOT NULL THEN n.is_current ELSE o.is_current END)::INTEGER AS is_current
FROM old o FULL OUTER JOIN new n ON o.person_id = n.person_id AND o.company = n.company AND coalesce(o.start_year, 0) = coalesce(n.start_year, 0)""")
def employment_upsert(spark, sf_dir):
    """One row for a person, company and start year (none counts as 0); new values where there are any, is_current always the new row's."""
    o, li = src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "lineitem")
    key = ["person_id", "company", "start_key"]
    of = lambda year, shown: [F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("company"), F.coalesce(F.when(shown, year), F.lit(0)).alias("start_key")]
    old = o.groupBy(*of(F.year("o_orderdate"), F.col("o_orderstatus") != "P")).agg(
        F.when(F.min("o_totalprice") >= 50000, F.concat(F.lit("order "), F.min("o_orderkey").cast("string"))).alias("title"), F.max(F.year("o_orderdate")).alias("end_year"), F.lit(1).alias("is_current")
    )
    new = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(*of(F.year("l_shipdate"), F.col("l_returnflag") != "R")).agg(
        F.when(F.min("l_discount") > 0, F.concat(F.lit("line "), F.min("l_linenumber").cast("string"))).alias("title"),
        F.when(F.max("l_discount") >= 0.05, F.max(F.year("l_shipdate"))).alias("end_year"),
        (F.min("l_returnflag") == "N").cast("int").alias("is_current"),
    )
    merged = ops.coalesce_merge(old, new, key, ["is_current"])
    return merged.select("person_id", "company", F.nullif("start_key", F.lit(0)).alias("start_year"), "title", "end_year", "is_current")


@query("retrofilled_employment", """WITH old AS (SELECT o_orderkey AS id, o_custkey AS p, o_orderstatus AS c, CASE WHEN o_totalprice >= 100000 THEN o_orderpriority END AS title, CASE WHEN o_totalprice >= 200000 THEN year(o_orderdate) END AS start_year FROM orders),
new AS (SELECT o_custkey AS p, o_orderstatus AS c, o_orderpriority AS title, min(year(o_orderdate)) AS start_year FROM orders GROUP BY 1, 2, 3),
titled AS (SELECT p, c, title, min(id) AS id FROM old WHERE title IS NOT NULL GROUP BY 1, 2, 3),
rest AS (SELECT n.*, row_number() OVER (PARTITION BY n.p, n.c ORDER BY n.title) AS k FROM new n LEFT JOIN titled t USING (p, c, title) WHERE t.id IS NULL),
blank AS (SELECT p, c, id, row_number() OVER (PARTITION BY p, c ORDER BY id) AS k FROM old WHERE title IS NULL),
hit AS (SELECT t.id, n.title, n.start_year FROM titled t JOIN new n USING (p, c, title) UNION ALL SELECT b.id, r.title, r.start_year FROM rest r JOIN blank b USING (p, c, k))
SELECT o.p AS person_id, o.c AS company, coalesce(o.title, h.title) AS title, coalesce(o.start_year, h.start_year) AS start_year, o.id FROM old o LEFT JOIN hit h USING (id)
UNION ALL SELECT r.p, r.c, r.title, r.start_year, NULL FROM rest r LEFT JOIN blank b USING (p, c, k) WHERE b.id IS NULL""")
def retrofilled_employment(spark, sf_dir):
    """A past stint fills the nulls of the row with its title, else of a row without one (in order of title and id), else is new."""
    o = src.table(spark, sf_dir, "orders")
    at = ["person_id", "company"]
    named = [F.col("o_custkey").alias("person_id"), F.col("o_orderstatus").alias("company")]
    old = o.select(*named, F.when(F.col("o_totalprice") >= 100000, F.col("o_orderpriority")).alias("title"), F.when(F.col("o_totalprice") >= 200000, F.year("o_orderdate")).alias("start_year"), F.col("o_orderkey").alias("id"))
    new = o.groupBy(*named, F.col("o_orderpriority").alias("title")).agg(F.min(F.year("o_orderdate")).alias("start_year"))
    titled = old.filter("title IS NOT NULL").groupBy(*at, "title").agg(F.min("id").alias("id"))
    matched = new.join(titled, [*at, "title"], "left")
    rest = matched.filter("id IS NULL").drop("id").withColumn("k", F.row_number().over(W.partitionBy(*at).orderBy("title")))
    blank = old.filter("title IS NULL").select(*at, "id", F.row_number().over(W.partitionBy(*at).orderBy("id")).alias("k"))
    placed = rest.join(blank, [*at, "k"], "left")
    hits = matched.unionByName(placed.drop("k")).filter("id IS NOT NULL").select("id", F.col("title").alias("t"), F.col("start_year").alias("y"))
    filled = old.join(hits, "id", "left").select(*at, F.coalesce("title", "t").alias("title"), F.coalesce("start_year", "y").alias("start_year"), "id")
    return filled.unionByName(placed.filter("id IS NULL").drop("k"))


@query("paper_pairs", """WITH s AS (SELECT o_custkey AS prospect_id, json_object('semantic_scholar_id', 'w' || (o_orderkey % 50), 'connected_to', ((o_custkey * 7 + 3) % 2000)::VARCHAR, 'year', CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE year(o_orderdate)::VARCHAR END) AS value FROM orders)
SELECT DISTINCT least(a.c_custkey, b.c_custkey) AS person_a_id, greatest(a.c_custkey, b.c_custkey) AS person_b_id, json_extract_string(value, '$.semantic_scholar_id') AS paper_id,
 CASE WHEN regexp_full_match(json_extract_string(value, '$.year'), '[0-9]+') THEN json_extract_string(value, '$.year')::INTEGER END AS year
FROM s JOIN customer a ON a.c_custkey = prospect_id JOIN customer b ON b.c_custkey::VARCHAR = json_extract_string(value, '$.connected_to') AND b.c_custkey <> a.c_custkey""")
def paper_pairs(spark, sf_dir):
    """Pairs of persons and papers out of the payloads' ``connected_to``; years that aren't digits are null."""
    o, c = src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "customer").select("c_custkey")
    payload = F.to_json(F.struct(
        F.concat(F.lit("w"), (F.col("o_orderkey") % 50).cast("string")).alias("semantic_scholar_id"), ((F.col("o_custkey") * 7 + 3) % 2000).cast("string").alias("connected_to"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.year("o_orderdate").cast("string")).alias("year"),
    ))
    s = o.select(F.col("o_custkey").alias("a"), F.from_json(payload, "semantic_scholar_id string, connected_to string, year string").alias("v"))
    s = s.select("a", F.col("v.connected_to").alias("to"), F.col("v.semantic_scholar_id").alias("paper_id"), F.when(F.col("v.year").rlike("^[0-9]+$"), F.col("v.year").cast("int")).alias("year"))
    both = s.join(c, F.col("c_custkey") == F.col("a"), "left_semi").join(c.select(F.col("c_custkey").alias("b")), F.col("b").cast("string") == F.col("to")).filter("a <> b")
    return both.select(F.least("a", "b").alias("person_a_id"), F.greatest("a", "b").alias("person_b_id"), "paper_id", "year").distinct()


@query("top_links", """WITH e AS (SELECT o_custkey AS prospect_id, l_suppkey AS other_id, count(*) AS strength FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT prospect_id, other_id, strength FROM e QUALIFY row_number() OVER (PARTITION BY prospect_id ORDER BY strength DESC, other_id) <= 8""")
def top_links(spark, sf_dir):
    """The eight strongest links of each prospect, ties to the smaller id."""
    o, li = src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "lineitem")
    e = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("prospect_id"), F.col("l_suppkey").alias("other_id")).agg(F.count("*").alias("strength"))
    return e.withColumn("k", F.row_number().over(W.partitionBy("prospect_id").orderBy(F.desc("strength"), "other_id"))).filter("k <= 8").drop("k")


@query("rollup_counters", "SELECT event_type AS job, count(*) AS scanned, count(value) AS qualifying, count(DISTINCT user_id) AS prospects FROM events GROUP BY 1")
def rollup_counters(spark, sf_dir):
    """Counters of each job: signals scanned, those with a value, prospects."""
    e = src.table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("job")).agg(F.count("*").alias("scanned"), F.count("value").alias("qualifying"), F.count_distinct("user_id").alias("prospects"))
