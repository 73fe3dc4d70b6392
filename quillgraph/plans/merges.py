"""Upsert, merge and ledger queries, each as the table's final state."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import merges as ops
from quillgraph.sources import adapters as src

from .registry import query

_OLD = "old AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_nationkey < 20)"
_NEW = "new AS (SELECT o_custkey AS id, 'order-' || max(o_orderkey) AS name, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE min(o_orderpriority) END AS segment, max(o_totalprice) AS balance FROM orders GROUP BY o_custkey)"


def old_rows(spark, sf_dir):
    """The table before: customers of the first twenty nations."""
    c = src.table(spark, sf_dir, "customer").filter("c_nationkey < 20")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def new_rows(spark, sf_dir):
    """The incoming rows: one for each ordering customer."""
    g = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.max("o_orderkey").alias("k"), F.min("o_orderpriority").alias("p"), F.max("o_totalprice").alias("balance")
    )
    return g.select("id", F.concat(F.lit("order-"), F.col("k").cast("string")).alias("name"), F.when(F.col("id") % 3 != 0, F.col("p")).alias("segment"), "balance")


@query("insert_or_ignore", f"WITH {_OLD}, {_NEW} SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_or_ignore(spark, sf_dir):
    """Rows whose key is new."""
    return ops.insert_or_ignore(old_rows(spark, sf_dir), new_rows(spark, sf_dir), ["id"])


@query("overwrite_merge", f"WITH {_OLD}, {_NEW} SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)")
def overwrite_merge(spark, sf_dir):
    """New rows replace old ones."""
    return ops.overwrite(old_rows(spark, sf_dir), new_rows(spark, sf_dir), ["id"], F.col("name"))


@query("coalesce_merge", f"WITH {_OLD}, {_NEW} SELECT id, coalesce(n.name, o.name) AS name, coalesce(n.segment, o.segment) AS segment, CASE WHEN n.id IS NOT NULL THEN n.balance ELSE o.balance END AS balance FROM old o FULL OUTER JOIN new n USING (id)")
def coalesce_merge(spark, sf_dir):
    """U3 in its plain form: new values where there are any; the balance is always the new row's."""
    return ops.coalesce_merge(old_rows(spark, sf_dir), new_rows(spark, sf_dir), ["id"], ["balance"])


@query("fill_nulls", f"WITH {_NEW} SELECT n.id, coalesce(n.segment, c.c_mktsegment) AS segment FROM new n LEFT JOIN customer c ON c.c_custkey = n.id")
def fill_nulls(spark, sf_dir):
    """Only missing values are filled."""
    c = src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    return new_rows(spark, sf_dir).join(c, "id", "left").select("id", F.coalesce("segment", "c_mktsegment").alias("segment"))


@query("tier_promotion", "SELECT c_custkey, greatest(c_custkey % 5, CASE WHEN c_acctbal > 5000 THEN 3 ELSE 0 END)::INTEGER AS tier FROM customer")
def tier_promotion(spark, sf_dir):
    """A tier only ever rises."""
    c = src.table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.greatest(F.col("c_custkey") % 5, F.when(F.col("c_acctbal") > 5000, 3).otherwise(0)).cast("int").alias("tier"))


_CUR = "cur AS (SELECT c_custkey AS report_id, c_nationkey AS manager_id, 'implicit' AS method, (c_custkey % 10) / 10.0::DOUBLE AS confidence FROM customer WHERE c_custkey % 4 <> 0)"
_NXT = "nxt AS (SELECT c_custkey AS report_id, CASE WHEN c_custkey % 6 = 1 THEN 99 ELSE c_nationkey END AS manager_id, 'implicit' AS method, (c_custkey % 10) / 10.0::DOUBLE + CASE WHEN c_custkey % 5 = 0 THEN 0.05 ELSE 0.01 END AS confidence FROM customer WHERE c_custkey % 7 <> 0)"


@query("history_merge", f"""WITH {_CUR}, {_NXT}, j AS (SELECT coalesce(c.report_id, n.report_id) AS report_id, c.manager_id AS cm, n.manager_id AS nm, c.confidence AS cc, n.confidence AS nc,
 coalesce(c.manager_id = n.manager_id AND abs(c.confidence - n.confidence) < 0.02, false) AS same FROM cur c FULL OUTER JOIN nxt n ON c.report_id = n.report_id)
SELECT report_id, cm AS manager_id, round(cc, 6) AS confidence, 'keep' AS action FROM j WHERE same OR nm IS NULL UNION ALL
SELECT report_id, cm, round(cc, 6), 'close' FROM j WHERE NOT same AND cm IS NOT NULL AND nm IS NOT NULL UNION ALL SELECT report_id, nm, round(nc, 6), 'open' FROM j WHERE NOT same AND nm IS NOT NULL""")
def history_merge(spark, sf_dir):
    """Edges kept, closed and opened."""
    c = src.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    base = (k % 10) / 10
    cur = c.filter("c_custkey % 4 <> 0").select(k.alias("report_id"), F.col("c_nationkey").alias("manager_id"), F.lit("implicit").alias("method"), base.alias("confidence"))
    nxt = c.filter("c_custkey % 7 <> 0").select(
        k.alias("report_id"), F.when(k % 6 == 1, 99).otherwise(F.col("c_nationkey")).alias("manager_id"), F.lit("implicit").alias("method"), (base + F.when(k % 5 == 0, 0.05).otherwise(0.01)).alias("confidence")
    )
    out = ops.history_merge(cur, nxt, F.lit("2026-01-01").cast("date"))
    return out.select("report_id", "manager_id", F.round("confidence", 6).alias("confidence"), "action")


@query("version_flip", "SELECT o_custkey, o_orderkey, (o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey))::INTEGER AS active FROM orders")
def version_flip(spark, sf_dir):
    """One active version for each account."""
    from pyspark.sql import Window as W

    newest = F.max("o_orderkey").over(W.partitionBy("o_custkey"))
    return src.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") == newest).cast("int").alias("active"))


@query("evidence_keys", f"{src.with_ctes('authorship')} SELECT DISTINCT sha256('paper:' || work_id || ':' || person_id) AS source_id, work_id FROM authorship")
def evidence_keys(spark, sf_dir):
    """Deterministic evidence ids, so that a second run finds the first one's rows."""
    a = src.authorship(spark, sf_dir)
    return a.select(F.sha2(F.concat_ws(":", F.lit("paper"), "work_id", "person_id"), 256).alias("source_id"), "work_id").distinct()


@query("release_corroboration", "SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, count(DISTINCT l_orderkey) AS corroborations, max(year(l_shipdate)) AS last_year FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2")
def release_corroboration(spark, sf_dir):
    """Distinct releases of each pair, so that a re-run changes nothing."""
    li = src.table(spark, sf_dir, "lineitem").filter("l_partkey <> l_suppkey")
    return li.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(
        F.count_distinct("l_orderkey").alias("corroborations"), F.max(F.year("l_shipdate")).alias("last_year")
    )


@query("invalid_corrections", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag NOT IN ('A', 'N', 'R') OR (l_returnflag = 'R' AND l_discount = 0) OR l_discount < 0 OR l_discount > 1")
def invalid_corrections(spark, sf_dir):
    """Rows that break the rules on types, needed values and attributions."""
    bad = ~F.col("l_returnflag").isin("A", "N", "R") | ((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)) | ~F.col("l_discount").between(0, 1)
    return src.table(spark, sf_dir, "lineitem").filter(bad).select("l_orderkey", "l_linenumber")


@query("stub_persons", "SELECT DISTINCT '[Unknown ' || o_orderpriority || ']' AS name, c_nationkey AS company_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def stub_persons(spark, sf_dir):
    """One stub for each title and company."""
    o, c = src.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), src.table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.concat(F.lit("[Unknown "), "o_orderpriority", F.lit("]")).alias("name"), F.col("c_nationkey").alias("company_id")).distinct()


@query("event_upsert", "SELECT lower(p_name) AS name, p_size AS year, min(p_partkey) AS id, count(*) AS merged FROM part GROUP BY 1, 2")
def event_upsert(spark, sf_dir):
    """U16: events merged by lower-case name and year."""
    return src.table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("name"), F.col("p_size").alias("year")).agg(F.min("p_partkey").alias("id"), F.count("*").alias("merged"))
