"""Aggregation and window queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.sources import adapters as src

from .registry import query

_P = src.with_ctes("persons", "companies")


def people(spark, sf_dir):
    """Persons with their company's name and industry; the plan broadcasts companies only while their size allows it."""
    return src.persons(spark, sf_dir).join(src.companies(spark, sf_dir), "company_id")


@query("headcount_facet", f"{_P} SELECT company, industry, count(*) AS n FROM persons JOIN companies USING (company_id) GROUP BY ALL")
def headcount_facet(spark, sf_dir):
    """A4: headcount by company and industry."""
    return people(spark, sf_dir).groupBy("company", "industry").agg(F.count("*").alias("n"))


@query(
    "conditional_counts",
    f"{_P} SELECT company_id, count(*) AS n, count(*) FILTER (seniority >= 75) AS senior, count(*) FILTER (is_ic_track) AS ic, count(*) FILTER (score < 0) AS negative FROM persons GROUP BY 1",
)
def conditional_counts(spark, sf_dir):
    """A5: conditional counts in one pass."""
    return src.persons(spark, sf_dir).groupBy("company_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("seniority") >= 75).alias("senior"), F.count_if("is_ic_track").alias("ic"), F.count_if(F.col("score") < 0).alias("negative")
    )


@query("eligible_companies", f"{_P} SELECT company_id, count(*) AS n FROM persons GROUP BY 1 HAVING count(*) >= 60")
def eligible_companies(spark, sf_dir):
    """Groups with at least so many members."""
    return src.persons(spark, sf_dir).groupBy("company_id").agg(F.count("*").alias("n")).filter("n >= 60")


@query("any_ic", f"{_P} SELECT company_id, domain, bool_or(is_ic_track)::INTEGER AS any_ic, bool_and(is_ic_track)::INTEGER AS all_ic FROM persons GROUP BY 1, 2")
def any_ic(spark, sf_dir):
    """A10: whether any member is on the IC track."""
    return src.persons(spark, sf_dir).groupBy("company_id", "domain").agg(
        F.bool_or("is_ic_track").cast("int").alias("any_ic"), F.bool_and("is_ic_track").cast("int").alias("all_ic")
    )


@query(
    "sorted_sets",
    f"{_P} SELECT company_id, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, string_agg(DISTINCT team::VARCHAR, ',' ORDER BY team::VARCHAR) AS teams FROM persons GROUP BY 1",
)
def sorted_sets(spark, sf_dir):
    """Sorted distinct values of each group."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",")
    return src.persons(spark, sf_dir).groupBy("company_id").agg(joined("domain").alias("domains"), joined("team").alias("teams"))


@query(
    "work_histories",
    """SELECT l_suppkey, string_agg(l_orderkey || ':' || l_partkey, ',' ORDER BY l_orderkey, l_linenumber, l_partkey) AS history FROM lineitem GROUP BY 1""",
)
def work_histories(spark, sf_dir):
    """Ordered list of structs of each group."""
    li = src.table(spark, sf_dir, "lineitem")
    rows = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey")))
    text = F.transform(rows, lambda r: F.concat(r["l_orderkey"].cast("string"), F.lit(":"), r["l_partkey"].cast("string")))
    return li.groupBy("l_suppkey").agg(F.array_join(text, ",").alias("history"))


@query(
    "monthly_spend",
    f"{src.with_ctes('cost_log')} SELECT vendor, strftime(called_at, '%Y-%m') AS month, sum(cost_cents)::BIGINT AS cents, count(*) AS calls FROM cost_log GROUP BY 1, 2",
)
def monthly_spend(spark, sf_dir):
    """Spend by vendor and month."""
    month = F.date_format("called_at", "yyyy-MM").alias("month")
    return src.cost_log(spark, sf_dir).groupBy("vendor", month).agg(F.sum("cost_cents").alias("cents"), F.count("*").alias("calls"))


@query(
    "budget_state",
    f"""{src.with_ctes('cost_log')}, caps AS (SELECT c_custkey AS account_id, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE (c_custkey % 97) * 1000000 END::BIGINT AS cap FROM customer),
spent AS (SELECT account_id, sum(cost_cents)::BIGINT AS cents FROM cost_log GROUP BY 1)
SELECT account_id, cap, coalesce(cents, 0) AS spent, CASE WHEN cap = 0 THEN -1 ELSE greatest(0, cap - coalesce(cents, 0)) END AS remaining, (cap <> 0 AND coalesce(cents, 0) >= cap)::INTEGER AS exhausted FROM caps LEFT JOIN spent USING (account_id)""",
)
def budget_state(spark, sf_dir):
    """What is left of each budget; a cap of 0 means no limit (remaining -1)."""
    c = src.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    caps = c.select(k.alias("account_id"), F.when(k % 10 == 0, 0).otherwise((k % 97) * 1000000).cast("long").alias("cap"))
    spent = src.cost_log(spark, sf_dir).groupBy("account_id").agg(F.sum("cost_cents").alias("cents"))
    s = F.coalesce("cents", F.lit(0))
    return caps.join(spent, "account_id", "left").select(
        "account_id", "cap", s.alias("spent"), F.when(F.col("cap") == 0, -1).otherwise(F.greatest(F.lit(0), F.col("cap") - s)).alias("remaining"),
        ((F.col("cap") != 0) & (s >= F.col("cap"))).cast("int").alias("exhausted"),
    )


@query(
    "method_performance",
    """WITH c AS (SELECT l_shipmode_like AS method, count(*) AS edges, count(*) FILTER (l_returnflag = 'R') AS edge_wrong, count(*) FILTER (l_returnflag = 'A') AS team_wrong
 FROM (SELECT *, l_linestatus || (l_linenumber % 3) AS l_shipmode_like FROM lineitem) GROUP BY 1)
SELECT method, edge_wrong + team_wrong // 2 AS errors, greatest(0, edges - (edge_wrong + team_wrong // 2)) AS successes FROM c""",
)
def method_performance(spark, sf_dir):
    """Successes and errors of each inference method."""
    li = src.table(spark, sf_dir, "lineitem").withColumn("method", F.concat("l_linestatus", (F.col("l_linenumber") % 3).cast("string")))
    c = li.groupBy("method").agg(
        F.count("*").alias("edges"), F.count_if(F.col("l_returnflag") == "R").alias("edge_wrong"), F.count_if(F.col("l_returnflag") == "A").alias("team_wrong")
    )
    errors = F.expr("edge_wrong + team_wrong div 2")
    return c.select("method", errors.alias("errors"), F.greatest(F.lit(0), F.col("edges") - errors).alias("successes"))


@query(
    "hub_stats",
    f"""{_P} SELECT company_id, count(*) AS total, coalesce(round(avg(score), 1), 0) AS avg_score, count(*) FILTER (score >= 75) AS high FROM persons GROUP BY 1""",
)
def hub_stats(spark, sf_dir):
    """Totals, mean score and high scores of each hub."""
    return src.persons(spark, sf_dir).groupBy("company_id").agg(
        F.count("*").alias("total"), F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("avg_score"), F.count_if(F.col("score") >= 75).alias("high")
    )


@query(
    "hub_top_people",
    f"{_P} SELECT company_id, person_id, score, row_number() OVER w AS rank FROM persons WINDOW w AS (PARTITION BY company_id ORDER BY score DESC, person_id) QUALIFY row_number() OVER w <= 8",
)
def hub_top_people(spark, sf_dir):
    """Eight best people of each hub; the limit is pushed below the shuffle."""
    by = W.partitionBy("company_id").orderBy(F.desc("score"), "person_id")
    return src.persons(spark, sf_dir).withColumn("rank", F.row_number().over(by)).filter("rank <= 8").select("company_id", "person_id", "score", "rank")


@query(
    "hub_top_roles",
    f"""{_P}, n AS (SELECT company_id, domain, count(*) AS n FROM persons GROUP BY 1, 2)
SELECT company_id, domain, n FROM n QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY n DESC, domain) <= 3""",
)
def hub_top_roles(spark, sf_dir):
    """Three most common roles of each hub."""
    n = src.persons(spark, sf_dir).groupBy("company_id", "domain").agg(F.count("*").alias("n"))
    by = W.partitionBy("company_id").orderBy(F.desc("n"), "domain")
    return n.withColumn("r", F.row_number().over(by)).filter("r <= 3").drop("r")


@query(
    "hub_membership",
    f"""{_P}, m AS (SELECT DISTINCT 'company:' || company AS hub, person_id FROM persons JOIN companies USING (company_id) UNION SELECT DISTINCT 'industry:' || industry, person_id FROM persons JOIN companies USING (company_id)
UNION SELECT 'role:' || domain, person_id FROM persons) SELECT hub, count(*) AS members FROM m GROUP BY 1""",
)
def hub_membership(spark, sf_dir):
    """Members of company, industry and role hubs."""
    hubs = F.explode(F.array(F.concat(F.lit("company:"), "company"), F.concat(F.lit("industry:"), "industry"), F.concat(F.lit("role:"), "domain"))).alias("hub")
    return people(spark, sf_dir).select("person_id", hubs).distinct().groupBy("hub").agg(F.count("*").alias("members"))


@query(
    "warm_paths_by_company",
    """WITH p AS (SELECT l_suppkey % 25 AS company_id, l_partkey AS target, l_discount AS strength, l_linenumber AS hops FROM lineitem)
SELECT company_id, count(*) AS total_paths, count(DISTINCT target) AS unique_targets, max(strength) AS best_strength, floor(quantile_cont(hops, 0.5) + 0.5)::BIGINT AS median_hops FROM p GROUP BY 1""",
)
def warm_paths_by_company(spark, sf_dir):
    """Paths by terminal company; an even count's median is rounded half up."""
    li = src.table(spark, sf_dir, "lineitem")
    p = li.select((F.col("l_suppkey") % 25).alias("company_id"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("strength"), F.col("l_linenumber").alias("hops"))
    return p.groupBy("company_id").agg(
        F.count("*").alias("total_paths"), F.count_distinct("target").alias("unique_targets"), F.max("strength").alias("best_strength"),
        F.floor(F.percentile("hops", 0.5) + 0.5).alias("median_hops"),
    )


@query(
    "best_path_per_target",
    """SELECT l_suppkey % 25 AS company_id, l_partkey AS target, count(*) AS paths, max(l_discount) AS best_strength, min(l_linenumber) FILTER (l_discount = m) AS best_hops
FROM (SELECT *, max(l_discount) OVER (PARTITION BY l_suppkey % 25, l_partkey) AS m FROM lineitem) GROUP BY 1, 2""",
)
def best_path_per_target(spark, sf_dir):
    """Strongest path of each target, fewer hops first among equals."""
    li = src.table(spark, sf_dir, "lineitem")
    best = F.max(F.struct("l_discount", -F.col("l_linenumber"))).alias("m")
    g = li.groupBy((F.col("l_suppkey") % 25).alias("company_id"), F.col("l_partkey").alias("target")).agg(F.count("*").alias("paths"), best)
    return g.select("company_id", "target", "paths", F.col("m.l_discount").alias("best_strength"), (-F.col("m.col2")).alias("best_hops"))


@query(
    "coverage_totals",
    f"""{_P}, c AS (SELECT company_id, industry, count(*) AS n FROM persons JOIN companies USING (company_id) GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS enriched, count(*) FILTER (n >= 60) AS at_target, round(avg(n), 4) AS mean FROM c""",
)
def coverage_totals(spark, sf_dir):
    """Totals over all companies."""
    c = people(spark, sf_dir).groupBy("company_id", "industry").agg(F.count("*").alias("n"))
    return c.agg(F.sum("n").alias("enriched"), F.count_if(F.col("n") >= 60).alias("at_target"), F.round(F.avg("n"), 4).alias("mean"))


@query(
    "tier_buckets",
    f"""{_P} SELECT CASE WHEN industry IN ('ASIA', 'EUROPE') THEN lower(industry) ELSE 'other' END AS tier, count(DISTINCT company_id) AS companies, count(*) AS enriched,
round(least(1.0, count(*) / (60.0 * count(DISTINCT company_id))) * 100) AS percent FROM persons JOIN companies USING (company_id) GROUP BY 1""",
)
def tier_buckets(spark, sf_dir):
    """Coverage by tier, clamped percentage."""
    tier = F.when(F.col("industry").isin("ASIA", "EUROPE"), F.lower("industry")).otherwise("other").alias("tier")
    g = people(spark, sf_dir).groupBy(tier).agg(F.count_distinct("company_id").alias("companies"), F.count("*").alias("enriched"))
    return g.withColumn("percent", F.round(F.least(F.lit(1.0), F.col("enriched") / (60.0 * F.col("companies"))) * 100))


@query(
    "confidence_distribution",
    """SELECT l_returnflag AS method, min(l_discount) AS lo, max(l_discount) AS hi, round(avg(l_discount), 9) AS mean, count(*) FILTER (l_discount >= 0.05) AS high FROM lineitem GROUP BY 1""",
)
def confidence_distribution(spark, sf_dir):
    """Distribution of confidence by method."""
    return src.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(
        F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"), F.round(F.avg("l_discount"), 9).alias("mean"), F.count_if(F.col("l_discount") >= 0.05).alias("high")
    )


@query("distinct_counts", "SELECT count(DISTINCT l_suppkey) AS managers, count(DISTINCT l_partkey) AS companies, count(DISTINCT l_orderkey) AS works FROM lineitem")
def distinct_counts(spark, sf_dir):
    """Several distinct counts at once."""
    return src.table(spark, sf_dir, "lineitem").agg(
        F.count_distinct("l_suppkey").alias("managers"), F.count_distinct("l_partkey").alias("companies"), F.count_distinct("l_orderkey").alias("works")
    )


@query(
    "span_quantiles",
    """WITH s AS (SELECT l_suppkey, count(DISTINCT l_orderkey) AS span FROM lineitem GROUP BY 1), r AS (SELECT span, row_number() OVER (ORDER BY span) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT max(span) FILTER (i = n // 2) AS median, max(span) FILTER (i = greatest(0, floor(0.95 * n)::BIGINT - 1)) AS p95 FROM r""",
)
def span_quantiles(spark, sf_dir):
    """Median and lower-index p95 of spans, from the counts of each span (one row for each distinct span)."""
    s = src.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("span")).groupBy("span").agg(F.count("*").alias("c"))
    run = F.sum("c").over(W.orderBy("span"))
    r = s.withColumns({"upto": run, "n": F.sum("c").over(W.partitionBy(F.lit(1)))})
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("span")))
    n = F.col("n")
    return r.agg(at(F.floor(n / 2)).alias("median"), at(F.greatest(F.lit(0), F.floor(n * 0.95) - 1)).alias("p95"))


@query("vendor_cost_ledger", f"{src.with_ctes('cost_log')} SELECT vendor, floor(sum(cost_cents) * 0.0137 + 0.999)::BIGINT AS cost FROM cost_log GROUP BY 1")
def vendor_cost_ledger(spark, sf_dir):
    """Rounded-up cost of each vendor (up from .001 on)."""
    return src.cost_log(spark, sf_dir).groupBy("vendor").agg(F.floor(F.sum("cost_cents") * 0.0137 + 0.999).alias("cost"))


@query(
    "suggestion_vocabulary",
    """WITH t AS (SELECT lower(w) AS token FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) WHERE length(w) BETWEEN 2 AND 40)
SELECT token, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, token LIMIT 200""",
)
def suggestion_vocabulary(spark, sf_dir):
    """Most common tokens (top 200)."""
    words = F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w")
    t = src.table(spark, sf_dir, "part").select(words).filter(F.length("w").between(2, 40)).groupBy(F.lower("w").alias("token")).agg(F.count("*").alias("n"))
    return t.orderBy(F.desc("n"), "token").limit(200)


@query("enriched_per_company", f"{src.with_ctes('employment')} SELECT company_id, count(DISTINCT person_id) AS n FROM employment WHERE is_current GROUP BY 1")
def enriched_per_company(spark, sf_dir):
    """Distinct current persons of each company."""
    return src.employment(spark, sf_dir).filter("is_current").groupBy("company_id").agg(F.count_distinct("person_id").alias("n"))


@query("facet_share", "SELECT o_orderpriority AS facet, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM orders GROUP BY 1")
def facet_share(spark, sf_dir):
    """Counts by kind and their share (a window over one row for each kind)."""
    n = src.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("facet")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 6))


@query("top_decile", f"{_P}, r AS (SELECT company_id, person_id, seniority, row_number() OVER (PARTITION BY company_id ORDER BY seniority DESC, person_id) AS rn, count(*) OVER (PARTITION BY company_id) AS n FROM persons) SELECT company_id, person_id, seniority FROM r WHERE rn <= greatest(1, ceil(n * 10 / 100.0))")
def top_decile(spark, sf_dir):
    """The top tenth of each company, at least one."""
    by = W.partitionBy("company_id")
    r = src.persons(spark, sf_dir).withColumns({"rn": F.row_number().over(by.orderBy(F.desc("seniority"), "person_id")), "n": F.count("*").over(by)})
    return r.filter(F.col("rn") <= F.greatest(F.lit(1), F.ceil(F.col("n") * 10 / 100.0))).select("company_id", "person_id", "seniority")


@query(
    "two_stage_top",
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_suppkey AS manager, l_discount AS confidence FROM lineitem), s AS (SELECT manager, count(*) AS span FROM e GROUP BY 1),
c AS (SELECT * FROM e ORDER BY confidence, manager, l_orderkey, l_linenumber LIMIT 80)
SELECT l_orderkey, l_linenumber, c.manager, round((1 - confidence) * (1 + ln(1 + span)), 9) AS uncertainty FROM c JOIN s ON c.manager = s.manager ORDER BY uncertainty DESC, c.manager, l_orderkey, l_linenumber LIMIT 20""",
)
def two_stage_top(spark, sf_dir):
    """The least sure 80 edges, then the 20 with the widest reach."""
    e = src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("manager"), F.col("l_discount").alias("confidence"))
    s = e.groupBy("manager").agg(F.count("*").alias("span"))
    c = e.orderBy("confidence", "manager", "l_orderkey", "l_linenumber").limit(80)
    u = F.round((1 - F.col("confidence")) * (1 + F.log1p("span")), 9).alias("uncertainty")
    return c.join(s, "manager").select("l_orderkey", "l_linenumber", "manager", u).orderBy(F.desc("uncertainty"), "manager", "l_orderkey", "l_linenumber").limit(20)


@query("top_signals", f"{src.with_ctes('signals')} SELECT prospect_id, id, confidence FROM signals QUALIFY row_number() OVER (PARTITION BY prospect_id ORDER BY confidence DESC, collected_at DESC, id) <= 12")
def top_signals(spark, sf_dir):
    """Twelve best signals of each prospect."""
    by = W.partitionBy("prospect_id").orderBy(F.desc("confidence"), F.desc("collected_at"), "id")
    return src.signals(spark, sf_dir).withColumn("r", F.row_number().over(by)).filter("r <= 12").select("prospect_id", "id", "confidence")


@query("pending_companies", f"{src.with_ctes('employment')}, n AS (SELECT company_id, count(*) AS n FROM employment GROUP BY 1) SELECT p_partkey, p_name, n FROM part JOIN n ON company_id = p_partkey ORDER BY n DESC, p_partkey LIMIT 100")
def pending_companies(spark, sf_dir):
    """Companies by headcount (top 100)."""
    n = src.employment(spark, sf_dir).groupBy(F.col("company_id").alias("p_partkey")).agg(F.count("*").alias("n"))
    return src.table(spark, sf_dir, "part").join(n, "p_partkey").select("p_partkey", "p_name", "n").orderBy(F.desc("n"), "p_partkey").limit(100)


@query("version_history", "SELECT o_custkey, o_orderkey, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) QUALIFY row_number() OVER w <= 3")
def version_history(spark, sf_dir):
    """Newest three versions of each account."""
    by = W.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return src.table(spark, sf_dir, "orders").withColumn("version", F.row_number().over(by)).filter("version <= 3").select("o_custkey", "o_orderkey", "version")


@query("seniority_order", f"{_P} SELECT company_id, person_id, row_number() OVER (PARTITION BY company_id ORDER BY CASE WHEN is_ic_track THEN NULL ELSE seniority END DESC NULLS LAST, domain, name, person_id) AS place FROM persons")
def seniority_order(spark, sf_dir):
    """Order within a company, unknown seniority last."""
    s = F.when(~F.col("is_ic_track"), F.col("seniority"))
    by = W.partitionBy("company_id").orderBy(s.desc_nulls_last(), "domain", "name", "person_id")
    return src.persons(spark, sf_dir).select("company_id", "person_id", F.row_number().over(by).alias("place"))
