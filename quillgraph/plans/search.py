"""Search, filter and set-operation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.pairs import blocked_join
from quillgraph.sources import adapters as src

from .aggregates import people
from .registry import query

_P = src.with_ctes("persons", "companies")
_J = "SELECT p.*, company, industry FROM persons p JOIN companies USING (company_id)"


def filter_prospects(
    df: DataFrame, company: str | None = None, role: str | None = None, industry: str | None = None, min_score: float | None = None,
    name_contains: str | None = None, limit: int | None = None,
) -> DataFrame:
    """AND of the given filters (case-insensitive contains), best score first."""
    for column, text in (("company", company), ("domain", role), ("industry", industry), ("name", name_contains)):
        if text is not None:
            df = df.filter(F.col(column).ilike(f"%{text}%"))
    if min_score is not None:
        df = df.filter(F.col("score") >= min_score)
    out = df.orderBy(F.desc_nulls_last("score"), "name")
    return out.limit(limit) if limit is not None else out


@query("filter_prospects", f"{_P} SELECT person_id, name, company, score FROM ({_J}) WHERE company ILIKE '%nation_1%' AND domain ILIKE '%ma%' AND score >= 1000 ORDER BY score DESC NULLS LAST, name LIMIT 25")
def filter_query(spark, sf_dir):
    """Filtered and ranked prospects."""
    return filter_prospects(people(spark, sf_dir), company="nation_1", role="ma", min_score=1000, limit=25).select("person_id", "name", "company", "score")


@query(
    "array_predicates",
    """WITH e AS (SELECT l_suppkey, list(DISTINCT p_brand) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_suppkey, len(brands)::INTEGER AS n FROM e WHERE len(list_filter(brands, lambda x: x ILIKE '%#1%')) > 0 AND len(brands) >= 2""",
)
def array_predicates(spark, sf_dir):
    """Some element matches, and the array is long enough."""
    li, p = src.table(spark, sf_dir, "lineitem"), src.table(spark, sf_dir, "part")
    e = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey").agg(F.collect_set("p_brand").alias("brands"))
    return e.filter(F.exists("brands", lambda x: x.ilike("%#1%")) & (F.size("brands") >= 2)).select("l_suppkey", F.size("brands").alias("n"))


@query("json_guards", "SELECT event_id, json_extract(props, '$.k')::INTEGER AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL AND json_extract(props, '$.k')::INTEGER % 2 = 0")
def json_guards(spark, sf_dir):
    """P5: typed JSON with a guard."""
    k = F.from_json("props", "k int")["k"]
    return src.table(spark, sf_dir, "events").select("event_id", k.alias("k")).filter("k IS NOT NULL AND k % 2 = 0")


@query("membership_filters", f"{_P} SELECT person_id FROM persons WHERE person_id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND person_id NOT IN (SELECT s_suppkey FROM supplier)")
def membership_filters(spark, sf_dir):
    """Semi-join with one set and anti-join with another."""
    o = src.table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("person_id"))
    s = src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"))
    return src.persons(spark, sf_dir).join(o, "person_id", "left_semi").join(s, "person_id", "left_anti").select("person_id")


@query("prefix_filter", "SELECT p_partkey FROM part WHERE p_type LIKE 'S%' OR starts_with(p_brand, 'Brand#1')")
def prefix_filter(spark, sf_dir):
    """Prefix tests."""
    return src.table(spark, sf_dir, "part").filter(F.col("p_type").startswith("S") | F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query("freshness", "SELECT prospect_id, n FROM (SELECT user_id AS prospect_id, count(*) AS n, max(ts) AS last_at FROM events GROUP BY 1) WHERE last_at < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 2 HOUR")
def freshness(spark, sf_dir):
    """Prospects not refreshed for some time before a stated moment."""
    e = src.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("prospect_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last_at"))
    return e.filter(F.col("last_at") < F.expr("cast('2024-01-31 12:00:00' AS timestamp) - INTERVAL 2 HOURS")).select("prospect_id", "n")


@query("people_page", f"{_P} SELECT person_id, name, domain FROM ({_J}) WHERE (name ILIKE '%00001%' OR company ILIKE '%an%') AND domain IN ('BUILDING', 'MACHINERY') AND seniority >= 60 ORDER BY seniority DESC, person_id LIMIT 100")
def people_page(spark, sf_dir):
    """Page filter with several facets (sorts: ``page_orders``)."""
    j = people(spark, sf_dir).filter((F.col("name").ilike("%00001%") | F.col("company").ilike("%an%")) & F.col("domain").isin("BUILDING", "MACHINERY") & (F.col("seniority") >= 60))
    return j.orderBy(F.desc("seniority"), "person_id").limit(100).select("person_id", "name", "domain")


@query("keyword_predicate", "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_type), 'widget') OR contains(lower(p_name || ' ' || p_type), 'promo') OR contains(lower(p_name || ' ' || p_type), '1')")
def keyword_predicate(spark, sf_dir):
    """Any keyword within the text."""
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    words = F.array(*[F.lit(w) for w in ("widget", "promo", "1")])
    return src.table(spark, sf_dir, "part").filter(F.exists(words, lambda w: F.contains(text, w))).select("p_partkey")


@query("company_handle", f"{_P} SELECT company_id, company FROM companies WHERE company ILIKE '%united%' OR company ILIKE '%nation_1%' ORDER BY lower(company) = 'nation_1' DESC, company, company_id LIMIT 1")
def company_handle(spark, sf_dir):
    """A company by its handle, the exact name first."""
    c = src.companies(spark, sf_dir)
    hit = c.filter(F.col("company").ilike("%united%") | F.col("company").ilike("%nation_1%"))
    return hit.orderBy((F.lower("company") == "nation_1").desc(), "company", "company_id").limit(1).select("company_id", "company")


@query("anti_join_gaps", f"{_P} SELECT person_id FROM persons WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = person_id AND o_orderpriority = '1-URGENT')")
def anti_join_gaps(spark, sf_dir):
    """Persons without a certain record."""
    o = src.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("person_id"))
    return src.persons(spark, sf_dir).join(o, "person_id", "left_anti").select("person_id")


@query("evidence_lookup", "WITH c AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, ids[1] AS first_id, p_name FROM c LEFT JOIN part ON p_partkey = ids[1]")
def evidence_lookup(spark, sf_dir):
    """The record behind the first id of an array."""
    li, p = src.table(spark, sf_dir, "lineitem"), src.table(spark, sf_dir, "part")
    c = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    first = c.select("l_orderkey", F.try_element_at("ids", F.lit(1)).alias("first_id"))
    return first.join(p.select(F.col("p_partkey").alias("first_id"), "p_name"), "first_id", "left").select("l_orderkey", "first_id", "p_name")


@query("two_pass_linking", f"""{_P} SELECT p.person_id, coalesce(s1.s_suppkey, s2.sid) AS linked FROM persons p LEFT JOIN supplier s1 ON s1.s_suppkey = p.person_id
LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS sid FROM supplier GROUP BY 1) s2 ON s1.s_suppkey IS NULL AND s2.s_nationkey = p.company_id""")
def two_pass_linking(spark, sf_dir):
    """Link by the sure key first, by the weaker one otherwise."""
    p, s = src.persons(spark, sf_dir), src.table(spark, sf_dir, "supplier")
    weak = s.groupBy(F.col("s_nationkey").alias("company_id")).agg(F.min("s_suppkey").alias("weak"))
    strong = s.select(F.col("s_suppkey").alias("person_id"), F.col("s_suppkey").alias("strong"))
    return p.join(strong, "person_id", "left").join(weak, "company_id", "left").select("person_id", F.coalesce("strong", "weak").alias("linked"))


@query("cohort_cross_reference", f"{_P} SELECT a.person_id AS a, b.s_suppkey AS b FROM persons a JOIN supplier b ON a.company_id = b.s_nationkey AND a.team = b.s_suppkey % 3")
def cohort_cross_reference(spark, sf_dir):
    """Equi-join on two keys of a lookup."""
    p, s = src.persons(spark, sf_dir), src.table(spark, sf_dir, "supplier")
    key = ["company_id", "team"]
    lookup = s.select(F.col("s_nationkey").alias("company_id"), (F.col("s_suppkey") % 3).cast("int").alias("team"), F.col("s_suppkey").alias("b"))
    return blocked_join(p.select(*key, F.col("person_id").alias("a")), lookup, key).select("a", "b")


@query("executive_match", f"""{_P} SELECT s_suppkey, min(person_id) AS person_id FROM supplier JOIN persons ON company_id = s_nationkey AND contains(s_name, right(name, 2)) GROUP BY 1""")
def executive_match(spark, sf_dir):
    """Names matched within a company, smallest id."""
    p, s = src.persons(spark, sf_dir), src.table(spark, sf_dir, "supplier")
    # names that end alike match alike, so the smallest person of each end stands for all
    ends = p.groupBy("company_id", F.right("name", F.lit(2)).alias("end")).agg(F.min("person_id").alias("person_id"))
    j = s.join(ends, (ends.company_id == s.s_nationkey) & F.contains(s.s_name, ends.end))
    return j.groupBy("s_suppkey").agg(F.min("person_id").alias("person_id"))


@query("current_members", f"{src.with_ctes('persons', 'employment')} SELECT p.person_id, count(e.company_id) AS stints FROM persons p LEFT JOIN employment e ON e.person_id = p.person_id AND e.is_current GROUP BY 1")
def current_members(spark, sf_dir):
    """Persons with their current stints, none included."""
    e = src.employment(spark, sf_dir).filter("is_current").select("person_id", F.col("company_id").alias("stint"))
    return src.persons(spark, sf_dir).select("person_id").join(e, "person_id", "left").groupBy("person_id").agg(F.count("stint").alias("stints"))


@query("focus_facets", f"""{_P} SELECT * FROM (SELECT 'company' AS kind, company AS label, count(*) AS n FROM ({_J}) GROUP BY 2 UNION ALL SELECT 'industry', industry, count(*) FROM ({_J}) GROUP BY 2
UNION ALL SELECT 'role', domain, count(*) FROM ({_J}) GROUP BY 2) ORDER BY label, kind LIMIT 50""")
def focus_facets(spark, sf_dir):
    """U-1: facets of several kinds in one list."""
    legs = [people(spark, sf_dir).groupBy(F.col(c).alias("label")).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "label", "n") for k, c in (("company", "company"), ("industry", "industry"), ("role", "domain"))]
    return legs[0].unionByName(legs[1]).unionByName(legs[2]).orderBy("label", "kind").limit(50)


@query("neighbor_kinds", f"""{_P} SELECT * FROM (SELECT p.person_id AS id, 'colleague' AS kind FROM persons p WHERE company_id = 3 UNION SELECT person_id, 'same_role' FROM persons WHERE domain = 'BUILDING' AND team = 1
UNION SELECT s_suppkey, 'supplier' FROM supplier WHERE s_nationkey = 3) ORDER BY id, kind LIMIT 60""")
def neighbor_kinds(spark, sf_dir):
    """U-2, G3, U-4: distinct union of neighbours of several kinds."""
    p, s = src.persons(spark, sf_dir), src.table(spark, sf_dir, "supplier")
    one = p.filter("company_id = 3").select(F.col("person_id").alias("id"), F.lit("colleague").alias("kind"))
    two = p.filter("domain = 'BUILDING' AND team = 1").select(F.col("person_id").alias("id"), F.lit("same_role").alias("kind"))
    three = s.filter("s_nationkey = 3").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("kind"))
    return one.union(two).union(three).distinct().orderBy("id", "kind").limit(60)


@query("ordered_legs", """SELECT o_orderkey, o_totalprice FROM (SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)
UNION SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 40)) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def ordered_legs(spark, sf_dir):
    """U-3: limited legs, deduplicated, sorted and capped again."""
    o = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    leg = lambda c: o.filter(c).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(40)
    return leg("o_orderstatus = 'F'").union(leg("o_orderpriority = '1-URGENT'")).dropDuplicates().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("array_union_sets", "SELECT o_custkey, string_agg(DISTINCT x, ',' ORDER BY x) AS merged FROM (SELECT o_custkey, o_orderpriority AS x FROM orders UNION ALL SELECT o_custkey, o_orderstatus FROM orders) GROUP BY 1")
def array_union_sets(spark, sf_dir):
    """U-5: union of two sets of each key."""
    g = src.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set("o_orderstatus").alias("b"))
    return g.select("o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("merged"))


@query("suggestion_rank", "SELECT p_name, min(CASE WHEN starts_with(lower(p_name), 'ring') THEN 0 ELSE 10 + instr(lower(p_name), 'ring') - 1 END + 0.01 * length(p_name))::DOUBLE AS rank FROM part WHERE contains(lower(p_name), 'ring') GROUP BY 1 ORDER BY rank, p_name LIMIT 8")
def suggestion_rank(spark, sf_dir):
    """Prefix hits first, then by place and length (top 8)."""
    name = F.lower("p_name")
    rank = F.when(name.startswith("ring"), 0).otherwise(10 + F.instr(name, "ring") - 1) + 0.01 * F.length("p_name")
    return src.table(spark, sf_dir, "part").filter(name.contains("ring")).groupBy("p_name").agg(F.min(rank).alias("rank")).orderBy("rank", "p_name").limit(8)


@query("focus_first", f"{_P} SELECT person_id, (domain = 'BUILDING')::INTEGER AS hit, coalesce(score, -1) AS score FROM persons ORDER BY hit DESC, score DESC, person_id LIMIT 100")
def focus_first(spark, sf_dir):
    """Matches first, then the rest, by score."""
    p = src.persons(spark, sf_dir).select("person_id", (F.col("domain") == "BUILDING").cast("int").alias("hit"), F.coalesce("score", F.lit(-1.0)).alias("score"))
    return p.orderBy(F.desc("hit"), F.desc("score"), "person_id").limit(100)


@query("lead_match", f"""{_P} SELECT person_id, round(0.6 * least(1.0, pts / 10.0) * 100 + 0.4 * greatest(0, least(100, score / 100)), 6) AS blend FROM (
 SELECT person_id, score, 4 * (name ILIKE '%7%')::INTEGER + 3 * (domain = 'MACHINERY')::INTEGER + 2 * (company ILIKE '%a%')::INTEGER + (industry = 'ASIA')::INTEGER AS pts FROM ({_J})) WHERE pts >= 2 ORDER BY blend DESC, person_id LIMIT 10""")
def lead_match(spark, sf_dir):
    """Lead ranking by matching points and score (top 10)."""
    i = lambda c: c.cast("int")
    pts = 4 * i(F.col("name").ilike("%7%")) + 3 * i(F.col("domain") == "MACHINERY") + 2 * i(F.col("company").ilike("%a%")) + i(F.col("industry") == "ASIA")
    blend = F.round(0.6 * F.least(F.lit(1.0), F.col("pts") / 10.0) * 100 + 0.4 * F.greatest(F.lit(0), F.least(F.lit(100), F.col("score") / 100)), 6)
    return people(spark, sf_dir).withColumn("pts", pts).filter("pts >= 2").select("person_id", blend.alias("blend")).orderBy(F.desc("blend"), "person_id").limit(10)
