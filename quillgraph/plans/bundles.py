"""Bundled company views, rule checks and mentions in text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.sources import adapters as src

from .registry import query


@query(
    "company_bundle",
    f"""{src.with_ctes('persons', 'companies')}, p AS (SELECT company_id, count(*) AS people, count(*) FILTER (seniority >= 85) AS executives, max(score) AS best FROM persons GROUP BY 1),
o AS (SELECT c_nationkey AS company_id, count(*) AS orders, round(sum(o_totalprice), 2) AS spend FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
s AS (SELECT s_nationkey AS company_id, count(*) AS suppliers FROM supplier GROUP BY 1)
SELECT company_id, company, coalesce(people, 0) AS people, coalesce(executives, 0) AS executives, best, coalesce(orders, 0) AS orders, coalesce(spend, 0) AS spend, coalesce(suppliers, 0) AS suppliers
FROM companies LEFT JOIN p USING (company_id) LEFT JOIN o USING (company_id) LEFT JOIN s USING (company_id)""",
)
def company_bundle(spark, sf_dir):
    """One row of figures for each company; every part is aggregated before it is joined."""
    p = src.persons(spark, sf_dir).groupBy("company_id").agg(
        F.count("*").alias("people"), F.count_if(F.col("seniority") >= 85).alias("executives"), F.max("score").alias("best")
    )
    o, c, s = (src.table(spark, sf_dir, t) for t in ("orders", "customer", "supplier"))
    orders = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("company_id")).agg(
        F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spend")
    )
    suppliers = s.groupBy(F.col("s_nationkey").alias("company_id")).agg(F.count("*").alias("suppliers"))
    out = src.companies(spark, sf_dir).select("company_id", "company").join(p, "company_id", "left").join(orders, "company_id", "left").join(suppliers, "company_id", "left")
    return out.fillna(0, ["people", "executives", "orders", "spend", "suppliers"])


#: Rules that rows must keep: table, name, SQL condition of a violation.
RULES = [
    ("lineitem", "discount_in_range", "l_discount < 0 OR l_discount > 1"),
    ("lineitem", "known_flag", "l_returnflag NOT IN ('A', 'N', 'R')"),
    ("orders", "price_not_negative", "o_totalprice < 0"),
    ("customer", "has_name", "c_name IS NULL OR c_name = ''"),
    ("events", "known_kind", "event_type NOT IN ('signup', 'error', 'click', 'view', 'purchase')"),
    ("part", "size_positive", "p_size < 1"),
]


@query("rule_violations", " UNION ALL ".join(f"SELECT '{t}' AS source, '{n}' AS rule, count(*) FILTER ({c}) AS violations FROM {t}" for t, n, c in RULES))
def rule_violations(spark, sf_dir):
    """Check constraints as counts of violating rows; one scan for each table."""
    out = None
    for name in dict.fromkeys(t for t, _, _ in RULES):
        own = [(n, c) for t, n, c in RULES if t == name]
        counts = src.table(spark, sf_dir, name).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in own])
        flat = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n, _ in own])).alias("r"))
        rows = flat.select(F.lit(name).alias("source"), "r.rule", "r.violations")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Aliases looked for in texts, with word boundaries.
ALIASES = ["the", "und", "que", "les", "with", "nicht", "para", "dans"]


@query(
    "alias_mentions",
    " UNION ALL ".join(f"SELECT '{a}' AS alias, count(*) AS documents FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9]){a}([^a-z0-9]|$)')" for a in ALIASES),
)
def alias_mentions(spark, sf_dir):
    """Documents that mention each alias between non-alphanumeric characters; texts are read once."""
    text = F.lower("text")
    found = F.array(*[F.when(text.rlike(f"(^|[^a-z0-9]){a}([^a-z0-9]|$)"), a) for a in ALIASES])
    hits = src.table(spark, sf_dir, "documents").select(F.explode(F.array_compact(found)).alias("alias"))
    return hits.groupBy("alias").agg(F.count("*").alias("documents"))


@query(
    "person_mentions",
    """WITH m AS (SELECT conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{2,}')) AS name FROM conversations) SELECT name, count(*) AS mentions, count(DISTINCT conv_id) AS conversations FROM m GROUP BY 1""",
)
def person_mentions(spark, sf_dir):
    """Capitalised words as candidate names."""
    names = F.explode(F.regexp_extract_all("text", F.lit(r"[A-Z][a-z]{2,}"), F.lit(0))).alias("name")
    m = src.table(spark, sf_dir, "conversations").select("conv_id", names)
    return m.groupBy("name").agg(F.count("*").alias("mentions"), F.count_distinct("conv_id").alias("conversations"))
