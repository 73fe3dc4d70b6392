"""The chain from prospects to companies, persons and stints, and vendor records in shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators.backfill import Backfill
from quillgraph.sources import adapters as src
from quillgraph.sources import shapes

from .registry import query

_ROLES = {"BUILDING": ("Senior Manager, Software", 52, "software_engineering"), "FURNITURE": ("VP Sales", 70, "sales_marketing"), "MACHINERY": ("Florist", None, None), "AUTOMOBILE": ("Staff Engineer", 45, None)}
_CASE = lambda i: "CASE title " + " ".join(f"WHEN '{k}' THEN " + ("NULL" if v[i] is None else f"'{v[i]}'" if isinstance(v[i], str) else str(v[i])) for k, v in _ROLES.items()) + " END"
_CHAIN = f"""{src.with_ctes('first_words', 'person_records').replace('WITH', 'WITH RECURSIVE', 1)},
p AS MATERIALIZED (SELECT id, first || ' ' || last AS raw, trim(lower(first || ' ' || last)) AS name, company AS firm, lower(company) AS company, {_CASE(0)} AS role, {_CASE(1)} AS seniority, {_CASE(2)} AS domain, url FROM person_records),
career AS MATERIALIZED (SELECT o_custkey AS id, 'Firm ' || (o_orderkey % 5) || ' Inc' AS firm, CASE o_orderstatus WHEN 'F' THEN 'Analyst' WHEN 'P' THEN 'Lead' END AS title, (['', '1993', '1990-1995', '2001 to 1999'])[o_orderkey % 4 + 1] AS years FROM orders WHERE o_orderkey % 3 = 0),
roles AS MATERIALIZED (SELECT id, firm, replace(lower(firm), ' inc', '') AS company, title, CASE years WHEN '1993' THEN 1993 WHEN '1990-1995' THEN 1990 WHEN '2001 to 1999' THEN 2001 END AS s, CASE years WHEN '1990-1995' THEN 1995 END AS e FROM career
 UNION ALL SELECT id, f, lower(f), NULL, NULL, NULL FROM (SELECT id, unnest(['Old Co', 'Company ' || (id % 7), '']) AS f FROM p WHERE id NOT IN (SELECT id FROM career)) WHERE f <> ''),
same AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM p x JOIN p y ON x.url = y.url UNION SELECT x.id, y.id FROM p x JOIN p y ON x.name = y.name AND x.company = y.company),
reach AS (SELECT id, id AS r FROM p UNION SELECT reach.id, b FROM reach JOIN same ON a = r),
who AS MATERIALIZED (SELECT p.*, person_id FROM p JOIN (SELECT id, min(r) AS person_id FROM reach GROUP BY id) USING (id))"""


def chain(spark, sf_dir) -> Backfill:
    """The chain over prospects and careers, twin of ``_CHAIN``."""
    r = src.person_records(spark, sf_dir)
    role = F.lit(None).cast("string")
    for segment, (text, _, _) in _ROLES.items():
        role = F.when(F.col("title") == segment, text).otherwise(role)
    past = F.array(F.lit("Old Co"), F.concat(F.lit("Company "), (F.col("id") % 7).cast("string")), F.lit(""))
    prospects = r.select("id", F.concat_ws(" ", "first", "last").alias("name"), "company", role.alias("role"), "url", past.alias("past"))
    o, k = src.table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0"), F.col("o_orderkey")
    title = F.when(F.col("o_orderstatus") == "F", "Analyst").when(F.col("o_orderstatus") == "P", "Lead")
    years = F.element_at(F.array(*map(F.lit, ("", "1993", "1990-1995", "2001 to 1999"))), (k % 4 + 1).cast("int"))
    careers = o.select(F.col("o_custkey").alias("id"), F.concat(F.lit("Firm "), (k % 5).cast("string"), F.lit(" Inc")).alias("company"), title.alias("title"), years.alias("years"))
    return Backfill(prospects, careers)


@query("backfilled_companies", f"""{_CHAIN}, named AS (SELECT id, firm, company FROM p WHERE company IS NOT NULL UNION ALL SELECT id, firm, company FROM roles)
SELECT company, arg_min(firm, (id, firm)) FILTER (firm <> company) AS variant FROM named GROUP BY 1""")
def backfilled_companies(spark, sf_dir):
    """Companies of present and past employers, each once by its key, with a spelling."""
    return chain(spark, sf_dir).companies()


@query("backfilled_persons", f"""{_CHAIN}, one AS (SELECT person_id, arg_min(url, id) FILTER (url <> '') AS url, arg_min((role, seniority, domain), id) FILTER (role <> '') AS t FROM who GROUP BY 1)
SELECT person_id, person_id AS source_id, w.name, CASE WHEN raw <> w.name THEN raw END AS variant, one.url, company, t[1] AS title, t[2] AS seniority, t[3] AS domain FROM one JOIN (SELECT * FROM who WHERE id = person_id) w USING (person_id)""")
def backfilled_persons(spark, sf_dir):
    """Persons by address or by name and company, classified by the earlier rules."""
    return chain(spark, sf_dir).persons()


@query("backfilled_stints", f"""{_CHAIN}, past AS (SELECT person_id, r.company, title, s, e, r.id FROM roles r JOIN who w USING (id) WHERE w.company IS NULL OR w.company <> r.company),
folded AS (SELECT person_id, company, coalesce(title, min(title) OVER (PARTITION BY person_id, company)) AS title, s, e, id FROM past)
SELECT person_id, company, arg_min(coalesce(role, ''), id) AS title, true AS is_current, NULL::INTEGER AS start_year, NULL::INTEGER AS end_year FROM who WHERE company IS NOT NULL GROUP BY 1, 2
UNION ALL SELECT person_id, company, coalesce(title, ''), false, arg_min(s, (id, s)) FILTER (s IS NOT NULL), arg_min(e, (id, e)) FILTER (e IS NOT NULL) FROM folded GROUP BY 1, 2, 3""")
def backfilled_stints(spark, sf_dir):
    """Present and past stints; a stint without a title folds into a titled one of the same company."""
    return chain(spark, sf_dir).stints().fillna("", ["title"])


@query("paper_records", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'On ' || o_orderpriority END AS paper_title, '' AS venue, CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate) ELSE 0 END::INTEGER AS year, (o_orderkey % 40)::INTEGER AS citation_count,
 o_orderkey::VARCHAR AS semantic_scholar_id, '10.1/' || o_custkey AS doi, 3 AS author_count FROM orders""")
def paper_records(spark, sf_dir):
    """Papers out of their vendor's records."""
    o, k = src.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    year = F.year("o_orderdate").cast("string")
    title = F.when(F.col("o_orderstatus") == "P", "7").otherwise(F.concat(F.lit('"On '), "o_orderpriority", F.lit('"')))
    said = F.when(k % 3 == 0, F.concat(F.lit('"'), year, F.lit('"'))).when(k % 3 == 1, year).otherwise('"soon"')
    text = F.concat(
        F.lit('{"paperId": "'), k.cast("string"), F.lit('", "title": '), title, F.lit(', "year": '), said, F.lit(', "citationCount": '), (k % 40).cast("string"), F.lit(', "externalIds": {"doi": "10.1/'), F.col("o_custkey").cast("string"), F.lit('"}, "authors": [{}, {}, 3]}'),
    )
    return shapes.papers(o.select(k.alias("id"), text.alias("payload")))


@query("appended_signals", """SELECT s_nationkey AS company_id, 'executive_profile' AS signal_type, 'firecrawl_leadership' AS source, '{"name":"' || s_name || '","title":"Dyer","page_url":"https://c' || s_nationkey || '"}' AS value, 0.85::DOUBLE AS confidence FROM supplier
UNION ALL SELECT s_nationkey, 'press_release', 'firecrawl_press', '{"headline":"News of ' || s_suppkey || '","mentioned_executives":["' || s_name || '"],"page_url":"https://c' || s_nationkey || '"}', 0.90 FROM supplier WHERE s_acctbal > 0""")
def appended_signals(spark, sf_dir):
    """Company signals to append, one for each executive and press release of a company's pages."""
    s = src.table(spark, sf_dir, "supplier")
    news = F.when(F.col("s_acctbal") > 0, F.struct(F.concat(F.lit("News of "), F.col("s_suppkey").cast("string")).alias("headline"), F.array("s_name").alias("mentioned_executives")))
    pages = s.groupBy(F.col("s_nationkey").alias("company_id")).agg(F.collect_list(F.struct(F.col("s_name").alias("name"), F.lit("Dyer").alias("title"))).alias("executives"), F.collect_list(news).alias("press_releases"))
    pages = pages.withColumn("page_url", F.concat(F.lit("https://c"), F.col("company_id").cast("string")))
    return shapes.company_signals(pages, F.lit("2026-01-01").cast("timestamp")).drop("fetched_at")
