"""Bundles of people and companies, timelines, pages, and merges with a rule for each column."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import dates as fd
from quillgraph.functions import scoring as fs
from quillgraph.operators import bundles as ops
from quillgraph.operators import graphs as gops
from quillgraph.operators import hubs
from quillgraph.operators import merges as mops
from quillgraph.operators import press
from quillgraph.operators import scores as sops
from quillgraph.operators.stored import stored
from quillgraph.sources import adapters as src

from . import graphs as gq
from . import orgchart as oq
from .registry import query

#: Persons with a domain, with one that only their title tells, or with none.
_CLUSTERED = """titled AS (SELECT person_id, company_id, CASE WHEN person_id % 4 IN (0, 2) THEN domain END AS domain, CASE WHEN person_id % 4 = 1 THEN 'Research Scientist' WHEN person_id % 4 = 3 THEN 'Florist' END AS title FROM persons),
clustered AS (SELECT company_id, CASE person_id % 4 WHEN 1 THEN 'research' WHEN 3 THEN 'uncategorized' ELSE domain END AS domain, person_id, CASE person_id % 4 WHEN 1 THEN 0.70 WHEN 3 THEN 0.30 ELSE 0.95 END::DOUBLE AS confidence FROM titled)"""


def clustered(spark, sf_dir):
    """Cluster members, twin of ``_CLUSTERED``."""
    p, four = src.persons(spark, sf_dir), F.col("person_id") % 4
    titled = p.select("person_id", "company_id", F.when(four.isin(0, 2), F.col("domain")).alias("domain"), F.when(four == 1, "Research Scientist").when(four == 3, "Florist").alias("title"))
    return ops.cluster_members(titled)


@query("cluster_memberships", f"{src.with_ctes('persons')}, {_CLUSTERED} SELECT * FROM clustered")
def cluster_memberships(spark, sf_dir):
    """everyone's functional cluster, and how sure it is: by domain, by title, or by nothing."""
    return clustered(spark, sf_dir)


@query("org_profiles", f"""{oq._M.replace('WITH', 'WITH RECURSIVE', 1)}, {_CLUSTERED}, {oq._SCORED}, {oq._BEST}, {oq._WALK},
e AS (SELECT b.manager_id, b.report_id, b.confidence, w.v AS path FROM best b LEFT JOIN walk w ON w.node = b.report_id),
listed AS (SELECT report_id AS person_id, 'manager' AS part, manager_id AS other_id, confidence, coalesce(path < confidence - 1e-12, false)::INTEGER AS dotted FROM e UNION ALL SELECT manager_id, 'report', report_id, confidence, 0 FROM e
 UNION ALL SELECT x.person_id, 'peer', y.person_id, y.confidence, 0 FROM clustered x JOIN clustered y ON x.company_id = y.company_id AND x.domain = y.domain AND x.person_id <> y.person_id)
SELECT person_id, part, row_number() OVER w AS rank, other_id, confidence, dotted FROM listed WINDOW w AS (PARTITION BY person_id, part ORDER BY confidence DESC, other_id) QUALIFY part <> 'peer' OR row_number() OVER w <= 10""")
def org_profiles(spark, sf_dir):
    """Managers with dotted lines, direct reports and the surest ten peers of everyone."""
    best = stored(oq.best_managers(spark, sf_dir).select("manager_id", "report_id", "confidence"))
    path = gops.down_the_tree(best, F.col("confidence")).select(F.col("node").alias("report_id"), F.col("value").alias("path_confidence"))
    edges = best.join(path, "report_id", "left")
    return ops.org_context(edges, clustered(spark, sf_dir)).withColumn("dotted", F.col("dotted").cast("int"))


_COMPANY_DATA = f"""{src.with_ctes('first_words', 'person_records', 'persons')}, {gq._SPARSE}, {gq._TYPED},
staff AS MATERIALIZED (SELECT id AS person_id, company AS company_id, first || ' ' || last AS name, priority, url IS NOT NULL AS enriched FROM person_records WHERE company IS NOT NULL),
signals AS MATERIALIZED (SELECT company_id, event_id AS signal_id, CASE event_type WHEN 'signup' THEN 'executive_profile' WHEN 'purchase' THEN 'press_release' ELSE 'other' END AS kind, s.name, ts AS at FROM events JOIN staff s ON s.person_id = user_id)"""


@query("company_profiles", f"""{_COMPANY_DATA}, latest AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY "at" DESC, signal_id) AS r FROM signals QUALIFY r <= 50),
known AS (SELECT company_id, name FROM (SELECT DISTINCT company_id, name FROM latest WHERE kind = 'executive_profile') l WHERE EXISTS (SELECT 1 FROM staff s WHERE s.company_id = l.company_id AND s.priority = 80
  AND contains(lower(s.name), string_split(lower(trim(l.name)), ' ')[1]) AND contains(lower(s.name), string_split(lower(trim(l.name)), ' ')[-1])) AND len(string_split(trim(name), ' ')) >= 2),
top_staff AS MATERIALIZED (SELECT * FROM staff WHERE priority = 80),
ends AS (SELECT s.company_id, t.* FROM typed t JOIN top_staff s ON s.person_id = t.a UNION ALL SELECT s.company_id, t.* FROM typed t JOIN top_staff s ON s.person_id = t.b),
afar AS (SELECT e.* FROM ends e LEFT JOIN top_staff x ON x.person_id = e.a LEFT JOIN top_staff y ON y.person_id = e.b WHERE x.company_id IS NULL OR y.company_id IS NULL OR x.company_id <> y.company_id),
best AS (SELECT * FROM afar QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY strength DESC, a, b, type) = 1),
w AS (SELECT company_id, count(*) AS warm, round(round(avg(strength), 9), 2) AS warm_strength FROM afar GROUP BY 1)
SELECT c.company_id, (SELECT count(*) FROM latest l WHERE l.company_id = c.company_id AND kind = 'executive_profile') AS executives, (SELECT count(*) FROM latest l JOIN known k USING (company_id, name) WHERE l.company_id = c.company_id AND kind = 'executive_profile') AS executives_known,
 (SELECT string_agg(signal_id, ',' ORDER BY r) FROM (SELECT * FROM latest l WHERE kind = 'press_release' QUALIFY row_number() OVER (PARTITION BY company_id ORDER BY r) <= 10) l WHERE l.company_id = c.company_id) AS recent_press,
 (SELECT count(*) FROM signals s WHERE s.company_id = c.company_id AND kind = 'press_release') AS press_total, (SELECT count(*) FROM signals s WHERE s.company_id = c.company_id AND kind = 'press_release' AND "at" >= TIMESTAMP '2024-02-15' - INTERVAL 30 DAYS) AS press_recent,
 0::BIGINT AS edges, NULL::DOUBLE AS edge_confidence, (SELECT count(DISTINCT domain) FROM top_staff s JOIN persons p USING (person_id) WHERE s.company_id = c.company_id) AS clusters,
 (SELECT count(*) FROM top_staff s WHERE s.company_id = c.company_id) AS people, (SELECT count(*) FILTER (enriched) FROM top_staff s WHERE s.company_id = c.company_id) AS enriched,
 (SELECT coalesce(round(count(*) FILTER (enriched) / count(*), 2), 0) FROM top_staff s WHERE s.company_id = c.company_id) AS enriched_share, coalesce(w.warm, 0) AS warm, w.warm_strength,
 (SELECT name FROM top_staff s WHERE s.person_id = best.a) AS strongest_from, (SELECT name FROM top_staff s WHERE s.person_id = best.b) AS strongest_to,
 CASE best.type WHEN 'co_investor' THEN 'co-invested in a company' WHEN 'same_phd_advisor' THEN 'shared a PhD advisor' WHEN 'co_board_member' THEN 'served on the same board' WHEN 'patent_co_inventor' THEN 'co-invented a patent' WHEN 'academic_co_author_multi' THEN 'co-authored multiple papers'
  WHEN 'academic_co_author_single' THEN 'co-authored a paper' WHEN 'career_overlap_same_team' THEN 'worked on the same team' WHEN 'career_overlap_same_domain' THEN 'worked in the same functional domain' WHEN 'career_overlap_general' THEN 'shared career history'
  WHEN 'conference_co_presenter' THEN 'co-presented at a conference' WHEN 'standards_committee_peer' THEN 'served on a standards committee together' WHEN 'alumni_network' THEN 'shared an alma mater' WHEN 'conference_co_attendee' THEN 'co-attended a conference' END AS strongest_via,
 round(round(best.strength, 9), 2) AS strongest FROM (SELECT DISTINCT company_id FROM staff) c LEFT JOIN w USING (company_id) LEFT JOIN best USING (company_id)""")
def company_profiles(spark, sf_dir):
    """Executives, press, org chart, people and warm connections of every company."""
    staff = stored(src.person_records(spark, sf_dir).filter("company IS NOT NULL").select(
        F.col("id").alias("person_id"), F.col("company").alias("company_id"), F.concat_ws(" ", "first", "last").alias("name"), "priority", F.col("url").isNotNull().alias("enriched")
    ))
    kind = F.when(F.col("event_type") == "signup", "executive_profile").when(F.col("event_type") == "purchase", "press_release").otherwise("other")
    e = src.table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("event_id").alias("signal_id"), kind.alias("kind"), F.col("ts").alias("at"))
    signals = e.join(staff.select("person_id", "company_id", "name"), "person_id").select("company_id", "signal_id", "kind", "name", "at")
    top = staff.filter("priority = 80").drop("priority")
    domains = src.persons(spark, sf_dir).select("person_id", "domain")
    clusters = top.join(domains, "person_id").select("company_id", "domain").distinct()
    edges = spark.createDataFrame([], "manager_id long, confidence double")
    return ops.company_profiles(staff, top, signals, edges, clusters, gq.typed_edges(spark, sf_dir, top.select("person_id")), F.lit("2024-02-15").cast("timestamp"))


#: Stints with months, open ends and gaps, out of orders.
_STINTS = """stints AS (SELECT o_custkey AS person_id, o_orderkey AS id, CASE WHEN o_orderkey % 13 > 0 THEN year(o_orderdate) END AS sy, CASE WHEN o_orderkey % 3 > 0 THEN month(o_orderdate) END AS sm,
 CASE WHEN o_orderkey % 7 > 0 THEN year(o_orderdate) + o_orderkey % 5 END AS ey, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 12 + 1)::BIGINT END AS em, o_orderstatus = 'P' AS cur FROM orders)"""
_MONTHS = "(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'])"


def stints(spark, sf_dir):
    """Stints, twin of ``_STINTS``."""
    o, k = src.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    year = F.year("o_orderdate")
    return o.select(
        F.col("o_custkey").alias("person_id"), k.alias("id"), F.when(k % 13 > 0, year).alias("sy"), F.when(k % 3 > 0, F.month("o_orderdate")).alias("sm"), F.when(k % 7 > 0, year + k % 5).alias("ey"),
        F.when(k % 4 > 0, k % 12 + 1).alias("em"), (F.col("o_orderstatus") == "P").alias("cur"),
    )


_SPAN = """(coalesce({y}, 0) - sy) * 12 + coalesce({m}, 12) - coalesce(sm, 1) + 1"""
_LENGTH = """CASE WHEN NOT {x} THEN CASE WHEN greatest({n}, 0) // 12 = 0 THEN '<1 yr' WHEN greatest({n}, 0) // 12 = 1 THEN '1 yr' ELSE (greatest({n}, 0) // 12) || ' yrs' END
 WHEN greatest({n}, 0) = 0 THEN '<1 mo' ELSE concat_ws(' ', CASE WHEN {n} // 12 = 1 THEN '1 yr' WHEN {n} // 12 > 1 THEN ({n} // 12) || ' yrs' END, CASE WHEN {n} % 12 = 1 THEN '1 mo' WHEN {n} % 12 > 1 THEN ({n} % 12) || ' mos' END) END"""


@query("career_timelines", f"""WITH {_STINTS}, n AS (SELECT *, {_SPAN.format(y='2026', m='6')} AS until_now, {_SPAN.format(y='ey', m='em')} AS whole, concat_ws(' ', {_MONTHS}[sm], sy) AS began FROM stints)
SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY cur DESC, sy DESC NULLS LAST, CASE WHEN sy IS NULL THEN 0 ELSE coalesce(sm, 0) END DESC, id)::INTEGER AS place,
 CASE WHEN sy IS NULL THEN 'Date unknown' WHEN cur THEN began || ' – Present · ' || {_LENGTH.format(x='(sm IS NOT NULL)', n='until_now')} WHEN ey IS NULL THEN began || ' – ? · ongoing'
 ELSE began || ' – ' || concat_ws(' ', {_MONTHS}[em], ey) || ' · ' || {_LENGTH.format(x='(sm IS NOT NULL AND em IS NOT NULL)', n='whole')} END AS dates FROM n""")
def career_timelines(spark, sf_dir):
    """Stints in the order of a timeline, current ones first, and their dates as text."""
    month = F.when(F.col("sy").isNull(), 0).otherwise(F.coalesce("sm", F.lit(0)))
    by = W.partitionBy("person_id").orderBy(F.desc("cur"), F.desc_nulls_last("sy"), month.desc(), "id")
    dates = fd.date_range(*(F.col(c) for c in ("sy", "sm", "ey", "em", "cur")), F.lit(2026), F.lit(6))
    return stints(spark, sf_dir).select("person_id", "id", F.row_number().over(by).alias("place"), dates.alias("dates"))


@query("education_timelines", f"""WITH {_STINTS} SELECT person_id, id, row_number() OVER (PARTITION BY person_id ORDER BY sy DESC NULLS LAST, CASE WHEN sy IS NULL THEN 0 ELSE coalesce(ey, 0) END DESC, id)::INTEGER AS place,
 CASE WHEN sy IS NULL THEN 'Date unknown' WHEN ey IS NULL THEN sy || ' – ? · ongoing' ELSE sy || ' – ' || ey || ' · ' || CASE WHEN ey - sy + 1 = 1 THEN '1 yr' ELSE (ey - sy + 1) || ' yrs' END END AS dates FROM stints""")
def education_timelines(spark, sf_dir):
    """Studies by start, then end, years only."""
    end = F.when(F.col("sy").isNull(), 0).otherwise(F.coalesce("ey", F.lit(0)))
    by = W.partitionBy("person_id").orderBy(F.desc_nulls_last("sy"), end.desc(), "id")
    dates = fd.date_range(*(F.col(c) for c in ("sy", "sm", "ey", "em")), F.lit(False), F.lit(2026), F.lit(6), year_only=True)
    return stints(spark, sf_dir).select("person_id", "id", F.row_number().over(by).alias("place"), dates.alias("dates"))


@query("role_years", r"""SELECT l_orderkey, l_linenumber, CASE WHEN y[1]::INTEGER BETWEEN 1900 AND 2100 THEN y[1]::INTEGER END AS start_year, CASE WHEN y[1]::INTEGER BETWEEN 1900 AND 2100 AND y[2]::INTEGER BETWEEN y[1]::INTEGER AND 2100 THEN y[2]::INTEGER END AS end_year
FROM (SELECT l_orderkey, l_linenumber, regexp_extract_all(l_partkey || ' to ' || year(l_shipdate) || '-' || (l_suppkey + 1990), '\b(\d{4})\b', 1) AS y FROM lineitem)""")
def role_years(spark, sf_dir):
    """start and end year out of free text, numbers that are no years left out."""
    text = F.concat(F.col("l_partkey").cast("string"), F.lit(" to "), F.year("l_shipdate").cast("string"), F.lit("-"), (F.col("l_suppkey") + 1990).cast("string"))
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fd.role_years(text).alias("y")).select("l_orderkey", "l_linenumber", F.col("y.start").alias("start_year"), F.col("y.end").alias("end_year"))


#: A table of people and incoming rows with spellings, tiers and gaps.
_PEOPLE = """was AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name, [c_name, c_mktsegment] AS variants, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS title, (c_custkey % 4)::INTEGER AS tier, DATE '2020-01-01' AS updated_at FROM customer WHERE c_nationkey < 20),
came AS (SELECT o_custkey AS id, 'order ' || min(o_orderkey) AS name, list_sort(list(DISTINCT o_orderpriority)) AS variants, CASE WHEN o_custkey % 2 > 0 THEN min(o_orderstatus) END AS title, CASE WHEN count(*) > 10 THEN 3 ELSE 1 END AS tier FROM orders GROUP BY 1)"""


@query("person_upsert", f"""WITH {_PEOPLE} SELECT id, coalesce(w.name, c.name) AS name, array_to_string(list_sort(list_distinct(list_concat(coalesce(w.variants, []), coalesce(c.variants, [])))), '|') AS variants, coalesce(c.title, w.title) AS title, greatest(w.tier, c.tier) AS tier,
 CASE WHEN c.id IS NULL THEN '2020-01-01' ELSE '2026-01-01' END AS updated_at FROM was w FULL OUTER JOIN came c USING (id)""")
def person_upsert(spark, sf_dir):
    """The name stays, spellings unite, the title is the new one if there is one, the tier only rises; touched rows are stamped."""
    c, k = src.table(spark, sf_dir, "customer").filter("c_nationkey < 20"), F.col("c_custkey")
    was = c.select(
        k.alias("id"), F.when(k % 5 > 0, F.col("c_name")).alias("name"), F.array("c_name", "c_mktsegment").alias("variants"), F.when(k % 3 > 0, F.col("c_mktsegment")).alias("title"), (k % 4).cast("int").alias("tier"), F.lit("2020-01-01").cast("date").alias("updated_at"),
    )
    came = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.concat(F.lit("order "), F.min("o_orderkey").cast("string")).alias("name"), F.collect_set("o_orderpriority").alias("variants"), F.when(F.first("o_custkey") % 2 > 0, F.min("o_orderstatus")).alias("title"), F.when(F.count("*") > 10, 3).otherwise(1).alias("tier"),
    )
    rules = {"name": "old", "variants": "union", "title": "new", "tier": "greatest"}
    merged = mops.rule_merge(was, came, ["id"], rules, F.lit("2026-01-01").cast("date"))
    return merged.withColumns({"variants": F.array_join("variants", "|"), "updated_at": F.col("updated_at").cast("string")})


_STUDIES = """had AS (SELECT o_custkey AS person_id, o_orderpriority AS school, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS start_year, max(CASE WHEN o_totalprice > 150000 THEN 'BSc' END) AS degree, min(o_orderstatus) AS field, max(CASE WHEN o_totalprice > 100000 THEN year(o_orderdate) + 4 END) AS end_year FROM orders GROUP BY ALL),
got AS (SELECT o_custkey AS person_id, o_orderpriority AS school, CASE WHEN l_returnflag <> 'R' THEN year(l_shipdate) END AS start_year, max(CASE WHEN l_discount > 0.05 THEN 'MSc' END) AS degree, max(CASE WHEN l_tax > 0.03 THEN l_linestatus END) AS field, max(CASE WHEN l_quantity > 20 THEN year(l_shipdate) + 3 END) AS end_year
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"""


@query("education_upsert", f"""WITH {_STUDIES} SELECT coalesce(g.person_id, h.person_id) AS person_id, coalesce(g.school, h.school) AS school, coalesce(g.start_year, h.start_year) AS start_year, coalesce(g.degree, h.degree) AS degree, coalesce(g.field, h.field) AS field, coalesce(g.end_year, h.end_year) AS end_year,
 (g.person_id IS NOT NULL)::INTEGER AS touched FROM had h FULL OUTER JOIN got g ON h.person_id = g.person_id AND h.school = g.school AND coalesce(h.start_year, 0) = coalesce(g.start_year, 0)""")
def education_upsert(spark, sf_dir):
    """Studies by person, school and start year (none counts as 0); degree, field and end are the new ones where there are any."""
    o, li = src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "lineitem")
    key = ["person_id", "school", "start_key"]
    of = lambda year, shown: [F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("school"), F.coalesce(F.when(shown, year), F.lit(0)).alias("start_key")]
    had = o.groupBy(*of(F.year("o_orderdate"), F.col("o_orderstatus") != "P")).agg(
        F.max(F.when(F.col("o_totalprice") > 150000, "BSc")).alias("degree"), F.min("o_orderstatus").alias("field"), F.max(F.when(F.col("o_totalprice") > 100000, F.year("o_orderdate") + 4)).alias("end_year"), F.lit(0).alias("updated_at"),
    )
    got = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(*of(F.year("l_shipdate"), F.col("l_returnflag") != "R")).agg(
        F.max(F.when(F.col("l_discount") > 0.05, "MSc")).alias("degree"), F.max(F.when(F.col("l_tax") > 0.03, F.col("l_linestatus"))).alias("field"), F.max(F.when(F.col("l_quantity") > 20, F.year("l_shipdate") + 3)).alias("end_year"),
    )
    merged = mops.rule_merge(had, got, key, dict.fromkeys(("degree", "field", "end_year"), "new"), F.lit(1))
    return merged.select("person_id", "school", F.nullif("start_key", F.lit(0)).alias("start_year"), "degree", "field", "end_year", F.col("updated_at").alias("touched"))


@query("current_backfill", """WITH had AS (SELECT o_custkey AS person_id, o_orderpriority AS company, max(o_orderkey) AS source FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2),
came AS (SELECT o_custkey AS person_id, o_orderpriority AS company, min(o_orderkey) AS source FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2)
SELECT *, 'kept' AS how FROM had UNION ALL SELECT c.*, 'inserted' FROM came c WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.person_id = c.person_id AND h.company = c.company)""")
def current_backfill(spark, sf_dir):
    """A current stint is inserted only where the person has none at the company; what is there isn't touched."""
    o = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"), F.col("o_orderpriority").alias("company"), "o_orderkey", "o_orderstatus")
    key = ["person_id", "company"]
    had = o.filter("o_orderstatus = 'O'").groupBy(*key).agg(F.max("o_orderkey").alias("source")).withColumn("how", F.lit("kept"))
    came = o.filter("o_orderstatus <> 'O'").groupBy(*key).agg(F.min("o_orderkey").alias("source")).withColumn("how", F.lit("inserted"))
    return mops.insert_or_ignore(had, came, key)


@query("activated_weights", """WITH v AS (SELECT o_custkey AS account_id, o_orderkey AS version, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_active FROM orders), n AS (SELECT DISTINCT l_suppkey AS account_id, -1::BIGINT AS version FROM lineitem WHERE l_returnflag = 'A')
SELECT account_id, version, (is_active AND account_id NOT IN (SELECT account_id FROM n))::INTEGER AS is_active FROM v UNION ALL SELECT account_id, version, 1 FROM n""")
def activated_weights(spark, sf_dir):
    """U7, 2.12: new weights become the only active version of their accounts, the versions of others stay as they are."""
    newest = F.max("o_orderkey").over(W.partitionBy("o_custkey"))
    v = src.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("version"), (F.col("o_orderkey") == newest).alias("is_active"))
    n = src.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_suppkey").alias("account_id")).distinct().select("account_id", F.lit(-1).cast("long").alias("version"), F.lit(False).alias("is_active"))
    return mops.activate(v, n).withColumn("is_active", F.col("is_active").cast("int"))


@query("unclamped_scores", f"""{src.with_ctes('signal_weights')}, s AS (SELECT user_id AS prospect_id, event_type AS signal_type, 100 * (1 - exp(-(value - 40) / 15)) AS v, (event_id % 10 + 1) / 10.0 AS base FROM events),
t AS (SELECT prospect_id, {", ".join(f"sum(v * base * {c}_weight) / sum(base * {c}_weight) AS {c}" for c in sops.SUBS)} FROM s JOIN signal_weights USING (signal_type) GROUP BY 1)
SELECT prospect_id, round(authenticity, 1) AS authenticity_score, round(authority, 1) AS authority_score, round(warmth, 1) AS warmth_score, round(0.4 * authenticity + 0.4 * authority + 0.2 * warmth, 1) AS overall_score FROM t""")
def unclamped_scores(spark, sf_dir):
    """The scorer that doesn't hold values between 0 and 100, so that low signals count against a prospect."""
    low = src.signals(spark, sf_dir).withColumn("value", (F.col("value").cast("double") - 40).cast("string"))
    return sops.prospect_scores(low, src.signal_weights(spark), clamped=False)


@query("page_orders", f"""{src.with_ctes('persons', 'companies')}, p AS (SELECT * FROM persons WHERE (name ILIKE '%1%' OR domain ILIKE '%an%') AND company_id IN (1, 2, 3, 4, 5, 6) AND coalesce(seniority, 0) >= 50)
SELECT 'seniority' AS sort, person_id, row_number() OVER (ORDER BY coalesce(seniority, -1) DESC, person_id)::INTEGER AS place FROM p QUALIFY place <= 200 UNION ALL SELECT 'name', person_id, row_number() OVER (ORDER BY name, person_id)::INTEGER AS place FROM p QUALIFY place <= 200
UNION ALL SELECT 'company', person_id, row_number() OVER (ORDER BY company_id, person_id)::INTEGER AS place FROM p QUALIFY place <= 200""")
def page_orders(spark, sf_dir):
    """A page of people by each of its three sorts, the first 200 of each."""
    p = src.persons(spark, sf_dir).filter((F.col("name").ilike("%1%") | F.col("domain").ilike("%an%")) & F.col("company_id").isin(1, 2, 3, 4, 5, 6) & (F.coalesce("seniority", F.lit(0)) >= 50))
    sorts = {"seniority": F.coalesce("seniority", F.lit(-1)).desc(), "name": F.col("name").asc(), "company": F.col("company_id").asc()}
    out = None
    for name, order in sorts.items():
        # a limit before the numbering, so that one task ranks a page only
        page = p.orderBy(order, "person_id").limit(200)
        rows = page.select(F.lit(name).alias("sort"), "person_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "person_id")).alias("place"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("company_page", f"""{src.with_ctes('persons', 'companies')}, c AS (SELECT company_id, company, industry AS tier, count(person_id) FILTER (seniority >= 60) AS enriched FROM companies LEFT JOIN persons USING (company_id) GROUP BY 1, 2, 3),
k AS (SELECT * FROM c WHERE enriched >= 2 AND company ILIKE '%1%')
SELECT company_id, enriched, row_number() OVER (ORDER BY least(100, round(enriched / 500 * 100)) DESC, company_id)::INTEGER AS by_share, row_number() OVER (ORDER BY enriched DESC, company_id)::INTEGER AS by_count, row_number() OVER (ORDER BY company, company_id)::INTEGER AS by_name, row_number() OVER (ORDER BY tier, company_id)::INTEGER AS by_tier FROM k""")
def company_page(spark, sf_dir):
    """Companies with enough enriched people, and their place under each of the page's four sorts."""
    n = src.persons(spark, sf_dir).groupBy("company_id").agg(F.count_if(F.col("seniority") >= 60).alias("enriched"))
    k = src.companies(spark, sf_dir).join(n, "company_id", "left").fillna(0, ["enriched"]).filter((F.col("enriched") >= 2) & F.col("company").ilike("%1%"))
    share = F.least(F.lit(100.0), F.round(F.col("enriched") / 500 * 100))
    place = lambda order: F.row_number().over(W.partitionBy(F.lit(0)).orderBy(order, "company_id"))  # noqa: E731  a row for each company that the page shows
    return k.select("company_id", "enriched", place(share.desc()).alias("by_share"), place(F.desc("enriched")).alias("by_count"), place(F.col("company")).alias("by_name"), place(F.col("industry")).alias("by_tier"))


@query("visible_graph", f"""WITH {gq._SPARSE}, {gq._TYPED}, shown AS (SELECT * FROM typed WHERE type IN ('co_investor', 'alumni_network', 'same_phd_advisor')), ends AS (SELECT a AS id FROM shown UNION SELECT b FROM shown)
SELECT 'edge' AS part, id, type AS kind FROM shown UNION ALL SELECT 'node', c_custkey, c_mktsegment FROM customer JOIN ends ON ends.id = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND contains(lower(c_name), '7')""")
def visible_graph(spark, sf_dir):
    """Edges of the visible kinds, and their ends of the visible kinds whose name holds the search text."""
    # the edges grow with the square of the customers, so they are counted once more for their ends and never stored
    shown = gq.typed_edges(spark, sf_dir).filter(F.col("type").isin("co_investor", "alumni_network", "same_phd_advisor"))
    ends = shown.select(F.explode(F.array("a", "b")).alias("c_custkey")).distinct()
    nodes = src.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.contains(F.lower("c_name"), F.lit("7"))).join(ends, "c_custkey", "left_semi")
    return shown.select(F.lit("edge").alias("part"), "id", F.col("type").alias("kind")).unionByName(nodes.select(F.lit("node").alias("part"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("kind")))


@query("path_tooltips", f"""WITH {gq._SPARSE}, r AS (SELECT node, partner, s, row_number() OVER (PARTITION BY node ORDER BY s DESC, partner) AS k FROM sways QUALIFY k <= 3)
SELECT c_custkey AS node, coalesce((SELECT string_agg(floor(s * 100 + 0.5)::INTEGER || '% · 1 hop', '; ' ORDER BY k) FROM r WHERE r.node = c_custkey), 'No warm paths') AS tooltip FROM customer""")
def path_tooltips(spark, sf_dir):
    """The three strongest paths of everyone as text."""
    ways = gops.both_ways(gq.sparse_edges(spark, sf_dir, best=3))
    k = F.row_number().over(W.partitionBy("node").orderBy(F.desc("strength"), "partner"))
    line = F.concat(F.floor(F.col("strength") * 100 + 0.5).cast("string"), F.lit("% · 1 hop"))
    told = ways.withColumn("k", k).filter("k <= 3").groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda s: s["line"]), "; ").alias("tooltip"))
    return src.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")).join(told, "node", "left").fillna("No warm paths", ["tooltip"])


_SOURCES = ["uspto", "scholar", "career", "parallel", "education", "conference", "standards", "rumour"]
_KINDS = ["career_overlap_same_team", "conference_co_presenter", "same_mba_cohort", "standards_committee_peer", "alumni_network"]


@query("source_confidences", f"""WITH s AS (SELECT l_orderkey, l_linenumber, ({_SOURCES})[l_orderkey % 8 + 1] AS source, CASE WHEN l_partkey % 6 > 0 THEN ({_KINDS})[l_partkey % 6] END AS kind, CASE WHEN l_tax > 0.02 THEN l_quantity::INTEGER % 9 END AS authors, CASE WHEN l_discount > 0.05 THEN l_discount END AS given FROM lineitem)
SELECT l_orderkey, l_linenumber, (CASE source WHEN 'uspto' THEN 0.95 WHEN 'scholar' THEN CASE WHEN coalesce(authors, 5) <= 5 THEN 0.90 ELSE 0.75 END WHEN 'career' THEN CASE WHEN kind = 'career_overlap_same_team' THEN 0.88 ELSE 0.60 END
 WHEN 'parallel' THEN CASE coalesce(kind, '-') WHEN 'conference_co_presenter' THEN 0.80 WHEN '-' THEN 0.20 WHEN 'standards_committee_peer' THEN 0.82 ELSE 0.5 END WHEN 'education' THEN coalesce(given, CASE coalesce(kind, '-') WHEN 'same_mba_cohort' THEN 0.85 WHEN '-' THEN 0.25 WHEN 'alumni_network' THEN 0.25 ELSE 0.5 END)
 WHEN 'conference' THEN CASE coalesce(kind, '-') WHEN 'conference_co_presenter' THEN 0.80 WHEN '-' THEN 0.20 ELSE 0.4 END WHEN 'standards' THEN 0.82 ELSE 0.5 END)::DOUBLE AS confidence FROM s""")
def source_confidences(spark, sf_dir):
    """confidence of a signal by its source, kind, number of authors and the one given."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int"))
    kind = F.when(F.col("l_partkey") % 6 > 0, pick(_KINDS, F.greatest(F.lit(1), F.col("l_partkey") % 6)))
    authors, given = F.when(F.col("l_tax") > 0.02, F.col("l_quantity").cast("int") % 9), F.when(F.col("l_discount") > 0.05, F.col("l_discount"))
    return src.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fs.source_confidence(pick(_SOURCES, F.col("l_orderkey") % 8 + 1), kind, authors, given).cast("double").alias("confidence"))


@query("hub_summaries", """WITH m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 > 0 THEN n_name END AS company, r_name AS industry, c_mktsegment AS role, CASE WHEN c_custkey % 6 > 0 THEN c_acctbal / 100 END AS score, CASE WHEN c_custkey % 4 > 0 THEN 'City  ' || (c_custkey % 12) END AS city
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
o AS (SELECT o_custkey AS id, o_orderpriority AS past, o_orderstatus AS school, CASE WHEN o_orderstatus <> 'P' THEN 'Expo ' || (o_orderkey % 5) END AS venue, CASE WHEN o_orderkey % 3 > 0 THEN year(o_orderdate) END AS y FROM orders WHERE o_custkey IN (SELECT id FROM m)),
met AS MATERIALIZED (SELECT DISTINCT hub, id FROM (SELECT 'company:' || trim(regexp_replace(lower(company), '[^\\w\\s]+', ' ', 'g')) AS hub, id FROM m UNION ALL SELECT 'industry:' || lower(industry), id FROM m UNION ALL SELECT 'role:' || lower(role), id FROM m UNION ALL SELECT 'city:' || lower(city), id FROM m
 UNION ALL SELECT 'company:' || trim(regexp_replace(regexp_replace(lower(past), '[^\\w\\s]+', ' ', 'g'), '\\s+', ' ', 'g')), id FROM o UNION ALL SELECT 'school:' || lower(school), id FROM o UNION ALL SELECT 'conference:' || lower(concat_ws(' ', venue, y)), id FROM o WHERE venue IS NOT NULL) WHERE hub IS NOT NULL),
f AS MATERIALIZED (SELECT met.hub, m.* FROM met JOIN m USING (id)),
r AS (SELECT hub, string_agg(role || '=' || n, ', ' ORDER BY n DESC, role) AS roles FROM (SELECT hub, role, count(*) AS n FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY hub ORDER BY count(*) DESC, role) <= 3) GROUP BY 1),
i AS (SELECT hub, string_agg(industry || '=' || n, ', ' ORDER BY n DESC, industry) AS industries FROM (SELECT hub, industry, count(*) AS n FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY hub ORDER BY count(*) DESC, industry) <= 3) GROUP BY 1),
p AS (SELECT hub, string_agg(id, ', ' ORDER BY coalesce(score, 0) DESC, id) AS people FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY hub ORDER BY coalesce(score, 0) DESC, id) <= 8) GROUP BY 1)
SELECT hub, count(*) AS total, coalesce(round(round(avg(score), 9), 1), 0) AS avg_score, count(*) FILTER (score >= 75) AS high, any_value(roles) AS roles, any_value(industries) AS industries, any_value(people) AS people FROM f JOIN r USING (hub) JOIN i USING (hub) JOIN p USING (hub) GROUP BY hub""")
def hub_summaries(spark, sf_dir):
    """Members of company, industry, school, role, conference and city hubs, with scores, commonest roles and industries and best people."""
    c, n, r, o = (src.table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    k = F.col("c_custkey")
    m = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("id"), F.when(k % 9 > 0, F.col("n_name")).alias("company"), F.col("r_name").alias("industry"), F.col("c_mktsegment").alias("role"), F.when(k % 6 > 0, F.col("c_acctbal") / 100).alias("score"),
        F.when(k % 4 > 0, F.concat(F.lit("City  "), (k % 12).cast("string"))).alias("city"),
    )
    key = F.col("o_orderkey")
    talk = F.struct(F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("Expo "), (key % 5).cast("string"))).alias("venue"), F.when(key % 3 > 0, F.year("o_orderdate")).alias("year"))
    told = o.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("past"), F.collect_set("o_orderstatus").alias("schools"), F.collect_set(talk).alias("talks"))
    return hubs.hub_summaries(m.join(told, "id", "left"))


_ENTRIES = ['[{"person_name": " Una Weld ", "person_title": "", "reports_to_name": "Tor Hale", "confidence": 0.95}, {"person_name": 5, "confidence": 1}, {"person_title": "Dyer"}, 7]', '[{"person_name": "Mia Orr", "reports_to_title": " Head ", "confidence": "high"}, {"person_name": "Bo", "confidence": "1.5"}, {"person_name": "  "}]', "[]", "no list", '{"person_name": "Ann Lee"}']
_ENTRIES_TOLD = [(0, "Una Weld", None, "Tor Hale", None, 0.95), (1, "Mia Orr", None, None, "Head", 0.0), (1, "Bo", None, None, None, 1.0)]


@query("press_entries", "SELECT c_custkey AS id, n AS person_name, t AS person_title, rn AS reports_to_name, rt AS reports_to_title, c AS confidence, (c_custkey % 3 = 0)::INTEGER AS leads FROM customer JOIN (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v) for v in r) + ")" for r in _ENTRIES_TOLD
) + ") e(i, n, t, rn, rt, c) ON c_custkey % 5 = i")
def press_entries(spark, sf_dir):
    """reporting lines that a reader of press releases returned as JSON, checked entry by entry, and whether the release tells of leading at all."""
    k = F.col("c_custkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    c = src.table(spark, sf_dir, "customer").select(k.alias("id"), pick(_ENTRIES, k % 5).alias("entries"), pick(["Una OVERSEES the looms", "Earnings rose", "A new dye"], k % 3).alias("text"))
    return press.reporting_entries(c).select("id", "person_name", "person_title", "reports_to_name", "reports_to_title", "confidence", press.tells_of_leading(F.col("text")).cast("int").alias("leads"))
