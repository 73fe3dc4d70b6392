"""Queries of what a visitor of the graph sees, and of edges stated outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.scoring import STRENGTHS
from quillgraph.operators import discovery as ops
from quillgraph.operators.network import ROOT_ID, Network
from quillgraph.sources import adapters as src

from . import network as nq
from .registry import ORACLES, query

KINDS = ["person", "company", "role", "industry", "school"]
SEEDS = ["Verilog", "steel", "RTL"]
_NN, _EE = f"nn AS MATERIALIZED ({ORACLES['network_nodes']})", f"ee AS MATERIALIZED ({ORACLES['network_edges']})"
_SCORE = "CASE WHEN id % 10 > 0 THEN (id * 37 % 101)::DOUBLE END"
_SHOWN = f"n AS MATERIALIZED (SELECT nn.id, kind, nn.name, {_SCORE.replace('id', 'p.id')} AS score, lower(trim(p.company)) AS company, p.role AS title, p.company AS employer FROM nn LEFT JOIN people p ON nn.id = 'person:' || p.id)"


def _graph(spark, sf_dir):
    """(nodes with score, title and company of people, edges), twin of ``_SHOWN`` and ``_EE``."""
    inputs = nq.inputs(spark, sf_dir)
    net, i = Network(*inputs), F.col("id")
    score = F.when(i % 10 > 0, (i * 37 % 101).cast("double"))
    told = inputs[0].select(F.concat(F.lit("person:"), i.cast("string")).alias("id"), score.alias("score"), F.col("role").alias("title"), "company")
    return net.nodes().join(told, "id", "left"), net.edges()


_IN = ", ".join(repr(k) for k in KINDS)


@query("focal_views", f"""WITH {nq._INPUTS}, {_NN}, {_EE}, {_SHOWN}, foci AS (SELECT id AS focus FROM n UNION ALL SELECT 'person:none'),
known AS (SELECT focus, kind AS "of", score AS own, company FROM foci JOIN n ON id = focus), nb AS (SELECT source AS a, target AS b FROM ee UNION SELECT target, source FROM ee),
near AS (SELECT k.*, n.id, n.kind, n.score FROM known k JOIN nb ON a = focus JOIN n ON n.id = b WHERE b <> focus),
best AS MATERIALIZED (SELECT focus, id FROM near WHERE "of" = 'person' AND kind = 'person' QUALIFY row_number() OVER (PARTITION BY focus ORDER BY coalesce(score, -1) DESC, id) <= 40),
short AS (SELECT focus, company, 12 - coalesce(had, 0) AS need FROM known LEFT JOIN (SELECT focus, count(*) AS had FROM best GROUP BY 1) USING (focus) WHERE "of" = 'person' AND own >= 75),
fill AS (SELECT s.focus, n.id, need FROM short s JOIN n ON n.company = s.company AND n.kind = 'person' AND n.id <> s.focus ANTI JOIN best b ON b.focus = s.focus AND b.id = n.id QUALIFY row_number() OVER (PARTITION BY s.focus ORDER BY coalesce(score, -1) DESC, n.id) <= need),
around AS (SELECT focus, id FROM near WHERE CASE "of" WHEN 'industry' THEN kind = 'company' WHEN 'person' THEN kind <> 'person' ELSE true END UNION SELECT * FROM best UNION SELECT focus, id FROM fill UNION SELECT focus, focus FROM known UNION SELECT focus, '{ROOT_ID}' FROM known)
SELECT focus, id FROM around JOIN n USING (id) WHERE kind IN ({_IN}) OR id = focus UNION ALL SELECT 'person:none', id FROM n WHERE kind IN ('industry', 'company', 'city', 'country')""")
def focal_views(spark, sf_dir):
    """The surroundings of every node, and of one that isn't there."""
    nodes, edges = _graph(spark, sf_dir)
    foci = nodes.select(F.col("id").alias("focus")).unionByName(spark.createDataFrame([("person:none",)], "focus string"))
    return ops.focal_subgraphs(nodes, edges, foci, KINDS)


_BASE = " ".join(f"WHEN '{k}' THEN {s}" for k, (s, _) in STRENGTHS.items())
#: Sources of the kinds of edges in the graph, written out.
_SOURCES = "CASE kind WHEN 'patent_co_inventor' THEN 'patent' WHEN 'academic_co_author' THEN 'paper' WHEN 'standards_committee' THEN 'standards' WHEN 'conference_co_presenter' THEN 'conference' WHEN 'same_mba_cohort' THEN 'cohort' WHEN 'same_phd_program' THEN 'cohort' WHEN 'executive_education' THEN 'cohort' WHEN 'same_undergrad_cohort' THEN 'cohort' ELSE 'unknown' END"


@query("inspected_edges", f"""WITH {nq._INPUTS}, {_NN}, {_EE}, {_SHOWN} SELECT source || '|' || target || '|' || e.kind AS edge_id, e.kind, CASE e.kind {_BASE} ELSE 0.5 END::DOUBLE AS base_strength,
CASE WHEN evidence IS NOT NULL THEN {_SOURCES.replace('CASE kind', 'CASE e.kind')} END AS source_type, coalesce(s.name, source) AS source_name, s.title AS source_title, s.employer AS source_company, coalesce(t.name, target) AS target_name, t.title AS target_title, t.employer AS target_company
FROM ee e LEFT JOIN n s ON s.id = source LEFT JOIN n t ON t.id = target""")
def inspected_edges(spark, sf_dir):
    """Every edge with its base strength, the source of its evidence and both ends in full."""
    nodes, edges = _graph(spark, sf_dir)
    return ops.inspected_edges(edges, nodes).drop("source", "target", "evidence")


@query("lead_matches", f"""WITH {nq._INPUTS}, w AS (SELECT *, {_SCORE} AS score, list_distinct(list_filter(string_split_regex(lower(coalesce(role, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS words FROM people),
m AS (SELECT id, coalesce(score, 0) AS score, CASE WHEN contains(lower(coalesce(name, '')), '7') THEN 4.0::DOUBLE ELSE 0 END + 3 * len(list_intersect(words, ['machinery', 'lead', 'weaver']))::DOUBLE / 3
 + CASE WHEN contains(lower(coalesce(company, '')), 'france') OR contains('france', lower(coalesce(company, ''))) THEN 2 ELSE 0 END + CASE WHEN contains(lower(coalesce(industry, '')), 'asia') THEN 1 ELSE 0 END
 + least(2.0, CASE WHEN contains(lower(coalesce(role, '')), 'mach') THEN 0.5 ELSE 0 END + CASE WHEN contains(lower(coalesce(role, '')), 'lead') THEN 0.5 ELSE 0 END)::DOUBLE AS points FROM w)
SELECT id, round(points, 1) AS match_score, round(0.6 * points + 0.4 * (score / 10), 6) AS blended FROM m WHERE round(points, 1) >= 2 ORDER BY 0.6 * points + 0.4 * (score / 10) DESC, id LIMIT 10""")
def lead_matches(spark, sf_dir):
    """The ten prospects that fit a lead best, words of the role included."""
    i = F.col("id")
    people = nq.inputs(spark, sf_dir)[0].withColumn("score", F.when(i % 10 > 0, (i * 37 % 101).cast("double")))
    got = ops.lead_matches(people, name="7", company="France", roles=["Machinery lead", "weaver, lead"], keywords=["mach", "Lead", ""], industry="Asia")
    return got.select("id", "match_score", F.round("blended", 6).alias("blended"))


@query("suggestion_vocabularies", f"""WITH {nq._INPUTS}, titles AS (SELECT CASE id % 5 WHEN 0 THEN split_part(role, ' ', 1) || ' Lead' WHEN 1 THEN upper(role[1]) || split_part(role[2:], ' ', 1) WHEN 2 THEN role END AS value FROM people),
tokens AS (SELECT trim(t) AS value FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS t FROM part) WHERE length(trim(t)) BETWEEN 2 AND 40),
mined AS (SELECT value, row_number() OVER (ORDER BY count(*) DESC, value) AS place FROM tokens GROUP BY 1 QUALIFY place <= 200)
SELECT 'roles' AS vocabulary, value, row_number() OVER (ORDER BY count(*) DESC, value)::INTEGER AS place FROM titles WHERE value IS NOT NULL AND length(value) BETWEEN 6 AND 70 GROUP BY value QUALIFY place <= 300
UNION ALL SELECT DISTINCT 'companies', company, NULL FROM people WHERE company <> ''
UNION ALL SELECT * FROM (VALUES {', '.join(f"('keywords', '{s}', {i})" for i, s in enumerate(SEEDS, 1))}) UNION ALL SELECT 'keywords', value, (place + {len(SEEDS)})::INTEGER FROM mined WHERE value NOT IN ({', '.join(repr(s) for s in SEEDS)})""")
def suggestion_vocabularies(spark, sf_dir):
    """Titles, companies and keywords to suggest from, seeds included."""
    words = F.array_join(F.transform(F.split(F.concat_ws(" ", "p_name", "p_type"), " "), lambda w: F.concat(F.lit('"'), w, F.lit(' "'))), ", ")
    k = F.col("p_partkey")
    value = F.concat(F.lit('{"tokens": ['), words, F.lit(', 7, null, "x"]}'))
    kept = src.table(spark, sf_dir, "part").select(F.lit("tech_stack").alias("type"), value.alias("value"))
    odd = src.table(spark, sf_dir, "part").select(F.when(k % 2 == 0, "tech_stack").otherwise("news").alias("type"), F.when(k % 2 == 0, '{"tokens": "steel"}').otherwise(value).alias("value"))
    return ops.vocabularies(nq.inputs(spark, sf_dir)[0], kept.unionByName(odd), SEEDS)


@query("stated_edges", """WITH r AS (SELECT o_custkey::VARCHAR AS report_id, CASE WHEN o_custkey % 8 > 0 THEN (o_custkey % 8)::VARCHAR END AS company_id, o_orderpriority AS signal_type, CASE WHEN o_orderkey % 15 < 14 THEN (o_orderkey % 15) / 10 END AS confidence,
 CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50)::VARCHAR END AS manager_id, CASE WHEN o_orderkey % 7 > 0 THEN 'Head ' || o_orderstatus ELSE '' END AS title FROM orders),
good AS (SELECT *, '[Unknown ' || title || ']' AS name FROM r WHERE (manager_id IS NOT NULL OR title <> '') AND (manager_id IS NULL OR manager_id <> report_id) AND confidence BETWEEN 0 AND 1 AND (manager_id IS NOT NULL OR company_id IS NOT NULL)),
had AS (SELECT (s_suppkey % 5)::VARCHAR AS company_id, '[Unknown Head O]' AS name, min('s' || s_suppkey) AS id FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1)
SELECT report_id, coalesce(manager_id, h.id, sha256(g.company_id || chr(0) || g.name)) AS manager_id, round(confidence * CASE WHEN manager_id IS NULL THEN 0.7 ELSE 1 END, 9)::DOUBLE AS confidence, 'explicit_' || signal_type || CASE WHEN manager_id IS NULL THEN '_unresolved_target' ELSE '' END AS method
FROM good g LEFT JOIN had h ON manager_id IS NULL AND h.company_id = g.company_id AND h.name = g.name""")
def stated_edges(spark, sf_dir):
    """Stated edges, those to unknown managers by stubs that are there or follow from company and title."""
    o, s = src.table(spark, sf_dir, "orders"), src.table(spark, sf_dir, "supplier")
    k, c, text = F.col("o_orderkey"), F.col("o_custkey"), lambda x: x.cast("string")
    stated = o.select(
        text(c).alias("report_id"), F.when(c % 8 > 0, text(c % 8)).alias("company_id"), F.col("o_orderpriority").alias("signal_type"), F.when(k % 15 < 14, (k % 15) / 10).alias("confidence"),
        F.when(k % 3 == 0, text(k % 50)).alias("manager_id"), F.when(k % 7 > 0, F.concat(F.lit("Head "), "o_orderstatus")).otherwise("").alias("manager_title"),
    )
    persons = s.select(F.concat(F.lit("s"), text(F.col("s_suppkey"))).alias("id"), text(F.col("s_suppkey") % 5).alias("company_id"), F.lit("[Unknown Head O]").alias("name"), (F.col("s_nationkey") % 2 == 0).alias("unresolved"))
    return ops.stated_edges(stated, persons)[0].withColumn("confidence", F.round("confidence", 9))


@query("edge_triage", """WITH RECURSIVE e AS (SELECT c_custkey AS r, CASE c_custkey WHEN 10 THEN 11 WHEN 11 THEN 10 ELSE c_custkey // 2 END AS m FROM customer WHERE c_custkey > 0),
up AS (SELECT r FROM e WHERE m NOT IN (SELECT r FROM e) UNION SELECT e.r FROM e JOIN up ON e.m = up.r)
SELECT CASE WHEN r IN (SELECT r FROM up) THEN 'propagated' WHEN r IN (10, 11) THEN 'cycle_skipped' ELSE 'orphan_skipped' END AS outcome, count(*) AS n FROM e GROUP BY 1""")
def edge_triage(spark, sf_dir):
    """Edges that a root's confidence reaches, those on a cycle and those below one."""
    k = F.col("c_custkey")
    m = F.when(k == 10, 11).when(k == 11, 10).otherwise(F.floor(k / 2)).cast("long")
    return ops.triage(src.table(spark, sf_dir, "customer").filter(k > 0).select(k.alias("report_id"), m.alias("manager_id")))
