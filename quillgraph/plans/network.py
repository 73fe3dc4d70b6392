"""Queries over the whole property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.texts import COMPANY_KEY_WORDS, company_node_key
from quillgraph.operators import network as ops
from quillgraph.sources import adapters as src

from .registry import query

#: Types of connections as they come, two of which make no edge.
TYPES = [*ops.SIGNAL_EDGES, "past_employer", "alumni_network"]
_PAYLOAD = (
    '{"connected_to": "@to", "year": @n, "patent_number": "P@n", "patent_title": 7, "grant_date": "", "paper_title": "Paper @n", "citation_count": " 12.7 ", "event": "Days", "committee": "C@n",'
    ' "years": 2001, "institution": "School @n", "overlap_start_year": 2001.9, "overlap_end_year": "x", "company_name": "Mill", "overlap_years": "", "team_a": "blue", "seniority_gap": true, "doi": null}'
)


def _payload(to, n, shape):
    text = F.replace(F.replace(F.lit(_PAYLOAD), F.lit("@to"), to.cast("string")), F.lit("@n"), n.cast("string"))
    return F.when(shape == 0, "[1, 2]").when(shape == 1, "{broken").when(shape == 2, F.concat(F.lit('{"connected_to": "'), to.cast("string"), F.lit('"}'))).otherwise(text)


def _sql_payload(to: str, n: str, shape: str) -> str:
    return f"""CASE {shape} WHEN 0 THEN '[1, 2]' WHEN 1 THEN '{{broken' WHEN 2 THEN '{{"connected_to": "' || {to} || '"}}' ELSE replace(replace('{_PAYLOAD}', '@to', ({to})::VARCHAR), '@n', ({n})::VARCHAR) END"""


def inputs(spark, sf_dir):
    """People of the customers, places and partners of the nations, signals of the events, connections of the orders."""
    c, n, r, e, o = (src.table(spark, sf_dir, t) for t in ("customer", "nation", "region", "events", "orders"))
    k, name = F.col("c_custkey"), F.col("n_name")
    home = n.join(r, n.n_regionkey == r.r_regionkey)
    people = c.join(home, c.c_nationkey == n.n_nationkey).select(
        k.alias("id"), F.col("c_name").alias("name"),
        F.when(k % 5 == 0, F.concat(F.col("c_mktsegment"), F.lit(" lead at Mill"))).when(k % 5 == 1, F.concat(F.lower("c_mktsegment"), F.lit(" - team"))).when(k % 5 == 2, F.col("c_mktsegment")).when(k % 5 == 3, "").alias("role"),
        F.when(k % 17 == 0, F.lit(None)).when(k % 4 == 0, F.concat(name, F.lit(" Corp."))).when(k % 4 == 1, F.concat(F.lower(name), F.lit(", Inc"))).when(k % 4 == 2, name).otherwise("Systems Ltd").alias("company"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), "r_name")).when(k % 3 == 1, "  ").alias("industry"),
        F.when(k % 7 > 0, F.array(F.concat(F.lit("Loom "), (k % 23).cast("string"), F.lit(" LLC")), F.lit("Inc"), F.lit(None).cast("string"), F.concat(F.lower(name), F.lit(" Technologies")))).alias("past"),
        F.array(F.concat(F.lit("School "), (k % 31).cast("string")), F.lit(""), F.lit(None).cast("string"), F.lit("SCHOOL 1")).alias("schools"),
        F.when(k % 6 > 0, F.array(F.struct(F.concat(F.lit("Days "), (k % 9).cast("string")).alias("venue"), F.when(k % 4 > 0, (k % 4 - 1) * 2001).cast("int").alias("year")))).alias("talks"),
    )
    nk = F.col("n_nationkey")
    places = home.filter(nk % 3 > 0).select(
        company_node_key(name).alias("key"), F.when(nk % 4 > 0, F.concat(F.lit("City "), (nk % 7).cast("string"))).alias("city"), F.when(nk % 5 > 0, F.concat("r_name", F.lit(" Trade"))).alias("industry")
    )
    guild = n.select(company_node_key(name).alias("key"), F.concat(F.lit("Guild "), (nk % 6).cast("string"), F.lit(" plc")).alias("partner"))
    partners = guild.unionByName(n.select(company_node_key(name).alias("key"), F.concat(F.element_at(F.array(F.lit("FRANCE"), F.lit("Peru Limited"), F.lit("Technology")), (nk % 3 + 1).cast("int"))).alias("partner")))
    kind = lambda x: F.element_at(F.array(*map(F.lit, TYPES)), (x % len(TYPES) + 1).cast("int"))
    ek, u = F.col("event_id"), F.col("user_id")
    signals = e.select(ek.alias("id"), u.alias("person_id"), kind(ek).alias("type"), _payload((u * 7 + ek) % 160, ek % 30 + 1990, ek % 6).alias("value"))
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    connections = o.select(ok.alias("id"), ck.alias("person_id"), ((ck * 3 + ok) % 160).alias("other_id"), kind(ok).alias("type"), ((ok % 11) / 10).alias("strength"), _payload((ck * 3 + ok) % 160, ok % 30 + 1990, ok % 4).alias("value"))
    return people, places, partners, signals, connections


def _sql_key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '{COMPANY_KEY_WORDS}', '', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def _sql_label(x: str) -> str:
    return rf"""(CASE WHEN length(trim(regexp_replace(regexp_replace(trim(coalesce({x}, '')), '(?i)\s+at\s+.+$', ''), '\s+-\s+.*$', ''))) > 28 THEN error('longer than the fixture') ELSE trim(regexp_replace(regexp_replace(trim(coalesce({x}, '')), '(?i)\s+at\s+.+$', ''), '\s+-\s+.*$', '')) END)"""


def _sql_field(field: str) -> str:
    name, form = field.split(":")
    text, kind = f"(j->>'$.{name}')", f"json_type(j, '$.{name}')"
    if form == "s":
        return f"CASE WHEN {kind} = 'VARCHAR' THEN {text} ELSE '' END"
    if form == "n":
        return f"CASE WHEN {kind} = 'VARCHAR' AND {text} <> '' THEN {text} END"
    return f"CASE WHEN {kind} IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN trunc(CASE WHEN trim({text}) = '' THEN 0 ELSE try_cast(trim({text}) AS DOUBLE) END)::BIGINT END"


def _sql_told(values: dict[str, str]) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_KIND = _sql_told({k: edge for k, (edge, _) in ops.SIGNAL_EDGES.items()})
_EVIDENCE = f"CASE {_sql_told({k: e for k, (_, e) in ops.SIGNAL_EDGES.items()})} " + " ".join(
    f"WHEN '{kind}' THEN json_object('kind', '{kind}', " + ", ".join(f"'{f.split(':')[0]}', {_sql_field(f)}" for f in fields.split()) + ")" for kind, fields in ops.EVIDENCE_FIELDS.items()
) + " END"
_TYPES_SQL = f"({TYPES})[{{}} % {len(TYPES)} + 1]"

_INPUTS = f"""people AS MATERIALIZED (SELECT *, coalesce(nullif({_sql_key('company')}, ''), 'unknown') AS key, {_sql_label('role')} AS label FROM (SELECT c_custkey AS id, c_name AS name,
 CASE c_custkey % 5 WHEN 0 THEN c_mktsegment || ' lead at Mill' WHEN 1 THEN lower(c_mktsegment) || ' - team' WHEN 2 THEN c_mktsegment WHEN 3 THEN '' END AS role,
 CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN n_name || ' Corp.' WHEN c_custkey % 4 = 1 THEN lower(n_name) || ', Inc' WHEN c_custkey % 4 = 2 THEN n_name ELSE 'Systems Ltd' END AS company,
 CASE c_custkey % 3 WHEN 0 THEN ' ' || r_name WHEN 1 THEN '  ' END AS industry,
 CASE WHEN c_custkey % 7 > 0 THEN ['Loom ' || (c_custkey % 23) || ' LLC', 'Inc', NULL, lower(n_name) || ' Technologies'] END AS past,
 ['School ' || (c_custkey % 31), '', NULL, 'SCHOOL 1'] AS schools,
 CASE WHEN c_custkey % 6 > 0 THEN CASE WHEN c_custkey % 4 > 1 THEN 'Days ' || (c_custkey % 9) || ' ' || ((c_custkey % 4 - 1) * 2001) ELSE 'Days ' || (c_custkey % 9) END END AS talk
 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)),
places AS (SELECT {_sql_key('n_name')} AS key, CASE WHEN n_nationkey % 4 > 0 THEN 'City ' || (n_nationkey % 7) END AS city, CASE WHEN n_nationkey % 5 > 0 THEN r_name || ' Trade' END AS trade FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 3 > 0),
partners AS (SELECT {_sql_key('n_name')} AS key, 'Guild ' || (n_nationkey % 6) || ' plc' AS partner FROM nation UNION ALL SELECT {_sql_key('n_name')}, (['FRANCE', 'Peru Limited', 'Technology'])[n_nationkey % 3 + 1] FROM nation),
placed AS MATERIALIZED (SELECT p.*, coalesce(nullif(trim(industry), ''), trade) AS field FROM people p LEFT JOIN places USING (key)),
past AS (SELECT id, unnest(past) AS name, unnest(range(len(past))) + 1 AS spot FROM people), pasts AS (SELECT *, {_sql_key('name')} AS key FROM past WHERE {_sql_key('name')} <> ''),
first AS MATERIALIZED (SELECT * FROM (SELECT key, company AS name, id, 0 AS spot FROM people UNION ALL SELECT key, name, id, spot FROM pasts) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id, spot) = 1),
named AS (SELECT {_sql_key('partner')} AS "to", partner, key FROM partners WHERE key IN (SELECT key FROM first) AND {_sql_key('partner')} <> ''),
extra AS (SELECT "to" AS key, partner AS name FROM named WHERE "to" NOT IN (SELECT key FROM first) QUALIFY row_number() OVER (PARTITION BY "to" ORDER BY key, partner) = 1),
companies AS MATERIALIZED (SELECT x.*, city, trade FROM (SELECT key, name FROM first UNION ALL SELECT * FROM extra) x LEFT JOIN places USING (key)),
byplace AS (SELECT * FROM companies WHERE trade IS NOT NULL AND (key IN (SELECT key FROM pasts) OR key IN (SELECT key FROM extra))),
talks AS (SELECT id, talk FROM people WHERE talk IS NOT NULL), study AS (SELECT id, school, spot FROM (SELECT id, unnest(schools) AS school, unnest(range(len(schools))) AS spot FROM people) WHERE school <> '')"""


@query("network_nodes", f"""WITH {_INPUTS}, n AS (SELECT 'person:' || id AS id, 'person' AS kind, name, 1 AS turn, id AS who, 0 AS spot FROM people UNION ALL SELECT 'company:' || key, 'company', name, 1, NULL, 0 FROM companies
UNION ALL SELECT 'city:' || lower(trim(city)), 'city', city, 2, NULL, 0 FROM companies WHERE city IS NOT NULL UNION ALL SELECT 'industry:' || lower(trim(field)), 'industry', field, 1, id, 0 FROM placed WHERE field IS NOT NULL
UNION ALL SELECT 'industry:' || lower(trim(trade)), 'industry', trade, 2, NULL, 0 FROM byplace UNION ALL SELECT 'school:' || lower(trim(school)), 'school', school, 1, id, spot FROM study
UNION ALL SELECT 'conference:' || lower(trim(talk)), 'conference', talk, 1, id, 0 FROM talks UNION ALL SELECT 'role:' || lower(trim(label)), 'role', label, 1, id, 0 FROM people WHERE label <> '' UNION ALL SELECT 'industry:technology', 'industry', 'Technology', 3, NULL, 0)
SELECT id, kind, name FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, who NULLS FIRST, spot, name NULLS FIRST) = 1""")
def network_nodes(spark, sf_dir):
    """Nodes of seven kinds and the root, each under its first name."""
    return ops.Network(*inputs(spark, sf_dir)).nodes()


@query("network_edges", f"""WITH {_INPUTS}, ranked AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM people),
sig AS (SELECT event_id AS id, user_id AS person_id, {_TYPES_SQL.format('event_id')} AS type, {_sql_payload('(user_id * 7 + event_id) % 160', 'event_id % 30 + 1990', 'event_id % 6')} AS value FROM events),
con AS (SELECT o_orderkey AS id, o_custkey AS person_id, ((o_custkey * 3 + o_orderkey) % 160)::VARCHAR AS "to", {_TYPES_SQL.format('o_orderkey')} AS type, {_sql_payload('(o_custkey * 3 + o_orderkey) % 160', 'o_orderkey % 30 + 1990', 'o_orderkey % 4')} AS value FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey % 11) / 10 DESC, o_orderkey) <= 8),
links AS (SELECT 5 AS turn, id, person_id, type, CASE WHEN json_valid(value) THEN value END AS v, CASE WHEN json_valid(value) THEN value->>'$.connected_to' END AS "to" FROM sig UNION ALL SELECT 6, id, person_id, type, CASE WHEN json_valid(value) THEN value END, "to" FROM con),
hidden AS (SELECT turn, person_id, id, 'person:' || person_id AS source, 'person:' || "to" AS target, {_KIND} AS kind, CASE WHEN json_type(v) = 'OBJECT' THEN {_EVIDENCE} END AS evidence FROM (SELECT *, v::JSON AS j FROM links)
 WHERE {_KIND} IS NOT NULL AND "to" IN (SELECT id::VARCHAR FROM people) AND person_id IN (SELECT id FROM people)),
bare AS (SELECT 'person:' || id AS source, 'company:' || key AS target, 'works_at' AS kind FROM people UNION ALL SELECT 'company:' || key, 'industry:' || lower(trim(field)), 'vertical' FROM placed WHERE field IS NOT NULL
 UNION ALL SELECT 'company:' || key, 'city:' || lower(trim(city)), 'located_in' FROM companies WHERE city IS NOT NULL UNION ALL SELECT 'company:' || key, 'industry:' || lower(trim(trade)), 'vertical' FROM byplace
 UNION ALL SELECT 'person:' || id, 'company:' || key, 'past_employer' FROM pasts UNION ALL SELECT 'person:' || id, 'school:' || lower(trim(school)), 'education' FROM study UNION ALL SELECT 'person:' || id, 'conference:' || lower(trim(talk)), 'scope_signal' FROM talks
 UNION ALL SELECT 'person:' || id, 'role:' || lower(trim(label)), 'scope_signal' FROM people WHERE label <> '' UNION ALL SELECT 'role:' || lower(trim(label)), 'industry:' || lower(trim(field)), 'vertical' FROM placed WHERE label <> '' AND field IS NOT NULL
 UNION ALL SELECT 'person:' || x.id, 'person:' || y.id, 'colleague' FROM ranked x JOIN ranked y ON x.key = y.key AND y.r BETWEEN x.r + 1 AND x.r + 6
 UNION ALL SELECT 'company:' || key, 'company:' || "to", 'partnership' FROM named UNION ALL SELECT 'industry:' || lower(trim(field)), 'industry:technology', 'vertical' FROM placed WHERE field IS NOT NULL
 UNION ALL SELECT 'industry:' || lower(trim(trade)), 'industry:technology', 'vertical' FROM byplace UNION ALL SELECT 'city:' || lower(trim(city)), 'industry:technology', 'located_in' FROM companies WHERE city IS NOT NULL
 UNION ALL SELECT 'person:' || id, 'role:' || lower(trim(role)), 'evidence_cited' FROM people WHERE id IN (SELECT user_id FROM events) AND lower(trim(role)) IN (SELECT lower(trim(label)) FROM people WHERE label <> '')),
every AS (SELECT source, target, kind, NULL::JSON AS evidence, NULL::INTEGER AS turn, NULL::BIGINT AS person_id, NULL::BIGINT AS id FROM bare UNION ALL SELECT source, target, kind, evidence, turn, person_id, id FROM hidden),
ends AS (SELECT CASE WHEN kind IN ({', '.join(repr(k) for k in ops.SYMMETRIC)}) THEN least(source, target) ELSE source END AS source, CASE WHEN kind IN ({', '.join(repr(k) for k in ops.SYMMETRIC)}) THEN greatest(source, target) ELSE target END AS target, kind, evidence, turn, person_id, id FROM every WHERE source <> target)
SELECT source, target, kind, evidence::VARCHAR AS evidence FROM ends QUALIFY row_number() OVER (PARTITION BY source, target, kind ORDER BY evidence IS NULL, turn, person_id, id) = 1""")
def network_edges(spark, sf_dir):
    """Edges of all six passes with canonical ends and typed evidence."""
    return ops.Network(*inputs(spark, sf_dir)).edges()
