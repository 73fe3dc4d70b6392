"""Normalisers and phrase rules, each over texts dealt to customers by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import texts as ft

from .registry import query
from .texts import TITLES, _customers, _dealt, _sql_dealt, _sql_told

FIRMS = ["Brightwater Technologies, Inc.", "Kestrelby Systems Ltd", "Plainfold", "Quarzbach Semiconductor (North) LLC", "Tallgrass & Daughters"]
ROLES = ["Head of Looms at Brightwater", "Weaver | Dyer", "Co-founder — Kestrelby", "Senior Associate Director of Thread Quality", "  Buyer,  Wool. ", "", "Dyer - nights"]
EVENTS = ["Loom Summit 2021", "WoolCon, 1998 - Basel", "Fibre Days", "2035 Weavers", "Thread   Forum 2019!!"]
POSTINGS = [
    "The dyer reports directly to the Mill Director, who is in Basel. There is a dotted line to Anna Vell.",
    "Reporting line to Head of Looms. Reporting line to head of looms. You will work closely with Otto Brand, the Director.",
    "An indirect report to Chief Weaver, in a management chain up to the VP of Fibres.",
    "Nothing is said of managers.",
]
CONFIDENCES = ["0.7", "1.4", "-2", "high", "", "1e-1"]
SPEAKERS = ["Keynote", " panelist ", "attendee", "host", "speaker"]


#: What the earlier rules give for each title, written out by hand.
EARLIER_TOLD = [
    ("none", 100), ("sales_marketing", 80), ("none", 70), ("research", 60), ("none", 48), ("sales_marketing", -1), ("none", 45), ("none", 50), ("software_engineering", 40), ("none", -1), ("manufacturing_ops", -1), ("software_engineering", -1),
    ("none", -1), ("product_management", 50), ("none", 55), ("none", -1), ("none", -1), ("none", 72), ("none", -1), ("none", -1), ("hardware_engineering", -1), ("none", -1), ("none", -1), ("hardware_engineering", 35),
]


@query("earlier_titles", f"SELECT c_custkey, {_sql_told(EARLIER_TOLD, ['domain', 'seniority'])} FROM customer")
def earlier_titles(spark, sf_dir):
    """domain and seniority by the earlier rules."""
    t = F.col("title")
    found = _customers(spark, sf_dir).select("c_custkey", _dealt(TITLES).alias("title"))
    return found.select("c_custkey", F.coalesce(ft.first_hit(t, ft.EARLIER_DOMAIN_RULES), F.lit("none")).alias("domain"), F.coalesce(ft.first_hit(t, ft.EARLIER_SENIORITY_RULES).cast("int"), F.lit(-1)).alias("seniority"))


@query("company_keys", "SELECT c_custkey, " + _sql_told([(x,) for x in ("brightwater", "kestrelby", "plainfold", "quarzbach north", "tallgrass daughters")], ["company"]) + " FROM customer")
def company_keys(spark, sf_dir):
    """F8: the key under which names of one company meet."""
    return _customers(spark, sf_dir).select("c_custkey", ft.company_key(_dealt(FIRMS)).alias("company"))


@query("role_texts", "SELECT c_custkey, " + _sql_told([(x,) for x in ("Head of Looms", "Weaver", "Co-founder", "Senior Associate Director o…", "Buyer, Wool", "", "Dyer")], ["role"]) + " FROM customer")
def role_texts(spark, sf_dir):
    """short roles."""
    return _customers(spark, sf_dir).select("c_custkey", ft.role_text(_dealt(ROLES)).alias("role"))


@query("event_names", "SELECT c_custkey, " + _sql_told([("loom summit", 2021), ("woolcon, - basel", 1998), ("fibre days", 0), ("weavers", 0), ("thread forum", 2019)], ["event", "year"]) + " FROM customer")
def event_names(spark, sf_dir):
    """F16: event names without years, and the year (0: none or out of range)."""
    e = _dealt(EVENTS)
    return _customers(spark, sf_dir).select("c_custkey", ft.event_name(e).alias("event"), F.coalesce(ft.event_year(e), F.lit(0)).alias("year"))


#: Titles named in each posting with the confidence of the phrase, written out by hand.
POSTINGS_TOLD = [(0, 0.88, "Mill Director"), (0, 0.70, "Anna Vell"), (1, 0.85, "Head of Looms"), (1, 0.75, "Otto Brand"), (2, 0.82, "Chief Weaver"), (2, 0.65, "Fibres")]


@query("reporting_signals", "SELECT c_custkey, confidence, manager_title FROM customer JOIN (VALUES " + ", ".join(f"({i}, {c}::DOUBLE, '{t}')" for i, c, t in POSTINGS_TOLD) + ") t(i, confidence, manager_title) ON c_custkey % 4 = i")
def reporting_signals(spark, sf_dir):
    """managers' titles named in job texts by six phrases, each once a confidence without case, in its first spelling."""
    def told(n: int, pattern: str, confidence: float):
        hits = F.regexp_extract_all("t", F.lit(f"(?i){pattern}"), F.lit(1))
        return F.transform(hits, lambda m, i: F.struct((F.lit(n * 1_000_000) + i).alias("place"), F.lit(confidence).alias("confidence"), F.trim(m).alias("title")))

    hits = [told(n, p, c) for n, (p, c) in enumerate(ft.REPORTING_RULES)]
    found = _customers(spark, sf_dir).select("c_custkey", _dealt(POSTINGS).alias("t")).select("c_custkey", F.explode(F.concat(*hits)).alias("m")).filter("m.title <> ''")
    one = found.groupBy("c_custkey", "m.confidence", F.lower("m.title").alias("k")).agg(F.min_by("m.title", "m.place").alias("manager_title"))
    return one.select("c_custkey", "confidence", "manager_title")


@query("clamped_confidences", "SELECT c_custkey, " + _sql_told([("0.7",), ("1",), ("0",), ("0",), ("0",), ("0.1",)], ["c"]).replace(" AS c", "::DOUBLE AS confidence") + " FROM customer")
def clamped_confidences(spark, sf_dir):
    """F32: numbers out of text, between 0 and 1."""
    return _customers(spark, sf_dir).select("c_custkey", ft.clamped(_dealt(CONFIDENCES)).alias("confidence"))


@query("appearance_kinds", f"""WITH r AS (SELECT a.c_custkey % 5 AS k, lower(trim(x)) AS a, lower(trim(y)) AS b, a.c_custkey FROM (SELECT c_custkey, {_sql_dealt(SPEAKERS)} AS x, {_sql_dealt(SPEAKERS[::-1][:4])} AS y FROM customer) a)
SELECT c_custkey, CASE WHEN a IN ('presenter', 'panelist', 'session_chair', 'keynote', 'speaker') AND b IN ('presenter', 'panelist', 'session_chair', 'keynote', 'speaker') THEN 'conference_co_presenter' ELSE 'conference_co_attendee' END AS kind FROM r""")
def appearance_kinds(spark, sf_dir):
    """kind of link between two roles at one event."""
    return _customers(spark, sf_dir).select("c_custkey", ft.appearance_kind(_dealt(SPEAKERS), _dealt(SPEAKERS[::-1][:4])).alias("kind"))


_UNTOLD = [title for title, (domain, _) in zip(TITLES, EARLIER_TOLD, strict=True) if domain == "none" and title]


@query("unclassified_titles", f"SELECT title, count(*) AS people FROM (SELECT {_sql_dealt(TITLES)} AS title FROM customer) WHERE title IN ({', '.join(repr(t) for t in _UNTOLD)}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def unclassified_titles(spark, sf_dir):
    """The five titles that most people without a domain have."""
    t = _customers(spark, sf_dir).select(_dealt(TITLES).alias("title")).filter("title <> ''")
    left = t.filter(ft.first_hit(F.col("title"), ft.EARLIER_DOMAIN_RULES).isNull())
    return left.groupBy("title").agg(F.count("*").alias("people")).orderBy(F.desc("people"), "title").limit(5)
