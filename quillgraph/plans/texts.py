"""Text and entity-resolution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import scoring as fs
from quillgraph.functions import contacts as fc
from quillgraph.functions import texts as ft
from quillgraph.sources import adapters as src

from .registry import query

#: Titles, names, degrees and the like, dealt to customers by key.
TITLES = [
    "CEO", "Senior Vice President, Sales", "VP Engineering", "Director of Research", "Principal Engineer", "Chief Marketing Officer", "Staff Engineer",
    "Engineering Manager", "Senior Software Engineer", "Head of Talent", "Fab Operations Lead", "Software Developer", "Chairman of the Board", "Product Manager",
    "Distinguished Engineer", "General Counsel", "Member of Technical Staff", "Group VP", "Florist", "", "Analog Designer", "Co-founder", "Chief of Staff", "ASIC Verification Engineer",
]
NAMES = ["Dr. Oskar T. Lindqvist, Jr.", "Marisol V. Tessaly", "Quon Arbel", "Zephyrine", "Prof. Ilse K. Brandvold PhD", "Mr. Tomas  Vargo III", "Ines de Mourel", "  Pip Hallow  "]
COMPANIES = ["Brightwater Looms Corporation", "Kestrelby Inc", "An Ordinary Workshop Co", "Tallgrass Mills, Ltd.", "Nordhafener Werft AG", "Plainfold", "Quarzbach GmbH"]
DEGREES = ["MBA", "Ph.D in Physics", "Executive Education Certificate", "BSc Chemistry", "Doctorate", "Master of Business"]
YEARS = ["2009-2014", "2011-present", "1987", "every spring", "from 1999 to 2003"]
HEADLINES = ["Tallgrass Mills reports first quarter results", "Kestrelby partners with Plainfold", "Quarzbach unveils a loom", "Paper accepted at a workshop", "Brightwater names a treasurer", "Rain expected"]

def _dealt(values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values)).cast("int") + 1)


def _sql_dealt(values: list[str]) -> str:
    return "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[c_custkey % {len(values)} + 1]"


def _sql_rules(rules, text: str, default: str = "NULL") -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    whens = " ".join("WHEN regexp_matches({}, '(?i){}') THEN {}".format(text, p.replace("'", "''"), quoted(v)) for p, v in rules)
    return f"CASE WHEN {text} = '' THEN {default} {whens} ELSE {default} END"


def _customers(spark, sf_dir):
    return src.table(spark, sf_dir, "customer")


#: What the rules give for each title, written out by hand: domain, seniority, individual track, manager's title.
TITLES_TOLD = [
    ("general_management", 100, 0, 0), ("general_management", 95, 0, 0), ("hardware_engineering", 70, 0, 1), ("research", 60, 0, 1), ("hardware_engineering", 48, 1, 0), ("sales_marketing", 88, 0, 0), ("hardware_engineering", 45, 1, 0),
    ("hardware_engineering", 50, 0, 1), ("software_engineering", 40, 0, 0), ("people_ops", 65, 0, 1), ("manufacturing_ops", -1, 0, 1), ("software_engineering", 35, 0, 0), ("none", 95, 0, 0), ("product_management", 50, 0, 1),
    ("hardware_engineering", 55, 1, 0), ("finance_legal", -1, 0, 0), ("software_engineering", 40, 0, 0), ("none", 72, 0, 1), ("none", -1, 0, 0), ("none", -1, 0, 0), ("hardware_engineering", 35, 0, 0), ("general_management", -1, 0, 0), ("general_management", -1, 0, 0), ("hardware_engineering", 35, 0, 0),
]


def _sql_told(rows: list[tuple], names: list[str], key: str = "c_custkey") -> str:
    """Rows written out by hand, dealt to customers by key."""
    value = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return ", ".join(f"([{', '.join(value(r[i]) for r in rows)}])[{key} % {len(rows)} + 1] AS {n}" for i, n in enumerate(names))


@query("title_classification", f"SELECT c_custkey, {_sql_told(TITLES_TOLD, ['domain', 'seniority', 'is_ic', 'is_manager'])} FROM customer")
def title_classification(spark, sf_dir):
    """domain, seniority and track of a title."""
    t = _dealt(TITLES)
    rows = _customers(spark, sf_dir).select("c_custkey", t.alias("title"))
    t = F.col("title")
    return rows.select("c_custkey", ft.domain_from_title(t).alias("domain"), ft.seniority_from_title(t).alias("seniority"), ft.is_ic_track(t).cast("int").alias("is_ic"), ft.is_manager_title(t).cast("int").alias("is_manager")).fillna(-1, ["seniority"]).fillna("none", ["domain"])


@query("seniority_tiers", "SELECT c_custkey, CASE WHEN s >= 85 THEN 'c_suite' WHEN s >= 75 THEN 'svp' WHEN s >= 65 THEN 'vp' WHEN s >= 55 THEN 'director' ELSE 'manager' END AS tier FROM (SELECT c_custkey, c_custkey % 101 AS s FROM customer)")
def seniority_tiers(spark, sf_dir):
    """tier of a seniority score."""
    return _customers(spark, sf_dir).select("c_custkey", fs.seniority_tier(F.col("c_custkey") % 101).alias("tier"))


@query("company_names", "SELECT c_custkey, " + _sql_told([(x,) for x in ("Brightwater Looms", "Kestrelby", "An Ordinary Workshop", "Tallgrass Mills", "Nordhafener Werft", "Plainfold", "Quarzbach")], ["company"]) + " FROM customer")
def company_names(spark, sf_dir):
    """F8: company names without legal suffixes."""
    return _customers(spark, sf_dir).select("c_custkey", ft.company_name(_dealt(COMPANIES)).alias("company"))


@query("degree_kinds", "SELECT c_custkey, " + _sql_told([(f"same_{x}",) if x != "executive_education" else (x,) for x in ("mba_cohort", "phd_program", "executive_education", "undergrad_cohort", "phd_program", "mba_cohort")], ["kind"]) + " FROM customer")
def degree_kinds(spark, sf_dir):
    """kind of cohort of a degree."""
    return _customers(spark, sf_dir).select("c_custkey", ft.degree_kind(_dealt(DEGREES)).alias("kind"))


@query("name_parts", "SELECT c_custkey, " + _sql_told([("Oskar", "Lindqvist"), ("Marisol", "Tessaly"), ("Quon", "Arbel"), ("", ""), ("Ilse", "Brandvold"), ("Tomas", "Vargo"), ("Ines", "Mourel"), ("Pip", "Hallow")], ["first", "last"]) + " FROM customer")
def name_parts(spark, sf_dir):
    """first and last name."""
    return _customers(spark, sf_dir).select("c_custkey", ft.name_parts(_dealt(NAMES)).alias("n")).select("c_custkey", "n.first", "n.last")


@query("year_ranges", "SELECT c_custkey, " + _sql_told([(2009, 2014), (2011, 0), (1987, 0), (0, 0), (1999, 2003)], ["start_year", "end_year"]) + " FROM customer")
def year_ranges(spark, sf_dir):
    """Years out of free text (0: none)."""
    return _customers(spark, sf_dir).select("c_custkey", ft.year_range(_dealt(YEARS)).alias("y")).select("c_custkey", F.coalesce("y.start", F.lit(0)).alias("start_year"), F.coalesce("y.end", F.lit(0)).alias("end_year"))


@query("press_categories", "SELECT c_custkey, " + _sql_told([(x,) for x in ("earnings", "partnership", "product_launch", "research", "other", "other")], ["category"]) + " FROM customer")
def press_categories(spark, sf_dir):
    """category of a press headline."""
    return _customers(spark, sf_dir).select("c_custkey", ft.first_hit(F.lower(_dealt(HEADLINES)), ft.PRESS_RULES, "other").alias("category"))


@query("slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def slugs(spark, sf_dir):
    """URL slugs."""
    return src.table(spark, sf_dir, "part").select("p_partkey", ft.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query("page_hosts", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/]+)', 1)) AS host, length(html) AS chars FROM pages")
def page_hosts(spark, sf_dir):
    """host of each page."""
    return src.table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract("url", r"^https?://([^/]+)", 1)).alias("host"), F.length("html").cast("long").alias("chars"))


@query("merged_people", """WITH r AS (SELECT c_custkey AS id, 80 AS priority, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS title FROM customer
UNION ALL SELECT s_suppkey, 60, s_name, 'supplier' FROM supplier UNION ALL SELECT o_custkey, 40, NULL, min(o_orderpriority) FROM orders GROUP BY 1)
SELECT id, arg_max(name, priority) FILTER (name IS NOT NULL) AS name, arg_max(title, priority) FILTER (title IS NOT NULL) AS title, count(*) AS sources FROM r GROUP BY 1""")
def merged_people(spark, sf_dir):
    """Entity resolution: fields of one person from the source of highest priority that has them."""
    c, s, o = (src.table(spark, sf_dir, t) for t in ("customer", "supplier", "orders"))
    rows = c.select(F.col("c_custkey").alias("id"), F.lit(80).alias("priority"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("title"))
    rows = rows.unionByName(s.select(F.col("s_suppkey").alias("id"), F.lit(60).alias("priority"), F.col("s_name").alias("name"), F.lit("supplier").alias("title")))
    rows = rows.unionByName(o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("title")).select("id", F.lit(40).alias("priority"), F.lit(None).cast("string").alias("name"), "title"))
    best = lambda col: F.max_by(col, F.when(F.col(col).isNotNull(), F.col("priority"))).alias(col)
    return rows.groupBy("id").agg(best("name"), best("title"), F.count("*").alias("sources"))


@query("reporting_phrases", "SELECT conv_id, turn, len(regexp_extract_all(text, '(?i)report(?:s|ing)? to ([a-z]+)', 1))::INTEGER AS n FROM conversations")
def reporting_phrases(spark, sf_dir):
    """How often a turn says whom someone reports to."""
    hits = F.regexp_extract_all("text", F.lit("(?i)report(?:s|ing)? to ([a-z]+)"), F.lit(1))
    return src.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(hits).alias("n"))


@query("roster_rows", """WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(len(string_split(html, chr(10))))) AS i FROM pages),
h AS (SELECT *, CASE WHEN regexp_matches(line, '<h[1-6]') THEN i END AS head FROM l), f AS (SELECT *, max(head) OVER (PARTITION BY page_id ORDER BY i) AS section FROM h)
SELECT page_id, coalesce(section, -1)::INTEGER AS section, count(*) AS lines FROM f WHERE head IS NULL GROUP BY 1, 2""")
def roster_rows(spark, sf_dir):
    """Lines of a page under the nearest header before them: lines are exploded, headers carried on by a window."""
    lines = F.split("html", "\n")
    p = src.table(spark, sf_dir, "pages").select("page_id", lines.alias("ls"))
    heads = F.transform("ls", lambda x, i: F.when(x.rlike("<h[1-6]"), i))
    from pyspark.sql import Window as W

    rows = p.select("page_id", F.posexplode(heads).alias("i", "head"))
    section = F.max("head").over(W.partitionBy("page_id").orderBy("i"))
    return rows.withColumn("section", F.coalesce(section, F.lit(-1))).filter("head IS NULL").groupBy("page_id", "section").agg(F.count("*").alias("lines"))


EMAILS = ["Ada+x@Mail.Tallgrass.com ", "bo@dept.plainfold.co.uk", "cy@gmail.com", "no mail", "dee@host", "eli@QUARZBACH.de"]
#: Domains and slugs of these addresses, written out by hand.
EMAILS_TOLD = [("ada+x@mail.tallgrass.com", "tallgrass.com", "tallgrass"), ("bo@dept.plainfold.co.uk", "plainfold.co.uk", "plainfold"), ("cy@gmail.com", "", ""), ("", "", ""), ("dee@host", "", ""), ("eli@quarzbach.de", "quarzbach.de", "quarzbach")]


@query("account_addresses", f"SELECT c_custkey, {_sql_told(EMAILS_TOLD, ['email', 'domain', 'slug'])} FROM customer")
def account_addresses(spark, sf_dir):
    """keys, registered domains and likely slugs of work addresses."""
    email = _dealt(EMAILS)
    told = lambda c: F.coalesce(c, F.lit(""))
    domain = fc.email_domain(email)
    return _customers(spark, sf_dir).select("c_custkey", told(fc.email_key(email)).alias("email"), told(domain).alias("domain"), told(fc.domain_slug(domain)).alias("slug"))


@query("page_keys", "SELECT page_id, regexp_replace(lower(trim(url)), '/+$', '') AS key, coalesce(nullif(split_part(regexp_replace(lower(trim(url)), '/+$', ''), '/', 1), ''), '') AS slug FROM pages")
def page_keys(spark, sf_dir):
    """keys of pages, with blanks and slashes at their ends, and the first part where none follows ``/company/``."""
    url = F.concat(F.lit(" "), "url", F.lit("// "))
    return src.table(spark, sf_dir, "pages").select("page_id", fc.url_key(url).alias("key"), F.coalesce(fc.company_page_slug(url), F.lit("")).alias("slug"))


_PRESS = ['{"headline": "Kestrelby unveils a loom"}', '{"headline": "Mill names two", "mentioned_executives": ["A", {"name": "B"}]}', '{"headline": "Mill names one", "mentioned_executives": ["A", {"name": " "}, 7]}', '{"mentioned_executives": "A, B"}', "["]


@query("press_kinds", "SELECT c_custkey, " + _sql_told([(x,) for x in ("product_launch", "co_mention_signal", "general", "general", "general")], ["kind"]) + " FROM customer")
def press_kinds(spark, sf_dir):
    """press payloads by headline, else by the number of named executives."""
    return _customers(spark, sf_dir).select("c_custkey", ft.press_kind(_dealt(_PRESS)).alias("kind"))


_TRADES = ["Defense and Aerospace", "Aerospace", "Wool", "Chipmaking", "Research"]


@query("company_tiers", "SELECT c_custkey, " + _sql_told([(x,) for x in ("defense", "aerospace", "other", "semiconductor", "research_lab")], ["tier"]) + " FROM customer")
def company_tiers(spark, sf_dir):
    """Tiers by the words of an industry."""
    return _customers(spark, sf_dir).select("c_custkey", ft.company_tier(_dealt(_TRADES), F.col("c_custkey").cast("string")).alias("tier"))
