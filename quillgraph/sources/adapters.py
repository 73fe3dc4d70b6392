"""Domain tables as views of the driver's tables; each has a DataFrame function and a SQL twin.

``CTES`` holds the DuckDB text of every adapter, so that an oracle can start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.stored import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of prospects: the user is the prospect, the event type the kind of signal."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("prospect_id"),
        F.col("event_type").alias("signal_type"),
        F.col("value").cast("string").alias("value"),
        F.lit(1.0).alias("weight"),
        ((F.col("event_id") % 10 + 1) / 10).alias("confidence"),
        F.col("ts").alias("collected_at"),
        "props",
    )


#: Sub-score weights of the five kinds of signal.
SIGNAL_WEIGHTS = [
    ("signup", 0.5, 0.2, 0.3),
    ("click", 0.3, 0.1, 0.6),
    ("view", 0.2, 0.3, 0.1),
    ("purchase", 0.6, 0.8, 0.4),
    ("error", 0.1, 0.4, 0.2),
]


def signal_weights(spark: SparkSession) -> DataFrame:
    """Weights of each kind of signal."""
    return spark.createDataFrame(
        SIGNAL_WEIGHTS, "signal_type string, authenticity_weight double, authority_weight double, warmth_weight double"
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons: customers, with the nation as company and the market segment as domain."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("person_id"),
        F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("company_id"),
        F.col("c_mktsegment").alias("domain"),
        (F.floor((F.col("c_acctbal") + 1000) / 220) + 40).cast("int").alias("seniority"),
        (F.col("c_custkey") % 7 == 0).alias("is_ic_track"),
        (F.col("c_custkey") % 3).cast("int").alias("team"),
        F.col("c_acctbal").alias("score"),
    )


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who took part in what: distinct (order, supplier) pairs with the order's year."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pairs = spread(li.select(F.col("l_orderkey").alias("work_id"), F.col("l_suppkey").alias("person_id")), li.count(), "work_id").distinct()
    years = o.select(F.col("o_orderkey").alias("work_id"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"))
    return pairs.join(years, "work_id")


def employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stints: a customer at a part's company from the first to the last year shipped."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .groupBy(F.col("l_partkey").alias("company_id"), F.col("o_custkey").alias("person_id"))
        .agg(
            F.min(F.year("l_shipdate")).alias("start_year"),
            F.max(F.year("l_shipdate")).alias("end_year"),
            F.min("l_returnflag").alias("team"),
            F.min("o_orderpriority").alias("domain"),
            F.max((F.col("o_orderstatus") == "O").cast("int")).cast("boolean").alias("is_current"),
        )
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies: nations, with the region as industry."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company"), F.col("r_name").alias("industry")
    )


def cost_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor calls: orders, with the priority as vendor and the price in cents as cost."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderpriority").alias("vendor"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cost_cents"),
        F.col("o_orderdate").alias("called_at"),
        F.col("o_orderstatus").alias("status"),
    )


#: The first three words of a text.
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
FIRST_WORDS = rf"^[^{_L}]*([{_L}]+)[^{_L}]+([{_L}]+)[^{_L}]+([{_L}]+)"


def first_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, w1, w2, w3) of every document; empty where a text has fewer words."""
    words = [F.coalesce(F.regexp_extract("text", FIRST_WORDS, i), F.lit("")).alias(f"w{i}") for i in (1, 2, 3)]
    return table(spark, sf_dir, "documents").select("doc_id", *words)


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical, kind, alias): institutions named by the first three words of benchmark items, of five kinds; the first two words are an alias."""
    words = [F.regexp_extract("text", FIRST_WORDS, i) for i in (1, 2, 3)]
    kinds = F.array(*map(F.lit, ("mba", "phd", "undergrad", "exec_ed", "other")))
    b = table(spark, sf_dir, "benchmark").select(F.concat_ws(" ", *words).alias("canonical"), F.element_at(kinds, (F.col("item_id") % 5 + 1).cast("int")).alias("kind"), F.concat_ws(" ", *words[:2]).alias("alias"))
    return b.filter("alias <> ' '")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, payload): JSON of six shapes about people named by the first words of documents: flat, with people inside, nested arrays, text in text, broken, odd types."""
    c = table(spark, sf_dir, "customer").join(first_words(spark, sf_dir), F.col("doc_id") == F.floor(F.col("c_custkey") / 3))
    k, name = F.col("c_custkey"), F.concat_ws(" ", "w1", "w2")
    flat = F.concat(F.lit('{"name": "'), name, F.lit('", "title": "'), "c_mktsegment", F.lit('", "company": 5}'))
    inside = F.concat(
        F.lit('{"company": "Co '), k.cast("string"), F.lit('", "people": [{"full_name": "'), name, F.lit('", "role": "'), "c_mktsegment",
        F.lit('"}, {"name": "Acme Inc"}, 7, {"person_name": "'), F.concat_ws(" ", "w2", "w1"), F.lit('", "employer": "Other"}]}'),
    )
    nested = F.concat(F.lit('[{"exec": "'), name, F.lit('"}, [[{"name": "'), F.concat_ws(" ", "w1", "w3"), F.lit('", "job_title": " "}], 3]]'))
    text = F.concat(F.lit('["'), F.replace(flat, F.lit('"'), F.lit('\\"')), F.lit('", "words"]'))
    odd = F.concat(F.lit('{"name": {"x": 1}, "executive_name": "  '), name, F.lit(' ", "leaders": [], "issuer": true, "executives": "none"}'))
    shape = F.when(k % 6 == 0, flat).when(k % 6 == 1, inside).when(k % 6 == 2, nested).when(k % 6 == 3, text).when(k % 6 == 4, F.lit("{broken")).otherwise(odd)
    return c.select(k.alias("id"), shape.alias("payload"))


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, i, a, b, c): a page's capitalised words, three at a time."""
    words = F.regexp_extract_all("html", F.lit("[A-Z][a-z]{2,}"), F.lit(0))
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), words.alias("w"))
    p = p.filter(F.size("w") >= 3).select("page_id", "host", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)).alias("i"))
    return p.select("page_id", "host", "i", *(F.get("w", F.col("i") * 3 + j).alias(n) for j, n in enumerate("abc")))


def _marked(triples: DataFrame, line: Column, top: str) -> DataFrame:
    """(id, body, markdown): the lines of a page under its host, bars between them."""
    listed = F.array_sort(F.collect_list(F.struct("i", line.alias("line"))))
    text = F.array_join(F.transform(listed, lambda s: s["line"]), "\n|\n")
    return triples.groupBy(F.col("page_id").alias("id"), F.col("host").alias("body")).agg(text.alias("t")).select("id", "body", F.concat(F.lit(top), "t").alias("markdown"))


def rosters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body, markdown): committees, members in four spellings, years; the first members have no committee above them."""
    i = F.col("i")
    year = (F.lit(1990) + i % 30).cast("string")
    line = (
        F.when(i % 6 == 0, F.concat(F.lit("- "), F.concat_ws(" ", "a", "b"), F.lit(", "), "c")).when(i % 6 == 1, F.concat(F.concat_ws(" ", "a", "b"), F.lit(" ("), "c", F.lit(" Co)")))
        .when(i % 6 == 2, F.concat(F.lit("## "), F.concat_ws(" ", "a", "b"))).when(i % 6 == 3, F.concat(F.lit("* "), F.concat_ws(" ", "a", "b", "c")))
        .when(i % 6 == 4, F.concat(F.lit("("), year, F.lit(" - 2021) "), F.lower("a"))).otherwise(F.concat(F.lit("- "), F.concat_ws(" ", "a", "b"), F.lit(" — "), "c", F.lit(" since "), year))
    )
    return _marked(_triples(spark, sf_dir), line, "")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, body, markdown): sessions and speakers in four spellings, some with a role."""
    i, name = F.col("i"), F.concat_ws(" ", "a", "b")
    line = (
        F.when(i % 5 == 0, F.concat(F.lit("### "), name)).when(i % 5 == 1, F.concat(F.lit("**Speaker:** "), name, F.lit(" — Keynote "), "c")).when(i % 5 == 2, F.concat(F.lit("12. "), name, F.lit(" ("), "c", F.lit(")")))
        .when(i % 5 == 3, F.concat(F.lit("- "), name, F.lit(", Session chair"))).otherwise(F.concat(F.lit("* "), name, F.lit(" - panel "), "c"))
    )
    return _marked(_triples(spark, sf_dir), line, "")


def person_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of people from three sources: three customers in a row are one person, with spellings, gaps and conflicts."""
    k = F.col("c_custkey")
    p, s = F.floor(k / 3), k % 3
    c = table(spark, sf_dir, "customer").select(k.alias("id"), p.alias("p"), s.alias("s"), "c_mktsegment")
    r = c.join(first_words(spark, sf_dir).hint("merge"), F.col("doc_id") == F.col("p"))
    p, s = F.col("p"), F.col("s")
    ps, last = p.cast("string"), F.concat("w2", F.lower("w3"))
    bent = F.when((s == 1) & (p % 4 == 0), F.concat(F.substring(last, 1, 2), F.substring(last, 4, 1000))).when((s == 2) & (p % 4 == 1), F.col("w1")).otherwise(last)
    return r.select(
        "id",
        F.when(s == 0, 80).when(s == 1, 60).otherwise(20).alias("priority"),
        F.when(s == 0, F.concat(F.lit("https://x.example/in/"), ps)).when((s == 1) & (p % 5 == 0), F.concat(F.lit(" HTTPS://X.example/in/"), ps, F.lit("/")))
        .when((s == 1) & (p % 5 == 1), F.concat(F.lit("https://x.example/in/other"), ps)).alias("url"),
        F.when((p % 13 == 0) & (s < 2), F.concat(F.lit("acc"), ps)).alias("account"),
        F.when((p % 3 == 0) & (s < 2), F.concat(F.when(s == 0, "P").otherwise("p"), ps, F.lit("@mail.example"))).when((p % 6 == 1) & (s > 0), F.concat(F.lit("q"), ps, F.lit("@mail.example")))
        .when(p % 6 == 2, F.lit("none")).alias("email"),
        F.when((p % 9 == 0) & (s > 0), F.concat(F.lit("ref"), ps)).alias("reference"),
        F.when((s == 2) & (p % 4 == 1), last).otherwise(F.col("w1")).alias("first"),
        bent.alias("last"),
        F.when((s < 2) | (p % 11 > 0), F.concat(F.lit("Company "), (p % 7).cast("string"))).alias("company"),
        F.when((s > 0) | (p % 2 > 0), F.col("c_mktsegment")).alias("title"),
    )


def school_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(canonical, alias): schools named by the first three words of the documents, the first two in turn being an alias."""
    return first_words(spark, sf_dir).filter("w3 <> ''").select(F.concat_ws(" ", "w1", "w2", "w3").alias("canonical"), F.concat_ws(" ", "w2", "w1").alias("alias"))


def school_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, name): schools as customers write them: in small letters, with a letter lost, changed or added, or turned round."""
    k, n = F.col("c_custkey"), F.concat_ws(" ", "w1", "w2", "w3")
    c = table(spark, sf_dir, "customer").join(first_words(spark, sf_dir).filter("w3 <> ''").hint("merge"), F.col("doc_id") == F.floor(k / 3))
    bent = (
        F.when(k % 5 == 0, F.lower(n)).when(k % 5 == 1, F.concat(F.substring(n, 1, 3), F.substring(n, 5, 1000))).when(k % 5 == 2, F.concat(F.substring(n, 1, 5), F.lit("x"), F.substring(n, 7, 1000)))
        .when(k % 5 == 3, F.concat(n, F.lit(" x"))).otherwise(F.reverse(n))
    )
    return c.select(k.alias("person_id"), bent.alias("name"))


_weights = ", ".join(f"('{t}', {a}, {b}, {c})" for t, a, b, c in SIGNAL_WEIGHTS)

#: DuckDB text of each adapter.
CTES = {
    "signals": """SELECT event_id AS id, user_id AS prospect_id, event_type AS signal_type, value, 1.0::DOUBLE AS weight,
        (event_id % 10 + 1) / 10.0::DOUBLE AS confidence, ts AS collected_at, props FROM events""",
    "signal_weights": f"""SELECT * FROM (VALUES {_weights}) t(signal_type, authenticity_weight, authority_weight, warmth_weight)""",
    "persons": """SELECT c_custkey AS person_id, c_name AS name, c_nationkey AS company_id, c_mktsegment AS domain,
        (floor((c_acctbal + 1000) / 220) + 40)::INTEGER AS seniority, c_custkey % 7 = 0 AS is_ic_track,
        (c_custkey % 3)::INTEGER AS team, c_acctbal AS score FROM customer""",
    "authorship": """SELECT w.work_id, w.person_id, year(o_orderdate) AS year, o_orderpriority AS venue FROM
        (SELECT DISTINCT l_orderkey AS work_id, l_suppkey AS person_id FROM lineitem) w JOIN orders ON o_orderkey = w.work_id""",
    "employment": """SELECT l_partkey AS company_id, o_custkey AS person_id, min(year(l_shipdate)) AS start_year,
        max(year(l_shipdate)) AS end_year, min(l_returnflag) AS team, min(o_orderpriority) AS domain,
        bool_or(o_orderstatus = 'O') AS is_current FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "companies": """SELECT n_nationkey AS company_id, n_name AS company, r_name AS industry FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "first_words": f"""SELECT doc_id, coalesce(regexp_extract(text, '{FIRST_WORDS}', 1), '') AS w1, coalesce(regexp_extract(text, '{FIRST_WORDS}', 2), '') AS w2,
        coalesce(regexp_extract(text, '{FIRST_WORDS}', 3), '') AS w3 FROM documents""",
    "institutions": f"""SELECT * FROM (SELECT concat_ws(' ', regexp_extract(text, '{FIRST_WORDS}', 1), regexp_extract(text, '{FIRST_WORDS}', 2), regexp_extract(text, '{FIRST_WORDS}', 3)) AS canonical,
        (['mba', 'phd', 'undergrad', 'exec_ed', 'other'])[item_id % 5 + 1] AS kind, concat_ws(' ', regexp_extract(text, '{FIRST_WORDS}', 1), regexp_extract(text, '{FIRST_WORDS}', 2)) AS alias FROM benchmark) WHERE alias <> ' '""",
    "payloads": """SELECT id, CASE id % 6 WHEN 0 THEN flat WHEN 1 THEN '{"company": "Co ' || id || '", "people": [{"full_name": "' || name || '", "role": "' || c_mktsegment || '"}, {"name": "Acme Inc"}, 7, {"person_name": "' || w2 || ' ' || w1 || '", "employer": "Other"}]}'
        WHEN 2 THEN '[{"exec": "' || name || '"}, [[{"name": "' || w1 || ' ' || w3 || '", "job_title": " "}], 3]]' WHEN 3 THEN '["' || replace(flat, '"', '\\"') || '", "words"]' WHEN 4 THEN '{broken'
        ELSE '{"name": {"x": 1}, "executive_name": "  ' || name || ' ", "leaders": [], "issuer": true, "executives": "none"}' END AS payload
        FROM (SELECT *, '{"name": "' || name || '", "title": "' || c_mktsegment || '", "company": 5}' AS flat FROM (SELECT c_custkey AS id, c_mktsegment, w1, w2, w3, w1 || ' ' || w2 AS name FROM customer JOIN first_words ON doc_id = c_custkey // 3))""",
    "triples": """SELECT page_id, host, i, w[i * 3 + 1] AS a, w[i * 3 + 2] AS b, w[i * 3 + 3] AS c FROM (SELECT page_id, host, w, unnest(range(len(w) // 3)) AS i FROM
        (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract_all(html, '[A-Z][a-z]{2,}') AS w FROM pages))""",
    "rosters": """SELECT page_id AS id, host AS body, string_agg(CASE i % 6 WHEN 0 THEN '- ' || a || ' ' || b || ', ' || c WHEN 1 THEN a || ' ' || b || ' (' || c || ' Co)' WHEN 2 THEN '## ' || a || ' ' || b WHEN 3 THEN '* ' || a || ' ' || b || ' ' || c
        WHEN 4 THEN '(' || (1990 + i % 30) || ' - 2021) ' || lower(a) ELSE '- ' || a || ' ' || b || ' — ' || c || ' since ' || (1990 + i % 30) END, chr(10) || '|' || chr(10) ORDER BY i) AS markdown FROM triples GROUP BY 1, 2""",
    "programs": """SELECT page_id AS id, host AS body, string_agg(CASE i % 5 WHEN 0 THEN '### ' || a || ' ' || b WHEN 1 THEN '**Speaker:** ' || a || ' ' || b || ' — Keynote ' || c WHEN 2 THEN '12. ' || a || ' ' || b || ' (' || c || ')'
        WHEN 3 THEN '- ' || a || ' ' || b || ', Session chair' ELSE '* ' || a || ' ' || b || ' - panel ' || c END, chr(10) || '|' || chr(10) ORDER BY i) AS markdown FROM triples GROUP BY 1, 2""",
    "person_records": """SELECT id, CASE s WHEN 0 THEN 80 WHEN 1 THEN 60 ELSE 20 END AS priority,
        CASE WHEN s = 0 THEN 'https://x.example/in/' || p WHEN s = 1 AND p % 5 = 0 THEN ' HTTPS://X.example/in/' || p || '/' WHEN s = 1 AND p % 5 = 1 THEN 'https://x.example/in/other' || p END AS url,
        CASE WHEN p % 13 = 0 AND s < 2 THEN 'acc' || p END AS account,
        CASE WHEN p % 3 = 0 AND s < 2 THEN CASE s WHEN 0 THEN 'P' ELSE 'p' END || p || '@mail.example' WHEN p % 6 = 1 AND s > 0 THEN 'q' || p || '@mail.example' WHEN p % 6 = 2 THEN 'none' END AS email,
        CASE WHEN p % 9 = 0 AND s > 0 THEN 'ref' || p END AS reference, CASE WHEN s = 2 AND p % 4 = 1 THEN w2 || lower(w3) ELSE w1 END AS first,
        CASE WHEN s = 1 AND p % 4 = 0 THEN substr(w2 || lower(w3), 1, 2) || substr(w2 || lower(w3), 4) WHEN s = 2 AND p % 4 = 1 THEN w1 ELSE w2 || lower(w3) END AS last,
        CASE WHEN s < 2 OR p % 11 > 0 THEN 'Company ' || (p % 7) END AS company, CASE WHEN s > 0 OR p % 2 > 0 THEN c_mktsegment END AS title
        FROM (SELECT c_custkey AS id, c_custkey // 3 AS p, c_custkey % 3 AS s, c_mktsegment FROM customer) JOIN first_words ON doc_id = p""",
    "school_aliases": """SELECT w1 || ' ' || w2 || ' ' || w3 AS canonical, w2 || ' ' || w1 AS alias FROM first_words WHERE w3 <> ''""",
    "school_names": """SELECT person_id, CASE person_id % 5 WHEN 0 THEN lower(n) WHEN 1 THEN substr(n, 1, 3) || substr(n, 5) WHEN 2 THEN substr(n, 1, 5) || 'x' || substr(n, 7) WHEN 3 THEN n || ' x' ELSE reverse(n) END AS name
        FROM (SELECT c_custkey AS person_id, w1 || ' ' || w2 || ' ' || w3 AS n FROM customer JOIN first_words ON doc_id = c_custkey // 3 WHERE w3 <> '')""",
    "cost_log": """SELECT o_orderkey AS call_id, o_custkey AS account_id, o_orderpriority AS vendor,
        round(o_totalprice * 100)::BIGINT AS cost_cents, o_orderdate AS called_at, o_orderstatus AS status FROM orders""",
}


def with_ctes(*names: str) -> str:
    """``WITH`` clause of the named adapters (and a trailing comma-free end)."""
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names)
