"""Queries that find connections: co-occurrence and overlap joins, edge merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions.scoring import STRENGTHS
from quillgraph.operators import pairs as ops
from quillgraph.operators.stored import spread
from quillgraph.sources import adapters as src

from .registry import query

AS_OF = 2026
_PAIR = "SELECT x.work_id, x.person_id AS a, y.person_id AS b, x.year, x.venue FROM authorship x JOIN authorship y ON x.work_id = y.work_id AND x.person_id < y.person_id"


def paper_pairs(spark, sf_dir):
    """Co-authors: pairs of persons of one work."""
    key = ["work_id", "year", "venue"]
    return ops.co_occurrence(spread(src.authorship(spark, sf_dir), _rows(spark, sf_dir), *key), key, "person_id")


def _rows(spark, sf_dir):
    return src.table(spark, sf_dir, "lineitem").count()


@query("co_author_pairs", f"{src.with_ctes('authorship')} SELECT work_id, a, b, year FROM ({_PAIR})")
def co_author_pairs(spark, sf_dir):
    """Co-author self-join."""
    return paper_pairs(spark, sf_dir).select("work_id", "a", "b", "year")


@query(
    "co_inventor_pairs",
    """WITH inv AS (SELECT DISTINCT l_orderkey AS patent_id, l_suppkey AS person_id FROM lineitem WHERE l_returnflag <> 'R'),
dates AS (SELECT o_orderkey AS patent_id, CASE WHEN o_orderstatus = 'F' THEN year(o_orderdate) END AS granted, CASE WHEN o_orderstatus = 'O' THEN year(o_orderdate) END AS filed FROM orders)
SELECT x.patent_id, x.person_id AS a, y.person_id AS b, coalesce(granted, filed, 2026) AS year FROM inv x JOIN inv y ON x.patent_id = y.patent_id AND x.person_id < y.person_id
JOIN dates d ON d.patent_id = x.patent_id""",
)
def co_inventor_pairs(spark, sf_dir):
    """Co-inventors; the year is that of the grant, else of the filing, else the current one."""
    li, o = src.table(spark, sf_dir, "lineitem"), src.table(spark, sf_dir, "orders")
    inv = li.filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("patent_id"), F.col("l_suppkey").alias("person_id")).distinct()
    y = F.year("o_orderdate")
    status = F.col("o_orderstatus")
    dates = o.select(F.col("o_orderkey").alias("patent_id"), F.coalesce(F.when(status == "F", y), F.when(status == "O", y), F.lit(AS_OF)).alias("year"))
    return ops.co_occurrence(inv, ["patent_id"], "person_id").join(dates, "patent_id").select("patent_id", "a", "b", "year")


@query(
    "career_overlap_pairs",
    f"""{src.with_ctes('employment')} SELECT x.company_id, x.person_id AS a, y.person_id AS b, least(x.end_year, y.end_year) - greatest(x.start_year, y.start_year) AS overlap_years,
CASE WHEN x.team = y.team THEN 'career_overlap_same_team' WHEN x.domain = y.domain THEN 'career_overlap_same_domain' ELSE 'career_overlap_general' END AS type
FROM employment x JOIN employment y ON x.company_id = y.company_id AND x.person_id < y.person_id
WHERE NOT (x.is_current AND y.is_current) AND least(x.end_year, y.end_year) - greatest(x.start_year, y.start_year) >= 1""",
)
def career_overlap_pairs(spark, sf_dir):
    """Overlapping stints at one company, not both current, with the kind of overlap."""
    e = src.employment(spark, sf_dir)
    p = ops.interval_overlap_pairs(e, ["company_id"], "person_id", "start_year", F.col("end_year"), AS_OF, ["team", "domain", "is_current"])
    kind = ops.overlap_type(F.col("team_a"), F.col("team_b"), F.col("domain_a"), F.col("domain_b"), F.lit(0))
    return p.filter("NOT (is_current_a AND is_current_b)").select("company_id", "a", "b", "overlap_years", kind.alias("type"))


_TIER = """CASE type WHEN 'career_overlap_same_team' THEN least(0.92, 0.70 + 0.03 * overlap_years)
 WHEN 'career_overlap_same_domain' THEN least(0.80, 0.55 + 0.03 * overlap_years) ELSE least(0.70, 0.40 + 0.04 * overlap_years) END"""


@query(
    "person_overlap_top",
    f"""{src.with_ctes('employment')}, p AS (SELECT x.company_id, x.person_id AS a, y.person_id AS b, least(x.end_year, y.end_year) - greatest(x.start_year, y.start_year) AS overlap_years,
CASE WHEN x.team = y.team THEN 'career_overlap_same_team' WHEN x.domain = y.domain THEN 'career_overlap_same_domain' ELSE 'career_overlap_general' END AS type
FROM employment x JOIN employment y ON x.company_id = y.company_id AND x.person_id < y.person_id
WHERE least(x.end_year, y.end_year) - greatest(x.start_year, y.start_year) >= 1)
SELECT company_id, a, b, type, round({_TIER}, 6) AS strength FROM p ORDER BY strength DESC, company_id, a, b LIMIT 50""",
)
def person_overlap_top(spark, sf_dir):
    """Strongest overlaps by the tiered strength (top 50)."""
    e = src.employment(spark, sf_dir)
    p = ops.interval_overlap_pairs(e, ["company_id"], "person_id", "start_year", F.col("end_year"), AS_OF, ["team", "domain"])
    kind = ops.overlap_type(F.col("team_a"), F.col("team_b"), F.col("domain_a"), F.col("domain_b"), F.lit(0))
    y = F.col("overlap_years")
    tier = (
        F.when(F.col("type") == "career_overlap_same_team", F.least(F.lit(0.92), 0.70 + 0.03 * y))
        .when(F.col("type") == "career_overlap_same_domain", F.least(F.lit(0.80), 0.55 + 0.03 * y))
        .otherwise(F.least(F.lit(0.70), 0.40 + 0.04 * y))
    )
    rows = p.withColumn("type", kind).select("company_id", "a", "b", "type", F.round(tier, 6).alias("strength"))
    return rows.orderBy(F.desc("strength"), "company_id", "a", "b").limit(50)


@query(
    "education_cohorts",
    """WITH edu AS (SELECT l_partkey AS school, l_suppkey AS person_id, min(year(l_shipdate)) AS s, max(CASE WHEN l_returnflag = 'A' THEN year(l_shipdate) END) AS e, min(l_returnflag) AS degree FROM lineitem GROUP BY 1, 2)
SELECT x.school, x.person_id AS a, y.person_id AS b, CASE x.degree WHEN 'A' THEN 'same_mba_cohort' WHEN 'N' THEN 'same_phd_program' ELSE 'same_undergrad_cohort' END AS type
FROM edu x JOIN edu y ON x.school = y.school AND x.person_id < y.person_id
WHERE least(coalesce(x.e, x.s + 4), coalesce(y.e, y.s + 4)) - greatest(x.s, y.s) >= 0""",
)
def education_cohorts(spark, sf_dir):
    """Overlapping studies at one school; an open end is four years after the start; the type follows the smaller id's degree."""
    li = src.table(spark, sf_dir, "lineitem")
    edu = li.groupBy(F.col("l_partkey").alias("school"), F.col("l_suppkey").alias("person_id")).agg(
        F.min(F.year("l_shipdate")).alias("s"), F.max(F.when(F.col("l_returnflag") == "A", F.year("l_shipdate"))).alias("e"), F.min("l_returnflag").alias("degree")
    )
    p = ops.interval_overlap_pairs(edu, ["school"], "person_id", "s", F.coalesce(F.col("e"), F.col("s") + 4), AS_OF, ["degree"], least=0)
    kind = F.when(F.col("degree_a") == "A", "same_mba_cohort").when(F.col("degree_a") == "N", "same_phd_program").otherwise("same_undergrad_cohort")
    return p.select("school", "a", "b", kind.alias("type"))


@query(
    "conference_pairs",
    """WITH att AS (SELECT DISTINCT l_orderkey AS event_id, year(l_shipdate) AS year, l_suppkey AS person_id FROM lineitem WHERE l_returnflag IN ('A', 'N'))
SELECT x.event_id, x.year, x.person_id AS a, y.person_id AS b FROM att x JOIN att y ON x.event_id = y.event_id AND x.year = y.year AND x.person_id < y.person_id""",
)
def conference_pairs(spark, sf_dir):
    """Speakers of one event and year; roles are filtered before the join."""
    li = src.table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag").isin("A", "N"))
    att = li.select(F.col("l_orderkey").alias("event_id"), F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("person_id")).distinct()
    return ops.co_occurrence(att, ["event_id", "year"], "person_id")


@query(
    "standards_pairs",
    """WITH m AS (SELECT l_orderkey AS org, l_linestatus AS committee, l_suppkey AS person_id, min(year(l_shipdate)) AS s, max(CASE WHEN l_returnflag <> 'R' THEN year(l_shipdate) END) AS e FROM lineitem GROUP BY 1, 2, 3)
SELECT x.org, x.committee, x.person_id AS a, y.person_id AS b, least(coalesce(x.e, 2026), coalesce(y.e, 2026)) - greatest(x.s, y.s) AS overlap_years
FROM m x JOIN m y ON x.org = y.org AND x.committee = y.committee AND x.person_id < y.person_id WHERE least(coalesce(x.e, 2026), coalesce(y.e, 2026)) - greatest(x.s, y.s) >= 1""",
)
def standards_pairs(spark, sf_dir):
    """Overlapping memberships of one committee."""
    li = src.table(spark, sf_dir, "lineitem")
    m = li.groupBy(F.col("l_orderkey").alias("org"), F.col("l_linestatus").alias("committee"), F.col("l_suppkey").alias("person_id")).agg(
        F.min(F.year("l_shipdate")).alias("s"), F.max(F.when(F.col("l_returnflag") != "R", F.year("l_shipdate"))).alias("e")
    )
    return ops.interval_overlap_pairs(m, ["org", "committee"], "person_id", "s", F.col("e"), AS_OF)


@query("pair_buckets", f"{src.with_ctes('authorship')} SELECT a, b, count(*) AS shared FROM ({_PAIR}) GROUP BY a, b")
def pair_buckets(spark, sf_dir):
    """Works shared by each pair."""
    return spread(paper_pairs(spark, sf_dir).select("a", "b"), _rows(spark, sf_dir), "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


_EDGES_SQL = f"""edges AS (SELECT a, b, CASE WHEN n >= 3 THEN 'academic_co_author_multi' ELSE 'academic_co_author_single' END AS type, n AS corroborations, y AS last_active_year,
 least(0.99, CASE WHEN n >= 3 THEN 0.90 ELSE 0.85 END * exp(-0.02 * greatest(0, {AS_OF} - y)) * (1 + 0.15 * ln(n)) * 1.1) AS strength
 FROM (SELECT a, b, count(DISTINCT work_id) AS n, max(year) AS y FROM ({_PAIR}) GROUP BY a, b))"""


def author_edges(spark, sf_dir):
    """Edges between co-authors; the kind follows the final count of shared works."""
    base, decay = F.when(F.col("corroborations") >= 3, 0.90).otherwise(0.85), F.lit(STRENGTHS["academic_co_author_multi"][1])
    pairs = spread(paper_pairs(spark, sf_dir).select("work_id", "a", "b", "year"), _rows(spark, sf_dir), "a", "b")
    edges = ops.merge_edges(pairs, F.lit("academic"), "work_id", "year", base, decay, AS_OF)
    kind = F.when(F.col("corroborations") >= 3, "academic_co_author_multi").otherwise("academic_co_author_single")
    return edges.withColumn("type", kind)


@query("merged_edges", f"{src.with_ctes('authorship')}, {_EDGES_SQL} SELECT a, b, type, corroborations, last_active_year, round(strength, 9) AS strength FROM edges")
def merged_edges(spark, sf_dir):
    """Pairs merged to edges with corroboration and decayed strength."""
    return author_edges(spark, sf_dir).select("a", "b", "type", "corroborations", "last_active_year", F.round("strength", 9).alias("strength"))


@query(
    "co_author_confidence",
    f"""{src.with_ctes('authorship')}, sizes AS (SELECT work_id, count(*) AS n FROM authorship GROUP BY 1)
SELECT p.work_id, a, b, CASE WHEN n <= 5 THEN 0.90 ELSE 0.75 END::DOUBLE AS confidence FROM ({_PAIR}) p JOIN sizes USING (work_id)""",
)
def co_author_confidence(spark, sf_dir):
    """Co-author signals; small author lists are surer."""
    works = src.authorship(spark, sf_dir)
    sizes = works.groupBy("work_id").agg(F.count("*").alias("n"))
    p = ops.co_occurrence(works, ["work_id"], "person_id").join(sizes, "work_id")
    return p.select("work_id", "a", "b", F.when(F.col("n") <= 5, 0.90).otherwise(0.75).alias("confidence"))


@query(
    "career_signals",
    f"""{src.with_ctes('employment')}, first AS (SELECT * FROM employment QUALIFY row_number() OVER (PARTITION BY company_id, person_id ORDER BY start_year, end_year) = 1)
SELECT x.company_id, x.person_id AS a, y.person_id AS b, least(x.end_year, y.end_year) - greatest(x.start_year, y.start_year) AS years
FROM first x JOIN first y ON x.company_id = y.company_id AND x.person_id < y.person_id WHERE least(x.end_year, y.end_year) - greatest(x.start_year, y.start_year) >= 1""",
)
def career_signals(spark, sf_dir):
    """Earliest stint of each person, then overlapping pairs."""
    e = src.employment(spark, sf_dir).groupBy("company_id", "person_id").agg(F.min(F.struct("start_year", "end_year")).alias("m"))
    e = e.select("company_id", "person_id", "m.start_year", "m.end_year")
    return ops.interval_overlap_pairs(e, ["company_id"], "person_id", "start_year", F.col("end_year"), AS_OF).withColumnRenamed("overlap_years", "years")


@query(
    "past_employer_pairs",
    f"""{src.with_ctes('employment')}, past AS (SELECT DISTINCT company_id, person_id FROM employment WHERE NOT is_current)
SELECT x.company_id, x.person_id AS a, y.person_id AS b FROM past x JOIN past y ON x.company_id = y.company_id AND x.person_id < y.person_id""",
)
def past_employer_pairs(spark, sf_dir):
    """Pairs with a past employer in common, current employers excluded."""
    past = src.employment(spark, sf_dir).filter("NOT is_current").select("company_id", "person_id").distinct()
    return ops.co_occurrence(past, ["company_id"], "person_id")


@query(
    "co_mentions",
    """WITH m AS (SELECT DISTINCT conv_id, role FROM conversations WHERE role IS NOT NULL) SELECT x.conv_id, x.role AS a, y.role AS b FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.role < y.role""",
)
def co_mentions(spark, sf_dir):
    """Who is mentioned in one release (a conversation's roles stand for the names)."""
    m = src.table(spark, sf_dir, "conversations").filter("role IS NOT NULL").select("conv_id", "role").distinct()
    return ops.co_occurrence(m, ["conv_id"], "role")


@query(
    "colleague_fan_out",
    f"""{src.with_ctes('persons')}, r AS (SELECT company_id, person_id, row_number() OVER (PARTITION BY company_id ORDER BY person_id) AS rn, count(*) OVER (PARTITION BY company_id) AS n FROM persons)
SELECT x.company_id, x.person_id AS a, y.person_id AS b FROM r x JOIN r y ON x.company_id = y.company_id AND y.rn > x.rn AND (x.n <= 7 OR y.rn - x.rn <= 6)""",
)
def colleague_fan_out(spark, sf_dir):
    """All pairs of small companies; else the next six by position, as joins on the position."""
    from pyspark.sql import Window as W

    p = src.persons(spark, sf_dir).select("company_id", "person_id")
    by = W.partitionBy("company_id")
    r = p.withColumns({"rn": F.row_number().over(by.orderBy("person_id")), "n": F.count("*").over(by)})
    # up to six later positions each, whatever the size: no pair of distant positions is made
    steps = F.explode(F.sequence(F.col("rn") + 1, F.least("n", F.col("rn") + 6)))
    one = r.filter("rn < n").select("company_id", F.col("person_id").alias("a"), steps.alias("rn"))
    return one.join(r.select("company_id", "rn", F.col("person_id").alias("b")), ["company_id", "rn"]).select("company_id", "a", "b")


@query(
    "or_join",
    f"""{src.with_ctes('persons')} SELECT person_id, s_suppkey FROM persons p JOIN supplier s ON p.person_id = s.s_suppkey OR (p.is_ic_track AND p.company_id = s.s_nationkey)""",
)
def or_join(spark, sf_dir):
    """An OR of two equalities as a union of two equi-joins."""
    p, s = src.persons(spark, sf_dir), src.table(spark, sf_dir, "supplier")
    one = p.join(s, p.person_id == s.s_suppkey).select("person_id", "s_suppkey")
    near = ops.blocked_join(p.filter("is_ic_track").select("company_id", "person_id"), s.select(F.col("s_nationkey").alias("company_id"), "s_suppkey"), ["company_id"])
    two = near.filter("person_id <> s_suppkey").select("person_id", "s_suppkey")
    return one.unionByName(two)


@query(
    "shared_company_gate",
    f"""{src.with_ctes('authorship', 'employment')}, c AS (SELECT person_id, list(DISTINCT company_id) AS cs FROM (SELECT l_suppkey AS person_id, l_partkey AS company_id FROM lineitem) GROUP BY 1),
p AS (SELECT DISTINCT a, b FROM ({_PAIR})) SELECT a, b, len(list_intersect(x.cs, y.cs))::INTEGER AS shared FROM p JOIN c x ON x.person_id = a JOIN c y ON y.person_id = b WHERE len(list_intersect(x.cs, y.cs)) > 0""",
)
def shared_company_gate(spark, sf_dir):
    """Author pairs that also share a company, by set intersection."""
    c = src.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("company_id"), F.col("l_suppkey").alias("person_id"))
    return ops.shared_groups(paper_pairs(spark, sf_dir).select("a", "b"), c)
