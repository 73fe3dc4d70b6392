"""What a visitor of the graph sees: the surroundings of nodes, edges told in full, leads, vocabularies; and edges stated outright."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.scoring import STRENGTHS
from quillgraph.functions.texts import canonical_title
from quillgraph.operators.forest import climbed, cycle_members
from quillgraph.operators.network import ROOT_ID, top_structs
from quillgraph.operators.stored import stored

# Kinds of nodes shown without a focus and how many there must be, people shown around a person, score from
# which a person's company is filled up and to how many, sources of edges by their kind (first hit wins), factor and
# ending of an edge to an unknown manager, sizes of the vocabularies.
TOP_KINDS, TOP_LEAST = ["industry", "company", "city", "country"], 10
PEOPLE_SHOWN, HEADLINE_SCORE, HEADLINE_PEOPLE = 40, 75, 12
EDGE_SOURCES = [("^patent", "patent"), ("^academic", "paper"), ("^career_overlap", "career_overlap"), ("^standards", "standards"), ("^conference", "conference"), ("cohort|alumni|^executive_education$|^same_", "cohort")]
UNRESOLVED_FACTOR, UNRESOLVED_ENDING = 0.7, "_unresolved_target"
ROLES_KEPT, KEYWORDS_KEPT = 300, 200


def neighbors(edges: DataFrame) -> DataFrame:
    """(node, neighbor): each edge (source, target) from both ends, once."""
    one = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbor"))
    return one.unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("neighbor"))).distinct()


def focal_subgraphs(nodes: DataFrame, edges: DataFrame, foci: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """(focus, id): the nodes shown around each focus.

    ``nodes`` is (id, kind, score, company); ``edges`` (source, target); ``foci`` one column ``focus``. A focus that isn't
    a node (or is null) shows industries, companies, cities and countries, or all nodes if those are fewer than ten. An industry shows its companies; a
    person 40 people by score, and from a score of 75 on enough of the company to make twelve; anything else all its
    neighbors. The root is always there, and of kinds not in ``kinds`` only the focus. Ties go by id.
    """
    nodes = stored(nodes.select("id", "kind", "score", F.lower(F.trim("company")).alias("company")))
    foci = stored(foci.select("focus").distinct())
    known = foci.join(nodes.select(F.col("id").alias("focus"), F.col("kind").alias("of"), F.col("score").alias("own"), F.col("company").alias("at")), "focus")
    near = known.join(neighbors(edges).select(F.col("node").alias("focus"), F.col("neighbor").alias("id")), "focus").join(nodes, "id").filter("focus <> id")
    near = stored(near.select("focus", "of", "own", "at", "id", "kind", "score"))
    people = near.filter("of = 'person' AND kind = 'person'")
    order = F.struct((-F.coalesce("score", F.lit(-1.0))).alias("weak"), "id")
    best = stored(top_structs(people.select("focus", "at", "own", order.alias("v")), "focus", "v", PEOPLE_SHOWN).select("focus", "at", "own", F.col("v.id").alias("id")))
    rest = near.filter("of = 'industry' AND kind = 'company' OR of NOT IN ('industry', 'person') OR of = 'person' AND kind <> 'person'").select("focus", "id")
    shown = rest.unionByName(best.select("focus", "id")).unionByName(_filled(known, best, nodes))
    around = shown.unionByName(known.select("focus", F.col("focus").alias("id"))).unionByName(known.select("focus", F.lit(ROOT_ID).alias("id"))).distinct()
    around = around.join(nodes.select("id", "kind"), "id").filter(F.col("kind").isin(*kinds) | (F.col("id") == F.col("focus"))).select("focus", "id")
    top = nodes.filter(F.col("kind").isin(TOP_KINDS) | (F.col("id") == ROOT_ID))
    top = top if top.limit(TOP_LEAST).count() == TOP_LEAST else nodes
    lost = foci.join(known.select("focus"), "focus", "left_anti")
    # one copy of the top for each focus that isn't there: joined by a constant, as foci are what a caller asks for
    unknown = lost.withColumn("_one", F.lit(1)).join(top.select("id").withColumn("_one", F.lit(1)), "_one").select("focus", "id")
    return around.unionByName(unknown)


def _filled(known: DataFrame, best: DataFrame, nodes: DataFrame) -> DataFrame:
    """People of the company who fill up a well-known person's surroundings.

    At most eleven of them and the person are there already, so twelve more of the company's best are always enough.
    """
    had = best.groupBy("focus").agg(F.count("*").alias("had"))
    short = known.filter((F.col("of") == "person") & (F.col("own") >= HEADLINE_SCORE)).join(had, "focus", "left")
    short = short.withColumn("need", F.lit(HEADLINE_PEOPLE) - F.coalesce("had", F.lit(0))).filter("need > 0 AND at IS NOT NULL")
    order = F.struct((-F.coalesce("score", F.lit(-1.0))).alias("weak"), "id")
    staff = top_structs(nodes.filter("kind = 'person' AND company IS NOT NULL").select(F.col("company").alias("at"), order.alias("v")), "at", "v", 2 * HEADLINE_PEOPLE)
    more = short.select("focus", "at", "need").join(staff, "at").select("focus", "need", "v.weak", "v.id").filter("focus <> id").join(best.select("focus", "id"), ["focus", "id"], "left_anti")
    more = more.withColumn("r", F.row_number().over(W.partitionBy("focus").orderBy("weak", "id")))
    return more.filter("r <= need").select("focus", "id")


def edge_source(kind: Column) -> Column:
    """Source of an edge by its kind."""
    out = F.lit("unknown")
    for pattern, source in reversed(EDGE_SOURCES):
        out = F.when(kind.rlike(pattern), source).otherwise(out)
    return out


def inspected_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target, kind, evidence) with base strength (0.5 if unknown), source of the evidence (null without) and both ends' names, titles and companies; an end that isn't there goes by its id."""
    base = F.lit(0.5)
    for name, (strength, _) in STRENGTHS.items():
        base = F.when(F.col("kind") == name, strength).otherwise(base)
    e = edges.select(F.concat_ws("|", "source", "target", "kind").alias("edge_id"), "source", "target", "kind", base.alias("base_strength"), F.when(F.col("evidence").isNotNull(), edge_source(F.col("kind"))).alias("source_type"), "evidence")
    for end in ("source", "target"):
        told = nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("title").alias(f"{end}_title"), F.col("company").alias(f"{end}_company"))
        e = e.join(told, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return e


def lead_matches(prospects: DataFrame, name: str = "", company: str = "", roles: Sequence[str] = (), keywords: Sequence[str] = (), industry: str = "", least: float = 2, top: int = 10) -> DataFrame:
    """The ``top`` prospects (id, name, company, role, industry, score) for what is known of a lead, with match_score and blended.

    Name 4, shared part of the role's words 3, company either within the other 2, industry 1, half a point a keyword up to 2;
    0.6 of that and 0.4 of a tenth of the score are the rank, ties by id. Nulls are empty texts, and empty texts lie within any.
    """
    low = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "company", "role", "industry")}
    one = lambda hit, points: F.when(hit, float(points)).otherwise(0.0)
    words = lambda text: F.array_distinct(F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != ""))
    asked = words(F.lit(" ".join(roles).lower()))
    shared = F.size(F.array_intersect(asked, words(low["role"])))
    points = one(low["name"].contains(name.lower()), 4) if name else F.lit(0.0)
    points += 3 * shared / F.greatest(F.lit(1), F.size(asked))
    if company:
        points += one(low["company"].contains(company.lower()) | F.lit(company.lower()).contains(low["company"]), 2)
    points += one(low["industry"].contains(industry.lower()), 1)
    hits = sum((one(low["role"].contains(k.lower()), 0.5) for k in keywords if k), F.lit(0.0))
    scored = prospects.withColumn("points", points + F.least(F.lit(2.0), hits))
    blended = 0.6 * F.col("points") + 0.4 * (F.coalesce("score", F.lit(0.0)) / 10)
    return scored.withColumns({"match_score": F.round("points", 1), "blended": blended}).filter(F.col("match_score") >= least).drop("points").orderBy(F.desc("blended"), "id").limit(top)


def vocabularies(prospects: DataFrame, signals: DataFrame, seeds: Sequence[str]) -> DataFrame:
    """(vocabulary, value, place) to suggest from: the 300 most common titles, all companies (no place), seeds and the 200 most common tokens.

    ``signals`` is (type, value) with JSON texts; tokens are those texts in a list ``tokens`` of type tech_stack that have 2 to 40 characters. Ties go by value.
    """
    def most(values: DataFrame, n: int) -> DataFrame:
        kept = values.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)  # so the window has n rows
        return kept.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "value"))).select("value", "place")

    roles = most(prospects.select(canonical_title(F.col("role")).alias("value")).dropna(), ROLES_KEPT)
    each = signals.filter("type = 'tech_stack'").select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.tokens", "array<variant>")).alias("t"))
    tokens = each.filter(F.schema_of_variant("t") == "STRING").select(F.trim(F.try_variant_get("t", "$", "string")).alias("value")).filter(F.length("value").between(2, 40))
    given = signals.sparkSession.createDataFrame([(s, i) for i, s in enumerate(dict.fromkeys(seeds), 1)], "value string, place int")
    words = given.unionByName(most(tokens, KEYWORDS_KEPT).join(given, "value", "left_anti").withColumn("place", F.col("place") + len(set(seeds))))
    companies = prospects.filter("company <> ''").select(F.col("company").alias("value"), F.lit(None).cast("int").alias("place")).distinct()
    name = lambda df, n: df.select(F.lit(n).alias("vocabulary"), "value", F.col("place").cast("int").alias("place"))
    return name(roles, "roles").unionByName(name(companies, "companies")).unionByName(name(words, "keywords"))


def stated_edges(stated: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges stated by a source: (edges, stubs to add, rows refused with their ``reason``).

    ``stated`` is (report_id, company_id, signal_type, confidence, manager_id, manager_title), ``persons`` (id, company_id, name, unresolved); ids are texts.
    A row without manager_id reports to the stub ``[Unknown <title>]`` of its company, an existing one (the smallest id) or a
    new one whose id follows from company and name; its confidence falls by 0.7.
    """
    ok = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    titled = F.coalesce(F.col("manager_title") != "", F.lit(False))
    reason = (
        F.when(F.col("manager_id").isNull() & ~titled, "no manager").when(F.col("manager_id") == F.col("report_id"), "reports to itself")
        .when(~ok, "confidence outside 0 to 1").when(F.col("manager_id").isNull() & F.col("company_id").isNull(), "no company")
    )
    rows = stated.withColumns({"reason": reason, "name": F.when(F.col("manager_id").isNull(), F.format_string("[Unknown %s]", "manager_title"))})
    good = rows.filter("reason IS NULL")
    had = persons.filter("unresolved").groupBy("company_id", "name").agg(F.min("id").alias("had"))
    new = F.sha2(F.concat_ws("\u0000", "company_id", "name"), 256)
    met = good.join(had, ["company_id", "name"], "left")
    unknown = F.col("manager_id").isNull()
    method = F.concat(F.lit("explicit_"), "signal_type", F.when(unknown, UNRESOLVED_ENDING).otherwise(""))
    edges = met.select("report_id", F.coalesce("manager_id", "had", new).alias("manager_id"), (F.col("confidence") * F.when(unknown, UNRESOLVED_FACTOR).otherwise(1.0)).alias("confidence"), method.alias("method"))
    stubs = met.filter(unknown & F.col("had").isNull()).select(new.alias("id"), "company_id", "name", F.col("manager_title").alias("title"), F.lit(0).alias("tier"), F.lit(True).alias("unresolved")).distinct()
    return edges, stubs, rows.filter("reason IS NOT NULL").drop("name")


def triage(edges: DataFrame) -> DataFrame:
    """(outcome, n) of edges (report_id, manager_id): those that a confidence reaches from a root, those of reports on a cycle, and those below one."""
    outcome = lambda df, name: df.select(F.col("node").alias("report_id"), F.lit(name).alias("outcome"))
    told = outcome(climbed(edges), "propagated").unionByName(outcome(cycle_members(edges), "cycle_skipped"))
    return edges.join(told, "report_id", "left").groupBy(F.coalesce("outcome", F.lit("orphan_skipped")).alias("outcome")).agg(F.count("*").alias("n"))
