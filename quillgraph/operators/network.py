"""The whole property graph of people: attributes, colleagues, partnerships, a root, cited evidence and hidden connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.texts import company_node_key, role_text
from quillgraph.operators.stored import stored

# Kinds of edges that have no direction, kinds of connections and the edges and evidence they make,
# fields of each kind of evidence (s: text, n: text or null, i: whole number or null), and limits.
SIGNAL_EDGES = {
    "patent_co_inventor": ("patent_co_inventor", "patent_co_inventor"),
    "academic_co_author": ("academic_co_author", "academic_co_author"),
    "academic_co_author_single": ("academic_co_author", "academic_co_author"),
    "academic_co_author_multi": ("academic_co_author", "academic_co_author"),
    "conference_co_presenter": ("conference_co_presenter", "conference_co_presenter"),
    "standards_committee": ("standards_committee", "standards_committee"),
    "standards_committee_peer": ("standards_committee", "standards_committee"),
    "career_overlap_same_team": ("colleague", "career_overlap"),
    "career_overlap_same_domain": ("past_employer", "career_overlap"),
    "career_overlap_general": ("past_employer", "career_overlap"),
    "same_mba_cohort": ("same_mba_cohort", "education_cohort"),
    "same_phd_program": ("same_phd_program", "education_cohort"),
    "executive_education": ("executive_education", "education_cohort"),
    "same_undergrad_cohort": ("same_undergrad_cohort", "education_cohort"),
}
SYMMETRIC = sorted({"partnership"} | {edge for edge, _ in SIGNAL_EDGES.values()})
EVIDENCE_FIELDS = {
    "patent_co_inventor": "patent_number:s patent_title:s filing_date:s grant_date:n assignee:s uspto_url:n",
    "academic_co_author": "paper_title:s venue:s year:i citation_count:i semantic_scholar_id:n doi:n",
    "conference_co_presenter": "event:s year:i",
    "standards_committee": "committee:s years:s",
    "education_cohort": "institution:s program:n overlap_start_year:i overlap_end_year:i",
    "career_overlap": "company_name:s overlap_start_year:i overlap_end_year:i overlap_years:i team_a:n team_b:n domain_a:n domain_b:n seniority_gap:i",
}
COLLEAGUES, CONNECTIONS = 6, 8
ROOT_ID, ROOT_NAME = "industry:technology", "Technology"


def _mapped(value: Column, pairs: dict[str, str]) -> Column:
    """``value`` by a small table of constants, else null."""
    return reduce(lambda out, kv: F.when(value == kv[0], kv[1]).otherwise(out), pairs.items(), F.lit(None).cast("string"))


def edge_kind(signal_type: Column) -> Column:
    """Kind of edge that a type of connection makes, or null."""
    return _mapped(signal_type, {k: edge for k, (edge, _) in SIGNAL_EDGES.items()})


def _field(payload: Column, name: str, form: str) -> Column:
    """A field of an object as evidence tells it: texts only as they are, numbers cut to whole ones (also out of texts)."""
    text = F.try_variant_get(payload, f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
    said = F.when(kind == "STRING", text)
    if form == "s":
        return F.coalesce(said, F.lit(""))
    if form == "n":
        return F.when(said != "", said)
    bare = F.trim(text)
    number = F.when(bare == "", "0").when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare).try_cast("double")
    return F.when((kind == "STRING") | kind.rlike("^(BIGINT|DECIMAL|DOUBLE)"), number).cast("long")


def typed_evidence(signal_type: Column, value: Column) -> Column:
    """JSON text of a connection's evidence with the fields of its kind; null for other types and for values that are no object.

    ``value`` is JSON text. Fields that lack or have another type are empty texts or nulls.
    """
    payload = F.try_parse_json(value)
    kind = _mapped(signal_type, {k: e for k, (_, e) in SIGNAL_EDGES.items()} | {"past_employer": "career_overlap"})
    out = F.lit(None).cast("string")
    for name, fields in EVIDENCE_FIELDS.items():
        told = [_field(payload, f, form).alias(f) for f, form in (x.split(":") for x in fields.split())]
        out = F.when(kind == name, F.to_json(F.struct(F.lit(name).alias("kind"), *told), {"ignoreNullFields": "false"})).otherwise(out)
    return F.when(F.schema_of_variant(payload).startswith("OBJECT"), out)


def positions(df: DataFrame, key: str, order: str) -> DataFrame:
    """``df`` with ``position`` (from 1) of each row among those of its ``key``, by ``order`` (unique within a key).

    Rows are sorted in ranges of (key, order), so a key that holds a third of all rows is many tasks; only
    counts for each key and range are added up.
    """
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    kept = stored(dealt.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")))
    runs = kept.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    return kept.join(runs, [key, "_part"]).withColumn("position", F.col("_at") - F.col("_first") + F.col("_before") + 1).drop("_part", "_at", "_first", "_before")


def _key(text: Column) -> Column:
    return F.lower(F.trim(text))


def _id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), key)


def _given(text: Column) -> Column:
    """Text that isn't blank, else null."""
    return F.when(F.trim(text) != "", text)


class Network:
    """Nodes (id, kind, name) and edges (source, target, kind, evidence) over these tables:

    * people: id, name, role, company, industry, past array<string>, schools array<string>, talks array<struct<venue, year>>
    * places: key (see ``company_node_key``), city, industry; one row a key
    * partners: key, partner
    * signals: id, person_id, type, value (JSON text); connections: id, person_id, other_id, type, strength, value

    An edge without a direction has its smaller end first; of several writes of one edge the first evidence stays, by
    pass (signals before connections), person and id. Of several names of one node the first stays, by person and place
    in the row; an industry named by people before one named by a place, a company named by people before partners. Null lists are empty; blank companies make the node ``company:unknown``; blank past companies,
    schools, venues and roles make none. Signals and connections to people that aren't there make no edge.
    """

    def __init__(self, people: DataFrame, places: DataFrame, partners: DataFrame, signals: DataFrame, connections: DataFrame):
        self.signals, self.connections = signals, connections
        company = F.coalesce(_given(company_node_key(F.col("company"))), F.lit("unknown"))
        own = people.withColumns({"person": _id("person", F.col("id").cast("string")), "key": company, "label": role_text(F.col("role"))})
        places = places.select("key", _given(F.col("city")).alias("city"), _given(F.col("industry")).alias("trade"))
        joined = own.join(places, "key", "left").withColumn("field", F.coalesce(F.trim(_given(F.col("industry"))), F.col("trade")))
        self.people = stored(joined)
        self.names = stored(self._companies(places, partners))
        self.partners = partners

    def _companies(self, places: DataFrame, partners: DataFrame) -> DataFrame:
        """(key, name, city, trade, present): every company; not present are those that are partners only."""
        past = self.people.select("id", F.posexplode_outer("past").alias("at", "past")).filter(company_node_key(F.col("past")) != "")
        seen = self.people.select("key", F.col("company").alias("name"), F.struct("id", F.lit(0).alias("at")).alias("when")).unionByName(
            past.select(company_node_key(F.col("past")).alias("key"), F.col("past").alias("name"), F.struct("id", (F.col("at") + 1).alias("at")).alias("when"))
        )
        first = seen.groupBy("key").agg(F.min_by(F.struct("name"), "when")["name"].alias("name"))
        named = partners.join(first, "key", "left_semi").select(company_node_key(F.col("partner")).alias("to"), "partner", "key").filter(F.col("to") != "")
        extra = named.groupBy(F.col("to").alias("key")).agg(F.min_by("partner", F.struct("key", "partner")).alias("name")).join(first, "key", "left_anti")
        every = first.withColumn("present", F.lit(True)).unionByName(extra.withColumn("present", F.lit(False)))
        return every.join(places, "key", "left")

    def nodes(self) -> DataFrame:
        """Every node once."""
        p, c = self.people, self.names
        row = lambda df, kind, key, name, *at: df.select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), name.alias("name"), F.struct(*at).alias("when"))
        none, zero = F.lit(None).cast(p.schema["id"].dataType), F.lit(0)
        order = lambda turn, who, at: (F.lit(turn).alias("turn"), who.alias("who"), at.alias("at"))
        study = p.select("id", F.posexplode("schools").alias("at", "school")).filter(F.col("school") != "")
        talk = p.select("id", F.posexplode("talks").alias("at", "talk")).filter(F.col("talk.venue") != "")
        title = _talk(F.col("talk"))
        rows = [
            row(p, "person", F.col("id").cast("string"), F.col("name"), *order(1, F.col("id"), zero)),
            row(c, "company", F.col("key"), F.col("name"), *order(1, none, zero)),
            row(c.filter("city IS NOT NULL"), "city", _key(F.col("city")), F.col("city"), *order(2, none, zero)),
            row(p.filter("field IS NOT NULL"), "industry", _key(F.col("field")), F.col("field"), *order(1, F.col("id"), zero)),
            row(self._by_place(), "industry", _key(F.col("trade")), F.col("trade"), *order(2, none, zero)),
            row(study, "school", _key(F.col("school")), F.col("school"), *order(1, F.col("id"), F.col("at"))),
            row(talk, "conference", _key(title), title, *order(1, F.col("id"), F.col("at"))),
            row(p.filter("label <> ''"), "role", _key(F.col("label")), F.col("label"), *order(1, F.col("id"), zero)),
            row(c.limit(1), "industry", F.lit(ROOT_NAME.lower()), F.lit(ROOT_NAME), *order(3, none, zero)),
        ]
        every = reduce(DataFrame.unionByName, rows)
        return every.groupBy("id", "kind").agg(F.min_by(F.struct("name"), F.struct("when", "name"))["name"].alias("name"))

    def _attributes(self) -> list[DataFrame]:
        p, c = self.people, self.names
        past = p.select("person", F.explode("past").alias("past")).withColumn("past", company_node_key(F.col("past"))).filter("past <> ''")
        study = p.select("person", F.explode("schools").alias("school")).filter("school <> ''")
        talk = p.select("person", F.explode("talks").alias("talk")).filter(F.col("talk.venue") != "")
        label, field = _id("role", _key(F.col("label"))), _id("industry", _key(F.col("field")))
        return [
            _edges(p, F.col("person"), _id("company", F.col("key")), "works_at"),
            _edges(p.filter("field IS NOT NULL"), _id("company", F.col("key")), field, "vertical"),
            _edges(c.filter("city IS NOT NULL"), _id("company", F.col("key")), _id("city", _key(F.col("city"))), "located_in"),
            _edges(self._by_place(), _id("company", F.col("key")), _id("industry", _key(F.col("trade"))), "vertical"),
            _edges(past, F.col("person"), _id("company", F.col("past")), "past_employer"),
            _edges(study, F.col("person"), _id("school", _key(F.col("school"))), "education"),
            _edges(talk, F.col("person"), _id("conference", _key(_talk(F.col("talk")))), "scope_signal"),
            _edges(p.filter("label <> ''"), F.col("person"), label, "scope_signal"),
            _edges(p.filter("label <> '' AND field IS NOT NULL"), label, field, "vertical"),
        ]

    def _by_place(self) -> DataFrame:
        """Companies told by past stints or partners, whose industry is that of their place."""
        past = self.people.select(F.explode("past").alias("past")).select(company_node_key(F.col("past")).alias("key"))
        named = self.names.filter("NOT present").select("key").unionByName(past).distinct()
        return self.names.filter("trade IS NOT NULL").join(named, "key", "left_semi")

    def _colleagues(self) -> DataFrame:
        """Each person and the next six of the company, by id, joined by position."""
        at = positions(self.people.select("key", "id", "person"), "key", "id")
        ahead = at.select("key", F.col("person").alias("one"), F.explode(F.sequence(F.col("position") + 1, F.col("position") + COLLEAGUES)).alias("position"))
        return _edges(ahead.join(at, ["key", "position"]), F.col("one"), F.col("person"), "colleague")

    def _upward(self) -> list[DataFrame]:
        """Partnerships, and the root above industries and cities."""
        own = self.partners.join(self.names.filter("present"), "key", "left_semi").withColumn("to", company_node_key(F.col("partner"))).filter(F.col("to") != "")
        fields = self.people.select(F.col("field").alias("x")).filter("x IS NOT NULL").unionByName(self._by_place().select(F.col("trade").alias("x"))).select(_key(F.col("x")).alias("x")).distinct()
        cities = self.names.filter("city IS NOT NULL").select(_key(F.col("city")).alias("x")).distinct()
        return [
            _edges(own, _id("company", F.col("key")), _id("company", F.col("to")), "partnership"),
            _edges(fields, _id("industry", F.col("x")), F.lit(ROOT_ID), "vertical"),
            _edges(cities, _id("city", F.col("x")), F.lit(ROOT_ID), "located_in"),
        ]

    def _cited(self) -> DataFrame:
        """People with any signal, to the role of exactly their title."""
        told = self.people.join(self.signals.select(F.col("person_id").alias("id")).distinct(), "id", "left_semi")
        roles = self.people.filter("label <> ''").select(_key(F.col("label")).alias("title")).distinct()
        return _edges(told.withColumn("title", _key(F.col("role"))).join(roles, "title"), F.col("person"), _id("role", F.col("title")), "evidence_cited")

    def _hidden(self) -> DataFrame:
        """Connections between two people of the graph, out of signals and of the strongest eight stored connections of each."""
        named = F.try_parse_json(F.col("value"))
        to = F.when(F.schema_of_variant(F.try_variant_get(named, "$.connected_to", "variant")) == "STRING", F.try_variant_get(named, "$.connected_to", "string"))
        found = self.signals.filter(edge_kind(F.col("type")).isNotNull()).select("id", "person_id", "type", "value", to.alias("to"), F.lit(5).alias("turn"))
        # the best of a part of a person's connections, then of the parts: a hub isn't gathered in one task
        best = F.struct((-F.col("strength")).alias("weak"), "id", F.col("other_id").cast("string").alias("to"), "type", "value")
        kept = top_structs(self.connections.select("person_id", best.alias("c")), "person_id", "c", CONNECTIONS)
        kept = kept.select(F.col("c.id").alias("id"), "person_id", F.col("c.type").alias("type"), F.col("c.value").alias("value"), F.col("c.to").alias("to"), F.lit(6).alias("turn"))
        here = self.people.select(F.col("id").cast("string").alias("to"))
        both = found.unionByName(kept.filter(edge_kind(F.col("type")).isNotNull())).join(here, "to", "left_semi")
        both = both.join(self.people.select(F.col("id").alias("person_id")), "person_id", "left_semi")
        source, target = _id("person", F.col("person_id").cast("string")), _id("person", F.col("to"))
        return both.select(source.alias("source"), target.alias("target"), edge_kind(F.col("type")).alias("kind"), F.struct("turn", "person_id", "id").alias("when"), typed_evidence(F.col("type"), F.col("value")).alias("evidence"))

    def edges(self) -> DataFrame:
        """Every edge once, with its first evidence."""
        bare = reduce(DataFrame.unionByName, [*self._attributes(), self._colleagues(), *self._upward(), self._cited()])
        every = bare.unionByName(self._hidden(), allowMissingColumns=True).filter("source <> target")
        turned = F.col("kind").isin(SYMMETRIC) & (F.col("source") > F.col("target"))
        ends = {"source": F.when(turned, F.col("target")).otherwise(F.col("source")), "target": F.when(turned, F.col("source")).otherwise(F.col("target"))}
        first = F.min_by("evidence", F.when(F.col("evidence").isNotNull(), F.col("when")))
        return every.withColumns(ends).groupBy("source", "target", "kind").agg(first.alias("evidence"))


def top_structs(df: DataFrame, key: str, value: str, n: int, salts: int = 32) -> DataFrame:
    """The ``n`` smallest ``value`` of each ``key``: first within each of ``salts`` parts of a key, then among the parts' best."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(salts)))
    for by in ((key, "_salt"), (key,)):
        salted = salted.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(value))).filter(F.col("_r") <= n).drop("_r")
    return salted.drop("_salt")


def _talk(talk: Column) -> Column:
    """Title of a talk's event: the venue, with its year unless that is null or 0."""
    return F.when(talk["year"] != 0, F.concat_ws(" ", talk["venue"], talk["year"].cast("string"))).otherwise(talk["venue"])


def _edges(df: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))
