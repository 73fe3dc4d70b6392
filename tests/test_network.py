import json

from pyspark.sql import functions as F

from quillgraph.operators.network import Network, edge_kind, positions, top_structs, typed_evidence

PEOPLE = "id long, name string, role string, company string, industry string, past array<string>, schools array<string>, talks array<struct<venue:string,year:int>>"
SIGNALS = "id long, person_id long, type string, value string"
CONNECTIONS = "id long, person_id long, other_id long, type string, strength double, value string"


def network(spark, people=(), places=(), partners=(), signals=(), connections=()):
    return Network(
        spark.createDataFrame(list(people), PEOPLE), spark.createDataFrame(list(places), "key string, city string, industry string"),
        spark.createDataFrame(list(partners), "key string, partner string"), spark.createDataFrame(list(signals), SIGNALS), spark.createDataFrame(list(connections), CONNECTIONS),
    )


def edges(n):
    return {(r.source, r.target, r.kind): r.evidence and json.loads(r.evidence) for r in n.edges().collect()}


def test_passes_by_hand(spark):
    n = network(
        spark,
        [(1, "Ada", "Weaver", "Mill Corp", None, ["Old Loom Inc", "", None], ["Tech U"], [("Days", 2001)]), (2, "Bo", "Weaver at Mill", "mill", " Cloth ", None, None, None), (3, None, None, None, None, None, None, None)],
        [("mill", "Basel", "Fibre"), ("guild", "Bern", "Trade"), ("unused", "Oslo", "Nothing")],
        [("mill", "Guild Ltd"), ("mill", "Mill Inc"), ("absent", "Nobody")],
        [(9, 1, "patent_co_inventor", '{"connected_to": "2", "patent_number": "P1"}'), (8, 2, "patent_co_inventor", '{"connected_to": "1"}'), (7, 1, "past_employer", '{"connected_to": "2"}'), (6, 1, "same_mba_cohort", "[1]"), (5, 2, "same_mba_cohort", '{"connected_to": 1}')],
        [(1, 2, 1, "same_phd_program", 0.5, "[]"), (2, 2, 7, "same_phd_program", 0.9, "{}")],
    )
    got = edges(n)
    assert set(got) == {
        ("person:1", "company:mill", "works_at"), ("person:2", "company:mill", "works_at"), ("person:3", "company:unknown", "works_at"),
        ("company:mill", "industry:fibre", "vertical"), ("company:mill", "industry:cloth", "vertical"), ("company:mill", "city:basel", "located_in"),
        ("company:old loom", "person:1", "past_employer"), ("person:1", "school:tech u", "education"), ("person:1", "conference:days 2001", "scope_signal"),
        ("person:1", "role:weaver", "scope_signal"), ("person:2", "role:weaver", "scope_signal"), ("role:weaver", "industry:fibre", "vertical"), ("role:weaver", "industry:cloth", "vertical"),
        ("person:1", "person:2", "colleague"), ("company:guild", "company:mill", "partnership"), ("company:guild", "city:bern", "located_in"), ("company:guild", "industry:trade", "vertical"),
        ("industry:fibre", "industry:technology", "vertical"), ("industry:cloth", "industry:technology", "vertical"), ("industry:trade", "industry:technology", "vertical"),
        ("city:basel", "industry:technology", "located_in"), ("city:bern", "industry:technology", "located_in"), ("person:1", "role:weaver", "evidence_cited"),
        ("person:1", "person:2", "patent_co_inventor"), ("person:1", "person:2", "same_phd_program"),
    }
    assert got["person:1", "person:2", "patent_co_inventor"]["patent_number"] == "P1"  # person 1's signal comes first
    assert got["person:1", "person:2", "same_phd_program"] is None
    names = {r.id: r.name for r in n.nodes().collect()}
    assert names["company:mill"] == "Mill Corp" and names["company:guild"] == "Guild Ltd" and names["industry:technology"] == "Technology"
    assert {x for pair in got for x in pair[:2]} <= set(names) and "city:oslo" not in names


def test_empty_tables_make_nothing(spark):
    n = network(spark)
    assert n.nodes().count() == n.edges().count() == 0


def test_evidence_forms(spark):
    rows = [("standards_committee_peer", '{"committee": 5, "years": "2001"}'), ("conference_co_presenter", '{"event": "E", "year": " 2001.9 "}'), ("conference_co_presenter", '{"year": ""}'),
            ("conference_co_presenter", '{"year": true}'), ("academic_co_author_multi", '{"year": "soon", "doi": ""}'), ("alumni_network", "{}"), ("past_employer", '{"overlap_years": -2.7}'), ("same_mba_cohort", "{"), ("same_mba_cohort", None), (None, "{}")]
    df = spark.createDataFrame(rows, "type string, value string")
    got = [r[0] and json.loads(r[0]) for r in df.select(typed_evidence(F.col("type"), F.col("value"))).collect()]
    assert got[0] == {"kind": "standards_committee", "committee": "", "years": "2001"}
    assert [g["year"] for g in got[1:4]] == [2001, 0, None] and got[4]["year"] is None and got[4]["doi"] is None
    assert got[6]["overlap_years"] == -2 and got[5] is got[7] is got[8] is got[9] is None
    assert [r[0] for r in df.select(edge_kind(F.col("type"))).collect()][5:7] == [None, None]


def test_positions_of_a_hot_key_run_over_partitions(spark):
    rows = [(1 if i % 3 else i, i) for i in range(3000)]
    got = positions(spark.createDataFrame(rows, "k long, i long").repartition(7), "k", "i")
    want, seen = {}, {}
    for k, i in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        want[k, i] = seen[k]
    assert {(r.k, r.i): r.position for r in got.collect()} == want


def test_top_structs_equals_plain_sort(spark):
    rows = [(i % 4 and 7, (i * 37) % 101, i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, w long, i long").select("k", F.struct("w", "i").alias("v"))
    want = {k: sorted((w, i) for kk, w, i in rows if kk == k)[:8] for k in {r[0] for r in rows}}
    got = {}
    for r in top_structs(df, "k", "v", 8).collect():
        got.setdefault(r.k, []).append(tuple(r.v))
    assert {k: sorted(v) for k, v in got.items()} == want
