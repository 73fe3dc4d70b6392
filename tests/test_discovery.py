from pyspark.sql import functions as F

from quillgraph.functions.texts import canonical_title
from quillgraph.operators import discovery as ops

NODES = "id string, kind string, name string, score double, company string, title string"


def graph(spark, nodes, edges):
    return spark.createDataFrame([(i, k, i.upper(), s, c, None) for i, k, s, c in nodes], NODES), spark.createDataFrame(edges, "source string, target string")


def seen(spark, nodes, edges, foci, kinds=("person", "company", "industry")):
    got = {}
    for r in ops.focal_subgraphs(nodes, edges, spark.createDataFrame([(f,) for f in foci], "focus string"), kinds).collect():
        got.setdefault(r.focus, []).append(r.id)
    return {f: sorted(ids) for f, ids in got.items()}


def test_a_person_with_a_high_score_is_filled_up_from_the_company(spark):
    people = [(f"p{i:02}", "person", float(i), "Mill" if i % 2 else " mill ") for i in range(30)]
    nodes, edges = graph(spark, [*people, ("star", "person", 90.0, "MILL"), ("plain", "person", 74.0, "mill"), ("c", "company", None, None), ("x", "city", None, None), ("industry:technology", "industry", None, None)],
                         [("star", "p01"), ("p02", "star"), ("star", "c"), ("star", "x"), ("plain", "p01"), ("star", "star")])
    got = seen(spark, nodes, edges, ["star", "plain", "c", "x"])
    assert got["star"] == sorted(["star", "c", "industry:technology", "p01", "p02", "plain", *(f"p{i}" for i in range(21, 30))])
    assert got["plain"] == ["industry:technology", "p01", "plain"]
    assert got["c"] == ["c", "industry:technology", "star"] and got["x"] == ["industry:technology", "star", "x"]


def test_forty_people_around_a_person_and_all_around_a_company(spark):
    people = [(f"p{i:02}", "person", None if i < 5 else float(i % 50), None) for i in range(60)]
    nodes, edges = graph(spark, [*people, ("hub", "person", 10.0, None), ("c", "company", None, None)], [(w, p[0]) for p in people for w in ("hub", "c")])
    got = seen(spark, nodes, edges, ["hub", "c"])
    best = sorted((-(-1.0 if s is None else s), i) for i, _, s, _ in people)[:40]
    assert got["hub"] == sorted(["hub", *(i for _, i in best)])
    assert len(got["c"]) == 61


def test_foci_that_are_not_there_show_the_top_or_everything(spark):
    few, edges = graph(spark, [("a", "person", None, None), ("i", "industry", None, None)], [("a", "i")])
    assert seen(spark, few, edges, ["gone", None]) == {"gone": ["a", "i"], None: ["a", "i"]}
    many, edges = graph(spark, [("a", "person", None, None), *((f"i{n}", "industry", None, None) for n in range(10))], [("a", "i0")])
    assert len(seen(spark, many, edges, ["gone"])["gone"]) == 10
    assert seen(spark, many, edges, ["i0"]) == {"i0": ["i0"]}  # an industry shows companies only
    assert seen(spark, many.limit(0), edges.limit(0), ["gone"]) == {}


def test_stated_edges_stubs_and_refusals(spark):
    rows = [("r1", "c", "press", 0.8, "m", None), ("r2", "c", "press", 0.5, None, "Head"), ("r3", "c", "press", 0.5, None, "Chief"), ("r4", "c", "press", 0.5, None, "Chief"), ("r5", "c", "press", 1.2, "m", None),
            ("r6", "c", "press", 0.5, "r6", None), ("r7", None, "press", 0.5, None, "Head"), ("r8", "c", "press", 0.5, None, ""), ("r9", "c", "press", None, "m", None)]
    stated = spark.createDataFrame(rows, "report_id string, company_id string, signal_type string, confidence double, manager_id string, manager_title string")
    persons = spark.createDataFrame([("z", "c", "[Unknown Head]", True), ("b", "c", "[Unknown Head]", True), ("a", "c", "[Unknown Head]", False)], "id string, company_id string, name string, unresolved boolean")
    edges, stubs, refused = ops.stated_edges(stated, persons)
    got = {r.report_id: (r.manager_id, round(r.confidence, 6), r.method) for r in edges.collect()}
    (stub,) = stubs.collect()
    assert got == {"r1": ("m", 0.8, "explicit_press"), "r2": ("b", 0.35, "explicit_press_unresolved_target"), "r3": (stub.id, 0.35, "explicit_press_unresolved_target"), "r4": (stub.id, 0.35, "explicit_press_unresolved_target")}
    assert (stub.name, stub.title, stub.tier) == ("[Unknown Chief]", "Chief", 0)
    again = ops.stated_edges(stated, persons.unionByName(stubs.select("id", "company_id", "name", "unresolved")))
    assert again[1].count() == 0 and {r.report_id: r.manager_id for r in again[0].collect()} == {k: v[0] for k, v in got.items()}
    assert {r.report_id: r.reason for r in refused.collect()} == {"r5": "confidence outside 0 to 1", "r6": "reports to itself", "r7": "no company", "r8": "no manager", "r9": "confidence outside 0 to 1"}


def test_titles_and_vocabularies(spark):
    titles = ["Vice President of Looms | Mill", "vice president, Wool", "sr. director wool", "Sr VP weaving", "VP Dyeing at Mill", "vp of dyes", "Buyer", "head of the - mill", None, "", "x" * 71]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, role string")
    got = [r[0] for r in df.orderBy("i").select(canonical_title(F.col("role"))).collect()]
    assert got == ["VP Of Looms", None, "Senior Director Wool", "SVP Weaving", "VP Of Dyeing", "Vp Of Dyes"] + [None, "Head Of The", None, None, None]
    people = spark.createDataFrame([("Dyer Weaver", "B"), ("dyer  weaver", "A"), ("Baker at A", "A"), (None, ""), (None, None)], "role string, company string")
    signals = spark.createDataFrame([("tech_stack", '{"tokens": ["wool", " wool ", "s", 5, "dye"]}'), ("tech_stack", "{"), ("tech_stack", None), ("news", '{"tokens": ["no"]}')], "type string, value string")
    got = sorted((r.vocabulary, r.place or 0, r.value) for r in ops.vocabularies(people, signals, ["dye", "silk", "dye"]).collect())
    assert got == [("companies", 0, "A"), ("companies", 0, "B"), ("keywords", 1, "dye"), ("keywords", 2, "silk"), ("keywords", 3, "wool"), ("roles", 1, "Dyer Weaver")]


def test_lead_points(spark):
    rows = [(1, "Ada Low", "Mill", "Head Weaver", "Wool", 50.0), (2, None, None, None, None, 100.0), (3, "Bo", "Loom Mill", "weaver/dyer", "wool trade", None)]
    people = spark.createDataFrame(rows, "id int, name string, company string, role string, industry string, score double")
    got = {r.id: (r.match_score, round(r.blended, 6)) for r in ops.lead_matches(people, name="ada", company="mill", roles=["Weaver dyer"], keywords=["weav", "head"], industry="wool").collect()}
    assert got == {1: (9.5, 7.7), 3: (6.5, 3.9), 2: (2.0, 5.2)}  # no company lies within any
    assert ops.lead_matches(people, roles=["pilot"]).count() == 0
