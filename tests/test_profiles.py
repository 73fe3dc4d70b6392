"""Bundles, timelines and merges against hand-written expectations and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import dates as fd
from quillgraph.functions import scoring as fs
from quillgraph.operators import bundles as ops
from quillgraph.operators import hubs as ops_hubs
from quillgraph.operators import press
from quillgraph.operators.merges import activate, rule_merge

DATES = [
    ((2019, 3, 2021, 5, False), "Mar 2019 – May 2021 · 2 yrs 3 mos"), ((2019, 3, 2019, 3, False), "Mar 2019 – Mar 2019 · 1 mo"), ((2019, 3, None, None, True), "Mar 2019 – Present · 7 yrs 4 mos"),
    ((2015, None, 2018, None, False), "2015 – 2018 · 4 yrs"), ((2015, None, 2015, 6, False), "2015 – Jun 2015 · <1 yr"), ((2015, 1, 2015, 12, None), "Jan 2015 – Dec 2015 · 1 yr"), ((2015, 13, 2016, 4, False), "2015 – Apr 2016 · 1 yr 4 mos"),
    ((2015, None, None, 4, False), "2015 – ? · ongoing"), ((None, 3, 2018, 1, True), "Date unknown"), ((2020, 5, 2018, 1, False), "May 2020 – Jan 2018 · <1 mo"), ((2020, None, None, None, True), "2020 – Present · 6 yrs"),
]


def test_date_ranges(spark):
    df = spark.createDataFrame([(*d, i) for i, (d, _) in enumerate(DATES)], "sy int, sm int, ey int, em int, cur boolean, i int")
    columns = [F.col(c) for c in ("sy", "sm", "ey", "em", "cur")]
    got = {r.i: (r.full, r.years) for r in df.select("i", fd.date_range(*columns, F.lit(2026), F.lit(6)).alias("full"), fd.date_range(*columns, F.lit(2026), F.lit(6), year_only=True).alias("years")).collect()}
    assert {i: full for i, (full, _) in got.items()} == {i: want for i, (_, want) in enumerate(DATES)}
    assert got[0][1] == "2019 – 2021 · 3 yrs" and got[2][1] == "2019 – Present · 7 yrs"


@pytest.mark.parametrize(("text", "want"), [("1994 – 2003", (1994, 2003)), ("2003-1994", (2003, None)), ("since 2011", (2011, None)), ("3001-2004", (None, None)), ("2004-3001", (2004, None)), ("12345 or 99", (None, None)), ("", (None, None)), (None, (None, None))])
def test_role_years(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(fd.role_years(F.col("t")).alias("y")).first()["y"]) == want


def test_rule_merge(spark):
    schema = "k int, a string, b string, c string, d array<string>, e int"
    old = spark.createDataFrame([(1, "x", "x", "x", ["p", "q"], 2), (2, None, None, None, None, None), (3, "x", "x", "x", ["p"], 1)], schema).withColumn("updated_at", F.lit("then"))
    new = spark.createDataFrame([(1, "y", None, None, ["q", "a"], 1), (2, "y", "y", "y", ["z"], 5), (4, "y", None, "y", None, None)], schema)
    rules = {"a": "old", "b": "new", "c": "replace", "d": "union", "e": "greatest"}
    got = {tuple(x if not isinstance(x, list) else tuple(x) for x in r) for r in rule_merge(old, new, ["k"], rules, F.lit("now")).collect()}
    assert got == {(1, "x", "x", None, ("a", "p", "q"), 2, "now"), (2, "y", "y", "y", ("z",), 5, "now"), (3, "x", "x", "x", ("p",), 1, "then"), (4, "y", None, "y", (), None, "now")}


def test_one_version_is_active(spark):
    v = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 3, True), (3, 4, False)], "account_id int, version int, is_active boolean")
    n = spark.createDataFrame([(1, 9, False), (4, 8, False)], "account_id int, version int, is_active boolean")
    assert {tuple(r) for r in activate(v, n).collect()} == {(1, 1, False), (1, 2, False), (1, 9, True), (2, 3, True), (3, 4, False), (4, 8, True)}


def test_org_context_equals_plain_lists(spark):
    rnd = random.Random(3)
    members = [(c, d, 100 * c + i, rnd.choice([0.3, 0.7, 0.95])) for c in (1, 2) for i in range(40) for d in [rnd.choice("ab")]]
    edges = [(rnd.choice(members)[2], m[2], rnd.choice([0.5, 0.6, 0.7]), rnd.choice([0.4, 0.6, None])) for m in members if rnd.random() < 0.7]
    got = {(r.person_id, r.part, r["rank"]): (r.other_id, r.confidence, r.dotted) for r in ops.org_context(
        spark.createDataFrame(edges, "manager_id long, report_id long, confidence double, path_confidence double"), spark.createDataFrame(members, "company_id long, domain string, person_id long, confidence double")
    ).collect()}
    want = {}
    for _, _, p, _ in members:
        lists = {
            "manager": [(m, c, path is not None and path < c) for m, r, c, path in edges if r == p], "report": [(r, c, False) for m, r, c, _ in edges if m == p],
            "peer": [(q, c, False) for co, d, q, c in members if q != p and any((co, d, p) == x[:3] for x in members)],
        }
        for part, own in lists.items():
            ranked = sorted(own, key=lambda x: (-x[1], x[0]))
            want |= {(p, part, i): x for i, x in enumerate(ranked[:10] if part == "peer" else ranked, 1)}
    assert got == want


def test_company_profile(spark):
    companies = spark.createDataFrame([(1,), (2,), (3,)], "company_id int")
    persons = spark.createDataFrame([(10, 1, "Una Weld", True), (11, 1, "Tor Hale", False), (20, 2, "Mia Orr", True)], "person_id int, company_id int, name string, enriched boolean")
    rows = [(1, i, "press_release", None, f"2024-01-{1 + i % 28:02d}") for i in range(60)] + [(1, 100, "executive_profile", "una weld", "2024-02-01"), (1, 101, "executive_profile", "No Body", "2024-02-02"), (1, 102, "executive_profile", None, "2024-02-03"), (2, 200, "press_release", None, "2023-01-01")]
    signals = spark.createDataFrame(rows, "company_id int, signal_id int, kind string, name string, day string").withColumn("at", F.to_timestamp("day"))
    edges = spark.createDataFrame([(10, 0.5), (10, 0.7), (99, 0.9)], "manager_id int, confidence double")
    clusters = spark.createDataFrame([(1,), (1,)], "company_id int")
    links = spark.createDataFrame([(10, 20, "co_investor", 0.8), (10, 11, "co_investor", 0.9), (11, 20, "odd_kind", 0.8), (11, 99, "co_investor", 0.4)], "a int, b int, type string, strength double")
    got = {r.company_id: r for r in ops.company_profiles(companies, persons, signals, edges, clusters, links, F.lit("2024-02-10").cast("timestamp")).collect()}
    r = got[1]
    assert (r.executives, r.executives_known, r.press_total, r.press_recent, r.edges, r.edge_confidence, r.clusters, r.people, r.enriched, r.enriched_share) == (3, 1, 60, sum(1 + i % 28 >= 11 for i in range(60)), 2, 0.6, 2, 2, 1, 0.5)
    assert r.recent_press.split(",") == [str(i) for i in sorted(range(60), key=lambda i: (-(i % 28), i))[:10]]
    assert (r.warm, r.warm_strength, r.strongest_from, r.strongest_to, r.strongest_via, r.strongest) == (3, 0.67, "Una Weld", "Mia Orr", "co-invested in a company", 0.8)
    assert (got[2].warm, got[2].press_total, got[2].press_recent, got[2].executives) == (2, 1, 0, 0)
    assert (got[3].people, got[3].warm, got[3].strongest, got[3].recent_press, got[3].enriched_share) == (0, 0, None, None, 0.0)


def test_source_confidences(spark):
    cases = [("uspto", None, None, None, 0.95), ("scholar", None, None, None, 0.9), ("scholar", None, 6, None, 0.75), ("career", None, None, None, 0.6), ("career", "career_overlap_same_team", None, None, 0.88), ("parallel", None, None, None, 0.2), ("parallel", "x", None, None, 0.5), ("education", "same_mba_cohort", None, 0.33, 0.33), ("education", None, None, None, 0.25), ("conference", "x", None, None, 0.4), ("standards", None, None, None, 0.82), ("rumour", None, None, 0.9, 0.5), (None, None, None, None, 0.5)]
    df = spark.createDataFrame(cases, "s string, k string, n int, g double, want double")
    for r in df.select("want", "s", fs.source_confidence(F.col("s"), F.col("k"), F.col("n"), F.col("g")).alias("got"), fs.told_as(F.col("k")).alias("told")).collect():
        assert float(r.got) == r.want, r.s
    told = [r.t for r in spark.createDataFrame([("co_investor",), ("new_kind",), (None,)], "k string").select(fs.told_as(F.col("k")).alias("t")).collect()]
    assert told == ["co-invested in a company", "new kind", "shared a connection"]


def test_hubs(spark):
    schema = "id int, company string, past array<string>, industry string, schools array<string>, role string, talks array<struct<venue:string,year:int>>, city string, score double"
    rows = [
        (1, "Keel Inc", ["Brine Ltd", "keel"], " Chips ", ["MIT", "mit ", None], "Dyer at Keel", [("Expo", 2020), ("Expo", None), (None, 2020)], "Oslo", 80.0), (2, "KEEL", None, "chips", None, "Dyer", None, None, None),
        (3, None, [None, ""], None, [], None, [], "", 60.04), (4, "Brine", None, "Salt", ["MIT"], "Weaver", [("expo ", 2020)], "oslo", 75.0),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in ops_hubs.hub_members(df).collect():
        got.setdefault(r.hub, []).append(r.id)
    assert {h: sorted(v) for h, v in got.items()} == {
        "company:keel": [1, 2], "company:brine": [1, 4], "industry:chips": [1, 2], "industry:salt": [4], "role:dyer": [1, 2], "role:weaver": [4], "school:mit": [1, 4], "conference:expo 2020": [1], "conference:expo": [1], "conference:expo  2020": [4], "city:oslo": [1, 4],
    }
    told = {r.hub: tuple(r)[1:] for r in ops_hubs.hub_summaries(df).collect()}
    assert told["company:keel"] == (2, 80.0, 1, "Dyer=2", "Chips=1, chips=1", "1, 2") and told["city:oslo"] == (2, 77.5, 2, "Dyer=1, Weaver=1", "Chips=1, Salt=1", "1, 4")
    many = df.limit(1).crossJoin(spark.range(20).select(F.col("id").alias("n"))).withColumns({"id": F.col("n").cast("int"), "score": F.col("n").cast("double")}).drop("n")
    assert {r.people for r in ops_hubs.hub_summaries(many).collect()} == {"19, 18, 17, 16, 15, 14, 13, 12"}
    assert ops_hubs.hub_summaries(df.limit(0)).count() == 0


def test_press_entries(spark):
    df = spark.createDataFrame([(1, '[{"person_name": "A B", "person_title": 5, "confidence": -1}, {"person_name": null}, {"person_name": "C", "confidence": 0.5, "reports_to_name": " D "}]', "x"), (2, None, "y"), (3, "{}", "z"), (4, "[[]]", "w")], "id int, entries string, keep string")
    assert [tuple(r) for r in press.reporting_entries(df).orderBy("person_name").collect()] == [(1, "x", "A B", None, None, None, 0.0), (1, "x", "C", None, "D", None, 0.5)]
    texts = spark.createDataFrame([("She is responsible for dyes",), ("MisLeads",), ("nothing",), (None,)], "t string")
    assert [r.b for r in texts.select(press.tells_of_leading(F.col("t")).alias("b")).collect()] == [True, True, False, False]
