import json
from itertools import combinations

from pyspark.sql import functions as F

from quillgraph.functions import contacts as fc
from quillgraph.functions import texts as ft
from quillgraph.operators import cohorts


def told(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_blocks_meet_every_pair_once(spark):
    rows = [(k, m, f"{k}{m}") for k, n in (("hot", 90), ("small", 3), ("one", 1)) for m in range(n)] + [(None, 1, "x"), ("hot", None, "x")]
    df = spark.createDataFrame(rows, "k string, m int, t string")
    want = sorted((k, a, b) for k, n in (("hot", 90), ("small", 3)) for a, b in combinations(range(n), 2))
    for block in (7, 1024):
        got = [(r.k, r.a.m, r.b.m) for r in cohorts.blocked_pairs(df, ["k"], "m", block).collect()]
        assert sorted(got) == want
    assert cohorts.blocked_pairs(df.limit(0), ["k"], "m").count() == 0


def test_education_by_hand(spark):
    value = lambda *d: json.dumps({"degrees": [dict(zip(("school", "degree", "field"), x)) for x in d]})
    signals = [
        (1, 1, value(("The  Loom School.", "MBA", ""), ("loom school", "M.B.A. and mba", "Late"))), (2, 2, json.dumps(value(("Weave U", "Executive MBA", "Wool")))),
        (3, 3, json.dumps({"degrees": json.dumps([{"school": "LOOM SCHOOL", "degree": "Doctorate"}, 5, None])})), (4, 3, value(("Loom School", "Master of Arts"))), (5, 1, value(("Loom School", "MA"))),
        (6, 4, "{"), (7, 4, "[]"), (8, 4, None), (9, 4, '{"degrees": 3}'), (10, 4, value(("", "MBA"), ("Loom School", ""))),
    ]
    aliases = spark.createDataFrame([("weave u", "loom school")], "alias string, canonical string")
    got = {(r.person_id, r.connected_to, r.type): json.loads(r.value) for r in cohorts.education_signals(spark.createDataFrame(signals, "id long, person_id long, value string"), aliases).collect()}
    assert set(got) == {(1, "2", "same_mba_cohort"), (2, "1", "same_mba_cohort")}
    assert got[1, "2", "same_mba_cohort"] == {"connected_to": "2", "institution": "The  Loom School.", "institution_normalized": "loom school", "program": "Wool", "degree_a": "MBA", "degree_b": "Executive MBA", "degree_kind": "mba"}


def test_career_kinds_and_windows(spark):
    rows = [(1, 1, 2000, None, "x", "d", 50), (1, 1, 2010, 2012, "x", "d", 50), (1, 2, 2001, 2004, "x", "e", None), (1, 3, 2003, 2009, None, "d", 59), (1, 4, 2008, 2009, None, "d", None), (2, 9, 2000, 2001, None, None, None)]
    df = spark.createDataFrame(rows, "company_id int, person_id int, start_year int, end_year int, team string, domain string, seniority int")
    got = {(r.a, r.b): (r.type[15:], r.overlap_start_year, r.overlap_end_year, r.overlap_years) for r in cohorts.career_signals(df, 2025).collect()}
    assert got == {(1, 2): ("same_team", 2001, 2004, 3), (1, 3): ("same_domain", 2003, 2009, 6), (1, 4): ("general", 2008, 2009, 1), (2, 3): ("general", 2003, 2004, 1), (3, 4): ("general", 2008, 2009, 1)}


def test_company_and_school_keys(spark):
    assert told(spark, ["The Loom Co. ", "Loom Co.,", " Kestrel  Mills GmbH", "Mill Inc. Corp", "the ", None, "Plain-", "Weave S.A."], ft.employer_key) == ["loom", "loom co", "kestrel mills", "mill inc", "the", "", "plain", "weave"]
    assert told(spark, ["The  Art School -", None, "Thespian U"], ft.school_key) == ["art school", "", "thespian u"]
    assert told(spark, ["Tallgrass Technologies, Inc.", "A&B  Systems", None, "Été-Söhne"], ft.company_node_key) == ["tallgrass", "a b", "", "été söhne"]


def test_study_kinds(spark):
    assert told(spark, ["Executive MBA", "phd", "Executive", "BS", "MS", "BSc", "", None], ft.study_kind) == ["mba", "phd", "exec_ed", "undergrad", "masters", None, None, None]
    lists = [["EMBA"], ["AMP"], ["bachelor of arts", None], ["Master of Science"], ["PhD"], ["camp"], [], None]
    assert told(spark, lists, lambda v: ft.listed_study_kind(v, F.lit(None).cast("string")), "array<string>") == ["emba", "exec_ed", "bs", "ms", "phd", None, None, None]
    assert told(spark, [["PhD"]], lambda v: ft.listed_study_kind(v, F.lit("mba")), "array<string>") == ["mba"]


def test_addresses(spark):
    mails = ["Ada+x@Mail.Mill.com ", "bo@weave.co.uk", "c@dept.weave.co.uk", "d@gmail.com", "e@googlemail.com", "no mail", "f@host", None, "g@co.uk"]
    assert told(spark, mails, fc.email_domain) == ["mill.com", "weave.co.uk", "weave.co.uk", None, None, None, None, None, "co.uk"]
    assert told(spark, [" A@B.c ", "x", None], fc.email_key) == ["a@b.c", None, None]
    assert told(spark, ["https://X.example/In/Ada// ", "/", None], fc.url_key) == ["https://x.example/in/ada", None, None]
    assert told(spark, ["https://x.example/company/Mill/about", "Mill", "", "https://x.example/"], fc.company_page_slug) == ["mill", "mill", None, "https:"]
    assert told(spark, ["https://x.example/company/Mill/about", "x/company/", "x/my-company/a", None], fc.path_slug) == ["Mill", None, None, None]
    assert told(spark, ["mill.co.uk"], fc.domain_slug) == ["mill"]
    orgs = [[("GitHub", "https://GitHub.com/Ada/"), ("GitHub: bo", "")], [("Mill", "https://github.com/x"), ("github: Bo ", None)], [("GitHub:", "https://github.com/")], [], None]
    assert told(spark, orgs, fc.code_account, "array<struct<name:string,url:string>>") == ["ada", "Bo", None, None, None]


def test_tiers_and_press(spark):
    pairs = [("Defense and Aerospace", None), ("Aerospace", "x"), (None, "The Intel Mill"), ("Chipmaking", ""), ("Wool", "Intelligent Looms"), ("Research", "boeing"), (None, None)]
    assert told(spark, pairs, lambda v: ft.company_tier(v["i"], v["n"]), "struct<i:string,n:string>") == ["defense", "aerospace", "semiconductor", "semiconductor", "other", "defense", "other"]
    named = lambda *x: json.dumps({"headline": "Mill names two", "mentioned_executives": list(x)})
    payloads = ['{"headline": "Mill unveils a loom"}', named("A", {"name": "B"}), named("A", {"name": " "}, {"name": 5}, 7), '{"mentioned_executives": "A, B"}', "[", None, "[]"]
    assert told(spark, payloads, ft.press_kind) == ["product_launch", "co_mention_signal", "general", "general", "general", "general", "general"]


def test_members_are_dealt_once_over_all_tasks(spark):
    from quillgraph.operators.cohorts import talk_signals

    talks = spark.range(60).selectExpr("id", "id AS person_id", "'Loom day' AS event", "'2004' AS year", "'' AS title")
    got = talk_signals(talks.unionByName(talks.withColumn("year", F.lit("2005"))))
    assert got.count() == got.distinct().count() == 2 * 60 * 59
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") == 2  # one join of the members, told to both of a pair
    assert got.groupBy(F.spark_partition_id()).count().count() > 1
