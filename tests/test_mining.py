"""Mining, checks, counters and the cascade against hand-written expectations."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import mining as ops
from quillgraph.operators import press
from quillgraph.operators.corrections import append_corrections
from quillgraph.operators.counters import counted, ledger
from quillgraph.streaming.cascade import cascade, last_done, results

INSTITUTIONS = [
    ("Brackwater School", "mba", "BWS"), ("Brackwater School", "mba", " brackwater "), ("Ostrava Poly", "phd", "OP"), ("Ostrava Poly", "phd", None), ("Løvenskiold", "undergrad", "løv"),
    ("Camp Nowhere", "other", "nowhere"), ("C.A.T.", "exec_ed", "c.a.t. executive (full)"), ("", "mba", "nothing"), (None, "mba", "none"), ("Shared", "phd", "bws"),
]
TEXTS = [
    (1, "Studied at BRACKWATER School, then nowhere."), (2, "brackwaters and xbws"), (3, "bws"), (4, "(Ostrava Poly)OP"), (5, "op"), (6, "LØV 9løv løv9"), (7, "the C.A.T.; c.a.t. executive (full)"),
    (8, None), (9, ""), (10, "line\nbws\n" * 3000), (10, "bws"), (11, "éBWS bwsé"),
]


@pytest.mark.parametrize("most", [ops.AUTOMATON_CHARACTERS, 20])
def test_alias_signals_equal_one_pattern_an_alias(spark, most):
    texts = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "id long, text string, school string")
    table = spark.createDataFrame(INSTITUTIONS, "canonical string, kind string, alias string")
    got = {tuple(r) for r in ops.alias_signals(texts, table, most).collect()}
    aliases = {(c, ops.DEGREES[k], a.strip().lower()) for c, k, alias in INSTITUTIONS if c and k in ops.DEGREES for a in (c, alias) if a and len(a.strip()) >= 3}
    want = {(i, c, d, 0.5) for i, t in TEXTS for c, d, a in aliases if re.search(rf"(?<![^\W_]){re.escape(a)}(?![^\W_])", (t or "").lower())}
    assert got == want and {i for i, *_ in want} == {1, 3, 4, 6, 7, 10}
    assert ops.alias_signals(texts, table.limit(0)).count() == 0 and ops.alias_signals(texts.limit(0), table).count() == 0


def test_payload_mentions(spark):
    inner = {"full_name": "Ida Ross", "position": "Lead"}
    payloads = {
        1: {"name": " Ann Lee ", "title": "CEO", "company": "Acme"}, 2: {"name": "Press Release", "executive_name": "Bo Kim"}, 3: {"name": "", "person_name": "Bo Kim", "role": 7, "issuer": True},
        4: {"company_name": "Parent", "people": [inner, {"name": "cher"}, "Ann Lee", {"name": "Max Orr", "employer": "Own"}], "leaders": inner, "appointees": [[inner]]},
        5: [[[{"name": "Deep Down"}]], [], 5, None, json.dumps({"exec": "Text Told"}), "plain"], 6: json.dumps(json.dumps(inner)), 7: "null", 8: {"name": ["Ann Lee"]}, 9: {"name": "Ann Lee, Inc."}, 10: {"name": "O'Hara-Smith jr"}, 11: {"name": "12 34"},
    }
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in payloads.items()] + [(20, None), (21, "{broken"), (22, "")]
    got = {tuple(r) for r in ops.payload_mentions(spark.createDataFrame(rows, "id long, payload string")).collect()}
    assert got == {
        (1, "Ann Lee", "CEO", "Acme"), (3, "Bo Kim", "7", "True"), (4, "Ida Ross", "Lead", "Parent"), (4, "Max Orr", None, "Own"), (5, "Deep Down", None, None), (5, "Text Told", None, None), (10, "O'Hara-Smith jr", None, None),
    }
    assert ops.payload_mentions(spark.createDataFrame([], "id long, payload string")).count() == 0


def test_roster_members(spark):
    page = "- Una Weld, Brine Works\n|\n## Valve Committee\n|\n* Tor Hale (Keel Ltd)\n|\nsince 2015\n|\n**Old Board**\n|\nMia Day Orr\n|\n- Solo\n|\n- X Yz\n|\n# Ada Poe\n|\n" + "z" * 210 + "\n|\n- Eva Finn — Mast & Co\n|\nyear 1999"
    rows = spark.createDataFrame([(1, "Body", page), (2, "Body", None), (3, None, "Ulf Orm"), (4, "B", "")], "id long, body string, markdown string")
    got = [tuple(r) for r in ops.roster_members(rows).collect()]
    assert got == [
        (1, "Body", "Una Weld", "2015-present"), (1, "Valve Committee", "Tor Hale", "2015-present"), (1, "Old Board", "Mia Day Orr", "2015-present"), (1, "Ada Poe", "Eva Finn", "1999"), (3, None, "Ulf Orm", "unknown"),
    ]
    # a company's name may run on over the next lines, as the pattern has it
    run_on = ops.roster_members(spark.createDataFrame([(1, "B", "- Una Weld, Brine\n- Tor Hale (2001-2004)")], "id long, body string, markdown string")).collect()
    assert [tuple(r) for r in run_on] == [(1, "B", "Una Weld", "2001-2004")]


def test_program_speakers(spark):
    page = "- Una Weld, opening keynote\n### Pumps\n**Panelists:** Tor Hale — Keel\n12. Mia Orr (Session Chair Ltd)\n|\n* Eva Finn - session chair\n## Ropes\n- Ann Lee, panel\n- Bo"
    rows = spark.createDataFrame([(1, page), (2, None)], "id long, markdown string")
    got = sorted(tuple(str(x) for x in r) for r in ops.program_speakers(rows).collect())
    assert got == sorted([("1", "None", "Una Weld", "keynote"), ("1", "Pumps", "Tor Hale", "speaker"), ("1", "Pumps", "Mia Orr", "speaker"), ("1", "Pumps", "Eva Finn", "session_chair"), ("1", "Ropes", "Ann Lee", "panelist")])


def test_memberships_take_the_last_of_equal_names(spark):
    people = spark.createDataFrame([(1, "una weld"), (7, "una weld"), (3, "tor hale"), (4, ""), (5, None)], "person_id long, folded string")
    rows = [("B", "c", "una weld", "2001-2004"), ("B", "c", "una weld", "2001"), ("B", "c", "una weld", "unknown"), ("B", "c", "una weld", "1900-2101"), ("B", "d", "tor hale", "2015-present"), ("B", "d", "nobody", "2000"), ("B", "d", "", None)]
    got = {tuple(r) for r in ops.memberships(spark.createDataFrame(rows, "organization string, committee string, folded string, years string"), people).collect()}
    assert got == {(7, "B", "c", 2001, 2004), (7, "B", "c", None, None), (3, "B", "d", 2015, None)}


def test_co_mentions_need_sole_matches_and_no_stronger_edge(spark):
    people = [(1, 1, "Una Weld"), (2, 1, "Tor B. Hale"), (3, 1, "Mia Orr"), (4, 1, "Mia Orr-Day"), (5, 2, "Una Weld"), (6, 1, "Eva Finn"), (7, None, "Una Weld")]
    names = [(10, 1, "2024-01-01", ["UNA  weld", "Una Weld", "Tor Hale", "Mia Orr"]), (11, 1, "2025-01-01", ["Tor Hale", "Una Weld", None, " "]), (12, 1, "2025-01-01", ["Una Weld"]), (13, 1, "2025-06-01", ["Eva Finn", "Una Weld", "Solo"]), (14, 2, "2025-01-01", ["Una Weld", "Tor Hale"]), (15, None, "2025-01-01", ["Una Weld", "Tor Hale"]), (16, 1, "2025-01-01", None)]
    releases = spark.createDataFrame(names, "id long, company_id long, day string, names array<string>").withColumn("released_at", F.to_date("day"))
    persons = spark.createDataFrame(people, "person_id long, company_id long, name string")
    edges = spark.createDataFrame([(6, 1, "co_investor", 0.78), (1, 2, "alumni_network", 0.25), (1, 2, "mentioned_in_same_release", 0.55)], "a long, b long, type string, base double")
    got = press.co_mention_edges(releases, persons, edges, F.lit("2026-01-01").cast("date")).collect()
    assert [(r.a, r.b, r.corroborations, r.last_active_year) for r in got] == [(1, 2, 2, 2025)]
    assert got[0].strength == pytest.approx(0.55 * 2.718281828459045 ** (-0.1 * 365 / 365.25) * (1 + 0.1 * 0.6931471805599453) * 1.1)
    assert {tuple(r) for r in press.matched_persons(releases.select("company_id", F.explode("names").alias("name")), persons).filter("persons > 1").collect()} == {(1, "Mia Orr", 3, 2)}


def test_corrections_are_split_and_stamped_in_one_write(spark, tmp_path):
    rows = [
        (1, "are_peers", "u", None, None), (None, "are_peers", "u", None, None), (1, "rude", "u", None, None), (1, None, "u", None, None), (1, "team_wrong", "u", "", None), (1, "team_wrong", "u", "x", '{"manager_title": 0.25}'),
        (1, "are_peers", " ", None, None), (1, "are_peers", "u", None, '{"other": 0.1}'), (1, "are_peers", "u", None, '{"manager_title": "0.1"}'), (1, "are_peers", "u", None, '{"manager_title": null}'), (1, "are_peers", "u", None, '{"manager_title": -1}'), (1, "are_peers", "u", None, "[]"), (1, "are_peers", "u", None, "{}"),
    ]
    df = spark.createDataFrame(rows, "person_a_id long, kind string, submitted_by string, value string, attributions string")
    for _ in range(2):
        append_corrections(df, str(tmp_path / "c"), F.lit("2026-02-03 04:05:06").cast("timestamp"))
    kept = spark.read.parquet(str(tmp_path / "c"))
    assert kept.filter("accepted = 1").count() == 2 * 3 and kept.filter("accepted = 0 AND problem IS NOT NULL").count() == 2 * 10
    assert {r[0] for r in kept.filter("accepted = 0").select("problem").collect()} == {
        "no person", "unknown kind", "needs a value", "nobody submitted it", "unknown component", "attribution is no number", "attribution outside 0 to 1", "attributions are no object",
    }
    assert kept.select("updated_at").distinct().count() == 1


def test_counters_are_taken_while_writing(spark):
    table, seen = counted("odd", spark.range(1000).filter("id % 3 = 0"), {"rows": F.count("*"), "largest": F.max("id")})
    assert seen == {"rows": 334, "largest": 999} and table.count() == 334
    none, empty = counted("none", spark.range(0), {"rows": F.count("*"), "largest": F.max("id")})
    assert none.count() == 0
    assert {tuple(r) for r in ledger(spark, {"odd": seen, "none": empty}).collect()} == {("odd", "rows", 334.0), ("odd", "largest", 999.0), ("none", "rows", 0.0), ("none", "largest", 0.0)}


def test_cascade_runs_each_job_once_though_it_is_stopped_in_between(spark, tmp_path):
    src, state, calls, broken = str(tmp_path / "in"), str(tmp_path / "state"), [], [False]

    def job(name):
        def run(rows, folder):
            calls.append((name, rows.count()))
            rows.agg(F.sum("id").alias("total")).write.mode("overwrite").parquet(folder)
            if name == "second" and broken[0]:
                broken[0] = False
                raise RuntimeError("stopped in the second job")

        return name, run

    jobs = [job(n) for n in ("first", "second", "third")]

    def come(low, high):
        spark.range(low, high).coalesce(1).write.mode("append").parquet(src)
        cascade(spark.readStream.schema("id long").parquet(src), jobs, state, str(tmp_path / "cp"), threshold=50)

    come(0, 30)
    assert calls == [] and last_done(spark, state) == -1  # too few
    broken[0] = True
    with pytest.raises(Exception, match="stopped in the second job"):
        come(30, 80)
    assert calls == [("first", 80), ("second", 80)]
    come(80, 90)  # the failed batch comes again, and then ten rows that wait
    assert calls == [("first", 80), ("second", 80), ("second", 80), ("third", 80)]
    come(90, 140)
    assert calls[4:] == [("first", 60), ("second", 60), ("third", 60)]
    for name in ("first", "second", "third"):
        assert sorted(r.total for r in results(spark, state, name).collect()) == [sum(range(80)), sum(range(80, 140))]


def test_payload_people_sql_leaves_out_every_name_with_a_company_word(spark):
    import duckdb

    from quillgraph.operators import mining as ops
    from quillgraph.plans import registry

    names = ["Asga co", "CO Welt", "Una Weld", "Mia Inc.", "Acme Inc", "Tor ,VP, Hale", "Cox Incas", "una weld", "Ann Lee-Press"]
    told = [(i, f'{{"name": "{n}", "company": "X"}}') for i, n in enumerate(names)]
    sql = registry.ORACLES["payload_people"]
    con = duckdb.connect()
    con.execute("CREATE TABLE told (id BIGINT, payload VARCHAR)")
    con.executemany("INSERT INTO told VALUES (?, ?)", told)
    want = sorted(con.sql("WITH RECURSIVE payloads AS (SELECT * FROM told), " + sql[sql.index("items AS (") :]).fetchall())
    got = ops.payload_mentions(spark.createDataFrame(told, "id long, payload string"))
    assert sorted(map(tuple, got.collect())) == want
    assert [r[1] for r in want] == ["Una Weld", "Cox Incas", "Ann Lee-Press"]
