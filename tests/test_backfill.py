"""The backfill chain and shaped records against hand-written expectations."""

import json

from pyspark.sql import functions as F

from quillgraph.operators.backfill import Backfill
from quillgraph.sources import shapes


def test_chain(spark):
    prospects = [
        (1, "Una Weld", "Keel Inc", "VP Sales", "u/1", ["Brine Ltd"]), (2, "UNA WELD", "keel", None, None, ["Brine", "Keel", "", None]), (3, "Tor Hale", None, "Staff Engineer", "u/3", None), (4, "T. Hale", "Mast", "Dyer", "u/3", ["Old"]),
        (5, "Tor Hale", None, None, None, ["Old"]), (6, None, "Keel Systems", "", None, None),
    ]
    careers = [(1, "Brine", "Dyer", "1990-1995"), (1, "BRINE LTD", None, "1993"), (1, "Keel", "Boss", "2001"), (1, "Rope", None, "1980-1970"), (2, "Brine", "Dyer", "1980"), (2, "Inc.", "x", "1999"), (4, "Sail", "", None)]
    chain = Backfill(
        spark.createDataFrame(prospects, "id int, name string, company string, role string, url string, past array<string>"), spark.createDataFrame(careers, "id int, company string, title string, years string")
    )
    assert {tuple(r) for r in chain.companies().collect()} == {("keel", "Keel"), ("brine", "BRINE LTD"), ("rope", "Rope"), ("mast", "Mast"), ("sail", "Sail"), ("old", "Old")}
    assert {tuple(r) for r in chain.persons().collect()} == {
        (1, 1, "una weld", "Una Weld", "u/1", "keel", "VP Sales", 70, "sales_marketing"), (3, 3, "tor hale", "Tor Hale", "u/3", None, "Staff Engineer", 45, None), (5, 5, "tor hale", "Tor Hale", None, None, None, None, None), (6, 6, "", None, None, "keel", None, None, None),
    }
    assert {tuple(r) for r in chain.stints().collect()} == {
        (1, "keel", "VP Sales", True, None, None), (3, "mast", "Dyer", True, None, None), (6, "keel", None, True, None, None), (1, "brine", "Dyer", False, 1990, 1995), (1, "rope", None, False, 1980, None), (3, "sail", None, False, None, None), (5, "old", None, False, None, None),
    }
    empty = Backfill(spark.createDataFrame([], "id int, name string, company string, role string, url string, past array<string>"), spark.createDataFrame([], "id int, company string, title string, years string"))
    assert empty.persons().count() == empty.stints().count() == empty.companies().count() == 0


def shaped(spark, shape, records):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(records)]
    return [tuple(r) for r in shape(spark.createDataFrame(rows, "i int, payload string")).orderBy("i").collect()]


def test_recognitions(spark):
    got = shaped(spark, shapes.recognitions, [{"name": "Una Weld", "year_elected": "1999", "citation": " ", "primary_affiliation": "Keel"}, {"name": " "}, {"name": 5}, {"name": "Tor", "year_elected": 2001, "company": "Mast", "primary_affiliation": "x", "location": "Oslo"}, {"name": "B", "year_elected": True}, {"name": "C", "year_elected": "c. 1990"}, "[]", None, "{"])
    assert got == [(0, "Una Weld", 1999, None, "Keel", None), (3, "Tor", 2001, None, "Mast", "Oslo"), (4, "B", None, None, None, None), (5, "C", None, None, None, None)]


def test_patents(spark):
    got = shaped(spark, shapes.patents, [
        {"patent_id": "1,234", "patent_title": "Loom", "patent_date": "2001-02-03", "assignees": [{"assignee_organization": "Keel"}, {"organization": "x"}]}, {"number": "9", "title": "Dye", "filing_date": "1999", "assignees": [{"organization": "Mast"}]}, {"patent_id": "", "patent_title": "none"}, {"patent_number": 7}, {"patent_number": "7", "assignees": ["x"], "title": 3},
    ])
    page = "https://patents.google.com/patent/US{}/"
    assert got == [(0, "1,234", "Loom", "", "2001-02-03", "Keel", page.format("1234")), (1, "9", "Dye", "1999", None, "Mast", page.format("9")), (4, "7", "", "", None, "", page.format("7"))]


def test_papers(spark):
    got = shaped(spark, shapes.papers, [
        {"paperId": "p", "title": "T", "venue": "V", "year": "2001", "citationCount": 7, "externalIds": {"DOI": "d"}, "authors": [{}, {}]}, {"title": "only", "venue": 3, "year": "soon", "citationCount": "9", "externalIds": {"doi": ""}, "authors": "x"}, {"paperId": "", "title": ""}, {"venue": "V"}, {"paperId": "q", "year": 1999},
    ])
    assert got == [(0, "T", "V", 2001, 7, "p", "d", 2), (1, "only", "", 0, 0, "", None, 0), (4, "", "", 1999, 0, "q", None, 0)]


def test_company_signals(spark):
    pages = spark.createDataFrame([(1, "u", [("Una", None, "b", None)], [("H", None, None, None, ["Una"], None)]), (2, "v", [], None)], "company_id int, page_url string, executives array<struct<name:string,title:string,bio:string,image_url:string>>, press_releases array<struct<headline:string,published_at:string,url:string,summary:string,mentioned_executives:array<string>,reporting_phrases:array<string>>>")
    got = shapes.company_signals(pages, F.lit("now")).orderBy("signal_type").collect()
    assert [(r.company_id, r.signal_type, r.source, json.loads(r.value), r.confidence, r.fetched_at) for r in got] == [
        (1, "executive_profile", "firecrawl_leadership", {"name": "Una", "bio": "b", "page_url": "u"}, 0.85, "now"), (1, "press_release", "firecrawl_press", {"headline": "H", "mentioned_executives": ["Una"], "page_url": "u"}, 0.9, "now"),
    ]
