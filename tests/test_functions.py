"""Column functions against stated constants."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import scoring as fs
from quillgraph.functions import texts as ft
from quillgraph.operators.graphs import down_the_tree
from quillgraph.operators.merges import history_merge


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("args", "want"), [((0.4, 0.1, 10, 1, 0), 0.1471517765), ((0.3, 0.02, 5, 20, 3), 0.5114596564), ((0.6, 0.0, 40, 8, 5), 0.99)])
def test_strength(spark, args, want):
    assert one(spark, fs.strength(*map(F.lit, args))) == pytest.approx(want)


@pytest.mark.parametrize(("value", "want"), [("5", 5), ('"5"', 5), ('{"value": 5}', 5), ("true", 1), ("abc", 0), (None, 0), ("[1]", 0)])
def test_json_scalar(spark, value, want):
    assert one(spark, fs.json_scalar(F.lit(value).cast("string"))) == want


@pytest.mark.parametrize(("gap", "want"), [(8, 0.3), (15, 0.3), (5, 0.18), (7, 0.18), (16, 0.12), (25, 0.12), (4, 0), (26, 0), (-3, 0)])
def test_gap(spark, gap, want):
    assert one(spark, fs.gap_score(F.lit(gap))) == want


def test_path_confidences(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.75), (4, 5, 0.6), (8, 9, 0.5), (9, 8, 0.5)], "manager_id long, report_id long, c double")
    got = {r.node: round(r.value, 3) for r in down_the_tree(edges, F.col("c")).collect()}
    assert got == {1: 1.0, 2: 0.9, 3: 0.72, 4: 0.54, 5: 0.324}


@pytest.mark.parametrize(
    ("title", "domain", "seniority"),
    [("Senior Vice President, Sales", "general_management", 95), ("Principal Engineer", "hardware_engineering", 48), ("", None, None), (None, None, None), ("VP of Research", "research", 70)],
)
def test_titles(spark, title, domain, seniority):
    t = F.lit(title).cast("string")
    assert one(spark, ft.domain_from_title(t)) == domain
    assert one(spark, ft.seniority_from_title(t)) == seniority


@pytest.mark.parametrize(("name", "want"), [("Dr. Oskar T. Lindqvist, Jr.", ("Oskar", "Lindqvist")), ("Marisol V. Tessaly", ("Marisol", "Tessaly")), ("Zephyrine", ("", ""))])
def test_names(spark, name, want):
    assert tuple(one(spark, ft.name_parts(F.lit(name)))) == want


@pytest.mark.parametrize(("text", "want"), [("2009-2014", (2009, 2014)), ("2011-present", (2011, None)), ("1987", (1987, None)), ("every spring", (None, None))])
def test_years(spark, text, want):
    assert tuple(one(spark, ft.year_range(F.lit(text)))) == want


def test_history_merge_is_idempotent(spark):
    schema = "report_id long, manager_id long, method string, confidence double"
    now = spark.createDataFrame([(1, 9, "m", 0.5), (2, 9, "m", 0.7)], schema)
    assert {r.action for r in history_merge(now, now, F.current_date()).collect()} == {"keep"}
    new = spark.createDataFrame([(1, 9, "m", 0.51), (2, 8, "m", 0.7), (3, 8, "m", 0.4)], schema)
    got = sorted((r.report_id, r.manager_id, r.action) for r in history_merge(now, new, F.current_date()).collect())
    assert got == [(1, 9, "keep"), (2, 8, "open"), (2, 9, "close"), (3, 8, "open")]


def test_simple_paths_of_many_hops_equal_a_plain_search(spark):
    from quillgraph.operators.graphs import simple_paths

    links = [(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.95), (4, 5, 0.9), (5, 6, 0.9), (1, 3, 0.8), (2, 4, 0.5), (3, 5, 0.7), (6, 7, 0.2)]
    edges = spark.createDataFrame(links, "a long, b long, strength double")
    sources = spark.createDataFrame([(1,), (7,)], "source long")
    ways = links + [(b, a, s) for a, b, s in links]
    for hops, distinct in ((3, "node-set"), (5, "node-set"), (5, "edge-set")):
        want, stack = {}, [((1,), 1.0), ((7,), 1.0)]
        while stack:
            nodes, strength = stack.pop()
            if len(nodes) > 1:
                steps = [tuple(sorted(p)) for p in zip(nodes, nodes[1:])]
                key = (nodes[0], nodes[-1], tuple(sorted(nodes if distinct == "node-set" else steps)))
                want[key] = max(want.get(key, 0), strength)
            if len(nodes) <= hops:
                stack += [((*nodes, b), strength * s) for a, b, s in ways if a == nodes[-1] and b not in nodes and strength * s >= 0.3]
        got = simple_paths(edges, sources, hops, 0.3, distinct).collect()
        assert sorted((r.source, r.tip, round(r.strength, 9)) for r in got) == sorted((k[0], k[1], round(v, 9)) for k, v in want.items())
        assert max(r.hops for r in got) == hops


def test_long_cycles_and_deep_trees_are_walked_to_the_end(spark):
    from quillgraph.operators.forest import find_cycles

    ring = [(k, k + 1 if k < 9 else 1) for k in range(1, 10)] + [(20, 3), (30, 31), (31, 32)]
    edges = spark.createDataFrame(ring, "report_id long, manager_id long")
    assert [(r.least, r.cycle) for r in find_cycles(edges).collect()] == [(1, "1>2>3>4>5>6>7>8>9")]
    chain = spark.createDataFrame([(k, k + 1, 0.9) for k in range(15)], "manager_id long, report_id long, c double")
    got = {r.node: r.depth for r in down_the_tree(chain, F.col("c")).collect()}
    assert got == {k: k for k in range(16)}


def test_best_strengths_equal_the_best_listed_paths(spark):
    import random

    from quillgraph.operators.graphs import best_paths, best_strengths

    rnd = random.Random(5)
    pairs = {tuple(sorted(rnd.sample(range(30), 2))) for _ in range(70)}
    rows = [(a, b, rnd.choice([0.2, 0.5, 0.65, 0.7, 0.75, 0.95, 1.0])) for a, b in sorted(pairs)]
    rows += [(a, b, 0.9) for a, b, _ in rows[::5]]  # parallel edges
    edges = spark.createDataFrame(rows, "a long, b long, strength double")
    targets = spark.createDataFrame([(t,) for t in (*range(12), 99)], "target long")
    for hops in (1, 2, 3):
        want = {(r.target, r.connector): r.strength for r in best_paths(edges, targets, hops, 0.3).collect()}
        found = best_strengths(edges, targets, hops, 0.3, cell=(5, 7)).collect()
        assert {(r.target, r.connector): r.strength for r in found} == want and len(found) == len(want) > 20


def test_path_counts_equal_the_listed_paths(spark, monkeypatch):
    import random

    from quillgraph.operators import graphs
    from quillgraph.operators.graphs import path_counts, simple_paths

    rnd = random.Random(6)
    monkeypatch.setattr(graphs, "TIP_WAYS", 60)  # several blocks of tips
    links = {tuple(sorted(rnd.sample(range(-9, 20), 2))): rnd.choice([0.3, 0.5, 0.65, 0.7, 0.75, 0.95, 1.0]) for _ in range(110)}
    edges = spark.createDataFrame([(*p, s) for p, s in links.items()], "a long, b long, strength double")
    sources = spark.createDataFrame([(t,) for t in (*range(12), 99)], "source long")
    for hops in (2, 3):
        listed = simple_paths(edges, sources, hops, 0.3).groupBy("source", "tip").agg(F.count("*").alias("n"), F.max("strength").alias("s"), F.min("hops").alias("h")).collect()
        got = path_counts(edges, sources, hops, 0.3)
        assert sorted((r.source, r.tip, r.paths, round(min(0.99, r.best), 9), r.shortest) for r in got.collect()) == sorted((r.source, r.tip, r.n, round(r.s, 9), r.h) for r in listed)


def test_best_paths_write_nothing_between_hops(spark, monkeypatch):
    from quillgraph.operators import graphs
    from quillgraph.plans.graphs import best_paths

    written = []
    monkeypatch.setattr(graphs, "stored", lambda df, f=graphs.stored: written.append(df.columns) or f(df))
    assert best_paths(spark, "/root/testdata/sf0.001").columns == ["target", "connector", "strength"]
    assert written and not any("target" in c or "tip" in c for c in written)  # the edges alone
