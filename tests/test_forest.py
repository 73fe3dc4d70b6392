"""Cycles, layouts, assignments and beams against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import forest
from quillgraph.operators.beam import WARM_TYPES, warm_paths
from quillgraph.operators.graphs import down_the_tree
from quillgraph.operators.orgchart import assign


def plain_cycles(manager):
    found = set()
    for start in manager:
        path, node = [start], start
        while (node := manager.get(node)) is not None and node not in path:
            path.append(node)
        if node is not None:
            core = path[path.index(node) :]
            at = core.index(min(core))
            found.add(tuple(core[at:] + core[:at]))
    return found


@pytest.fixture
def rounds(monkeypatch):
    """Counts the tables that a loop writes."""
    count = [0]
    real = forest.stored

    def counted(df):
        count[0] += 1
        return real(df)

    monkeypatch.setattr(forest, "stored", counted)
    return count


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_and_confidences_of_random_edges(spark, seed):
    rnd = random.Random(seed)
    manager = {n: rnd.randrange(80) for n in rnd.sample(range(80), 72)} | {200: 200, 201: 200, 300: 301, 301: 300}
    edges = spark.createDataFrame([(r, m, 0.5 + r / 1000) for r, m in manager.items()], "report_id long, manager_id long, c double")
    got = {tuple(map(int, r.cycle.split(">"))) for r in forest.find_cycles(edges).collect()}
    assert got == plain_cycles(manager)
    want = {}
    for n in set(manager) | set(manager.values()):
        value, depth, at = 1.0, 0, n
        while at in manager and depth <= len(manager):
            value, depth, at = value * (0.5 + at / 1000), depth + 1, manager[at]
        if at not in manager:
            want[n] = (pytest.approx(value), depth)
    assert {r.node: (r.value, r.depth) for r in down_the_tree(edges, F.col("c")).collect()} == want


def test_long_ring_in_few_rounds(spark, rounds):
    ring = spark.range(5000).select(F.col("id").alias("report_id"), ((F.col("id") * 7 + 7) % 35000 / 7).cast("long").alias("manager_id"))
    members = forest.cycle_members(ring).collect()
    assert len(members) == 5000 and {r.least for r in members} == {0} and all(r.position == r.node for r in members)
    assert rounds[0] <= 16  # the edges, 13 doublings, and those that show the end
    rounds[0] = 0
    chain = spark.range(3000).select((F.col("id") + 1).alias("report_id"), F.col("id").alias("manager_id"))
    deep = forest.climbed(chain)
    assert deep.agg(F.max("depth")).first()[0] == 3000 and deep.filter("root = 0 AND depth = node").count() == 3000 and rounds[0] <= 15


def test_no_edges(spark):
    none = spark.createDataFrame([], "company_id long, report_id long, manager_id long")
    people = spark.createDataFrame([], "person_id long, domain string, seniority int, name string")
    assert forest.find_cycles(none).count() == 0 and forest.climbed(none).count() == 0 and forest.layout(none, people).count() == 0


def test_layout_equals_plain_search(spark):
    rnd = random.Random(4)
    edges = [(1, 11, 10), (1, 12, 10), (1, 13, 11), (1, 20, 21), (1, 21, 20), (1, 22, 21)]  # a tree, and leftovers on a cycle
    edges += [(2, 31, 30), (2, 30, 32), (2, 32, 31), (2, 33, 31), (2, 40, 41), (2, 41, 40)]  # cycles only
    edges += [(3, n, rnd.randrange(50, n)) for n in range(51, 80)] + [(4, 10, 11)]
    people = {n: (rnd.choice(["x", "y", None]), rnd.choice([10, 20, 30, None]), f"n{n % 5}") for n in range(90) if n % 9}
    frame = spark.createDataFrame([(n, *p) for n, p in people.items()], "person_id long, domain string, seniority int, name string")
    want = set()
    for company in (1, 2, 3, 4):
        own = [(r, m) for c, r, m in edges if c == company]
        ids, manager = {x for e in own for x in e}, dict(own)
        seniority = lambda n: (people.get(n) or (0, 0, 0))[1] or 0
        roots = ids - set(manager) or {min(ids, key=lambda n: (-seniority(n), n))}
        depth = {}
        level, d = roots, 0
        while level:
            depth |= dict.fromkeys(level, d)
            level, d = {r for r, m in own if m in level and r not in depth}, d + 1
        for at in set(depth.values()) | {0}:
            row = [n for n in ids if depth.get(n, 0) == at]
            key = lambda n: ((p := people.get(n, (None, None, None)))[0] is None, p[0] or "", p[1] is None, -(p[1] or 0), p[2] is None, p[2] or "", n)
            want |= {(company, n, at, i) for i, n in enumerate(sorted(row, key=key), 1)}
    got = forest.layout(spark.createDataFrame(edges, "company_id long, report_id long, manager_id long"), frame)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_assignment_equals_the_greedy_loop_under_tight_limits(spark, seed):
    rnd = random.Random(seed)
    tiers = {85: 8, 75: 7, 65: 8, 55: 10, 40: 12}
    seniority = {m: rnd.choice(list(tiers)) for m in range(8)}
    rows = [(c, "d", m, 100 + r, seniority[m], rnd.choice([0.4, 0.5, 0.55, 0.6, 0.7]), "x") for c in (1, 2) for m in range(8) for r in range(90) if rnd.random() < 0.8]
    frame = spark.createDataFrame(rows, "company_id long, domain string, manager_id long, report_id long, manager_seniority int, confidence double, dominant string")
    want, managed, used = set(), set(), {}
    for c, _, m, r, s, confidence, _ in sorted(rows, key=lambda r: (r[0], -r[5], r[2], r[3])):
        if confidence >= 0.45 and (c, r) not in managed and used.get((c, m), 0) < tiers[s]:
            managed.add((c, r))
            used[c, m] = used.get((c, m), 0) + 1
            want.add((c, m, r))
    assert {(r.company_id, r.manager_id, r.report_id) for r in assign(frame).collect()} == want
    assert len(managed) < 2 * 90  # the limits bind
    assert assign(frame.limit(0)).count() == 0


def plain_beam(edges, target, hops, least, types, sources, first, later, branches, top):
    ok = [e for e in edges if e[3] in types and e[4] >= least]
    front, every = [(1.0, [target], [])], []
    for hop in range(1, hops + 1):
        if hop > 1:
            front = sorted(front, key=lambda p: (-p[0], p[1], p[2]))[:branches]
        tips = {p[1][-1] for p in front}
        touching = sorted((e for e in ok if e[1] in tips or e[2] in tips), key=lambda e: (-e[4], e[0]))[: first if hop == 1 else later]
        after = []
        for s, nodes, used in front:
            for i, a, b, _, w in touching:
                for x, y in {(a, b), (b, a)}:
                    if x == nodes[-1] and y not in nodes and s * w >= least:
                        after.append((s * w, [*nodes, y], [*used, i]))
        every += after
        front = after
    best = {}
    for p in sorted(every, key=lambda p: (-p[0], len(p[1]), p[1], p[2])):
        best.setdefault(p[1][-1], p)
    held = [p for c, p in best.items() if sources is None or c in sources]
    return [(p[1][-1], round(p[0], 9), p[1], p[2]) for p in sorted(held, key=lambda p: (-p[0], p[1][-1]))[:top]]


@pytest.mark.parametrize(("hops", "caps", "sources"), [(4, (200, 1000, 200, 10), None), (3, (6, 15, 5, 4), None), (9, (10, 30, 8, 10), {3, 5, 7, 21, 22}), (1, (3, 3, 3, 10), None)])
def test_beam_equals_plain_rounds(spark, hops, caps, sources):
    rnd = random.Random(11)
    kinds = [*WARM_TYPES, "alumni_network"]
    edges = []
    for i in range(260):
        a, b = sorted(rnd.sample(range(40), 2)) if i % 6 else (0, rnd.randrange(1, 40))  # 0 is a hub
        edges.append((i, a, b, rnd.choice(kinds), rnd.choice([0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95])))
    df = spark.createDataFrame(edges, "id long, a long, b long, type string, strength double")
    targets = spark.createDataFrame([(0,), (1,), (2,), (99,), (1,)], "target long")
    held = None if sources is None else spark.createDataFrame([(s,) for s in sources], "connector long")
    for types in (None, ["co_investor", "same_phd_advisor", "typo", "alumni_network"]):
        names = dict(zip(("first_edges", "later_edges", "branches", "top"), caps, strict=True))
        got = warm_paths(df, targets, hops, 0.3, types, held, **names).collect()
        allowed = set(types or WARM_TYPES) & set(WARM_TYPES)
        for t in (0, 1, 2, 99):
            want = plain_beam(edges, t, min(hops, 4), 0.3, allowed, sources, *caps)
            assert [(r.connector, round(r.strength, 9), r.nodes, r.edges) for r in sorted(got, key=lambda r: r["rank"]) if r.target == t] == want


def test_best_managers_by_profiles_equal_those_of_all_pairs(spark, monkeypatch):
    from quillgraph.operators import orgchart

    rnd = random.Random(5)
    pick = lambda *of: rnd.choice(of)
    rows = [(pick(1, 1, 2, None), pick("a", "b", None), n, pick(*range(40, 60), None), pick(True, False, None), pick(0, 1, 2, None), pick(True, False, None)) for n in range(400)]
    rows += [(1, "a", 7, 41, False, 0, True), (1, "a", 7, 52, True, 1, False)]  # one person with two more rows
    members = spark.createDataFrame(rows, "company_id int, domain string, person_id long, seniority int, is_ic_track boolean, team int, is_manager_title boolean")
    want = sorted(map(tuple, orgchart.best_managers(orgchart.pair_scores(members)).collect()))
    assert sorted(map(tuple, orgchart.best_of_members(members).collect())) == want and want
    # a cluster twenty times as large has no more scored pairs
    seen, real = [], orgchart._scored
    monkeypatch.setattr(orgchart, "_scored", lambda *a: seen.append(real(*a)) or seen[-1])
    orgchart.best_of_members(members)
    orgchart.best_of_members(members.crossJoin(spark.range(20)).withColumn("person_id", F.col("person_id") + F.col("id") * 1000).drop("id"))
    assert seen[0].count() == seen[1].count()


def test_assignment_by_profiles_equals_that_of_all_pairs(spark, monkeypatch):
    from quillgraph.operators import orgchart

    rnd = random.Random(7)
    pick = lambda *of: rnd.choice(of)
    rows = [(pick(1, 1, 2, None), pick("a", "b", None), n, pick(*range(40, 90), None), pick(True, False, None), pick(0, 1, 2, None), pick(True, False, None)) for n in rnd.sample(range(-200, 2000), 700)]
    rows += [(3, "a", n, 60 if n < 3 else 50, False, 0, True) for n in range(90)]  # limits bind, and most reports stay without a manager
    members = spark.createDataFrame(rows, "company_id int, domain string, person_id long, seniority int, is_ic_track boolean, team int, is_manager_title boolean")
    want = sorted(map(tuple, assign(orgchart.pair_scores(members)).collect()))
    assert sorted(map(tuple, orgchart.assign_members(members).collect())) == want and len([w for w in want if w[0] == 3]) == 30
    assert orgchart.assign_members(members.limit(0)).count() == 0
    # a cluster twenty times as large has no more scored pairs, and no round is written
    monkeypatch.setattr(orgchart, "stored", None)
    seen, real = [], orgchart._scored
    monkeypatch.setattr(orgchart, "_scored", lambda *a: seen.append(real(*a)) or seen[-1])
    orgchart.assign_members(members)
    orgchart.assign_members(members.crossJoin(spark.range(20)).withColumn("person_id", F.col("person_id") + F.col("id") * 10000).drop("id"))
    assert seen[0].count() == seen[1].count()
