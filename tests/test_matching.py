"""Matching of records and names against plain loops over all pairs."""

import random
from collections import defaultdict
from difflib import SequenceMatcher, get_close_matches

import pytest

from quillgraph.operators import matching as ops
from quillgraph.operators.components import components
from quillgraph.operators.similar import canonical_names, similar_names

RECORD = "id long, url string, account string, email string, reference string, first string, last string, company string, priority int, title string"


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def same(a, b, least=0.88):
    """The six rules on two records, one after the other."""
    text = lambda x: (x or "").strip().lower()
    u, v = text(a["url"]).rstrip("/"), text(b["url"]).rstrip("/")
    if u and v:
        return u == v
    if a["account"] and a["account"] == b["account"]:
        return True
    e, f = (text(x["email"]) if "@" in (x["email"] or "") else "" for x in (a, b))
    if e and f:
        return e == f
    if a["reference"] and a["reference"] == b["reference"]:
        return True
    c, d = (x["company"] or "" for x in (a, b))
    if not (c and c.lower() == d.lower() and a["first"] and b["first"]):
        return False
    m, n = sorted(" ".join(sorted(f"{x['first']} {x['last'] or ''}".lower().split())) for x in (a, b))
    return SequenceMatcher(None, m, n).ratio() >= least


def random_records(seed, count):
    rnd = random.Random(seed)
    names = [("Ann", "Lee"), ("Anne", "Lee"), ("Lee", "Ann"), ("Bartholomew", "Quistgaard"), ("Bartolomew", "Quistgaard"), ("Bartholomew", "Quistgard"), ("Zoë", "Ødegård"), ("Zoe", "Odegard"), ("", "Solo"), ("Mia", None)]
    some = lambda values, share: rnd.choice(values) if rnd.random() < share else rnd.choice([None, ""])
    rows = []
    for i in range(count):
        first, last = rnd.choice(names)
        rows.append({
            "id": i, "url": some(["https://u/1", "https://u/2/", " HTTPS://U/2", "https://u/3", "https://u/4"], 0.3), "account": some(["a1", "a2", "a3", "a4", "a5"], 0.05),
            "email": some(["x@m", "X@M ", "y@m", "z@m", "nomail"], 0.3), "reference": some(["r1", "r2", "r3"], 0.04), "first": first, "last": last,
            "company": some([f"c{k}" for k in range(count // 4)] + ["C1"], 0.8), "priority": rnd.choice([80, 60, 20]), "title": some(["t1", "t2", "t3"], 0.5),
        })
    return rows


@pytest.mark.parametrize(("seed", "count"), [(1, 40), (2, 120), (3, 120)])
def test_persons_equal_components_of_all_matching_pairs(spark, seed, count):
    rows = random_records(seed, count)
    want = union_find(range(count), [(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and same(a, b)])
    resolved = ops.resolve(spark.createDataFrame([tuple(r.values()) for r in rows], RECORD))
    assert {r.id: r.person_id for r in resolved.collect()} == want
    assert len(set(want.values())) not in (1, count)
    groups = defaultdict(list)
    for r in rows:
        groups[want[r["id"]]].append(r)
    one = {r.person_id: r for r in ops.merged(resolved, ["title", "email"], spellings=["last"]).collect()}
    for k, own in groups.items():
        own = sorted(own, key=lambda r: (-r["priority"], r["id"]))
        first = lambda f: next((r[f] for r in own if r[f]), None)  # noqa: B023, E731
        spelled = {}
        for r in own:
            if r["last"]:
                spelled.setdefault(r["last"].lower(), r["last"])
        assert (one[k].title, one[k].email, one[k].records) == (first("title"), first("email"), len(own))
        assert (one[k].last_variants or []) == sorted(spelled.values())


def test_block_of_equal_names_gives_links_in_proportion(spark):
    rows = [(i, f"https://u/{i}" if i % 3 == 0 else None, None, f"{i}@m" if i % 3 == 1 else None, None, "Ann", "Lee", "one", 1, None) for i in range(600)]
    links = ops.match_links(spark.createDataFrame(rows, RECORD))
    assert links.count() < 3 * 600  # not the 179,700 pairs
    assert components(links).select("label").distinct().count() == 1
    apart = spark.createDataFrame([r for r in rows if r[0] % 3 == 0], RECORD)  # addresses refuse every pair
    assert ops.match_links(apart).count() == 0 and ops.resolve(apart).select("person_id").distinct().count() == 200
    assert ops.resolve(apart.limit(0)).count() == 0


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(400)] + [(5000, 5001 + i) for i in range(50)]
    want = union_find({n for link in links for n in link}, links)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n in got} and all(want[n] == n for n in want.keys() - got.keys())


@pytest.mark.parametrize("least", [0.88, 0.7])
def test_similar_names_misses_no_pair_at_the_threshold(spark, least):
    rnd = random.Random(7)
    base = ["".join(rnd.choices("abcdeé ", k=rnd.randint(1, 30))) for _ in range(60)]
    names = set(base) | {"", "a", "ab", "x" * 250, "x" * 249 + "y"}
    for b in base:
        for _ in range(3):
            c = list(b)
            for _ in range(rnd.randint(1, 1 + len(c) // 7)):
                at = rnd.randrange(len(c) + 1)
                c[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "q"])
            names.add("".join(c))
    names = sorted(names)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name, r.other): r.ratio for r in similar_names(df, df, least=least).collect()}
    want = {(a, b): q for a in names for b in names if a and b and (q := SequenceMatcher(None, a, b).ratio()) >= least}
    assert got == want and min(want.values()) < least + 0.01 and len(want) > 300


def test_canonical_names_equal_the_plain_lookup(spark):
    table = {"North Alder Institute": ["NAI", "Alder Institute"], "South Alder Institute": ["SAI"], "Quarry Hill College": ["Quarry Hill", "QHC"]}
    raw = ["nai", "north alder INSTITUTE ", "Nort Alder Institute", "Sout Alder Institute", "Quary Hill", "Quarry Hil Colege", "Alder Institut", "north alder institut", "elsewhere", "", "  ", None, "QHC", "QHX"]
    aliases = spark.createDataFrame([(c, a) for c, own in table.items() for a in own], "canonical string, alias string")

    def plain(name):
        if not name or not name.strip():
            return None
        universe = [x for c, own in table.items() for x in (c, *own)]
        hits = [x for x in universe if x.lower() == name.lower().strip()] or get_close_matches(name, universe, n=1, cutoff=0.88)
        return next((c for c, own in table.items() if hits and hits[0] in (c, *own)), None)

    got = {r.name: r.canonical for r in canonical_names(spark.createDataFrame([(r,) for r in raw], "name string"), aliases).collect() if r.name is not None}
    assert got == {r: plain(r) for r in raw if r is not None}
    assert sum(v is not None for v in got.values()) >= 8


def test_shared_groups_count_without_lists(spark):
    import random

    from quillgraph.operators.pairs import shared_groups

    rnd = random.Random(3)
    member = [(rnd.randrange(9), rnd.randrange(12)) for _ in range(60)]
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12) if rnd.random() < 0.5]
    of = lambda p: {c for c, x in member if x == p}
    want = sorted((a, b, n) for a, b in pairs if (n := len(of(a) & of(b))))
    got = shared_groups(spark.createDataFrame(pairs * 2, "a long, b long"), spark.createDataFrame(member, "company_id long, person_id long"))
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan


def test_executives_match_by_one_person_an_end(spark):
    from quillgraph.plans.search import executive_match

    plan = executive_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # persons are folded below the join with suppliers
    join = plan.index("Join")
    assert plan.count("Aggregate") == 2 and plan.index("Aggregate") < join < plan.rindex("Aggregate")


def test_blocked_join_deals_a_hot_key(spark):
    from pyspark.sql import functions as F

    from quillgraph.operators.pairs import blocked_join

    left = spark.range(300).select(F.when(F.col("id") % 10 > 0, 1).when(F.col("id") % 20 == 0, 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(130).select(F.when(F.col("id") % 13 > 0, 1).otherwise(3).alias("k"), F.col("id").alias("b"))
    right = right.unionByName(right.limit(3))  # equal rows count each
    got = blocked_join(left, right, ["k"], block=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, ["k"]).collect()))
    # no join key holds more than a few blocks' rows, of 32400 in all
    spread = blocked_join(left.withColumn("a", F.struct("a")), right, ["k"], block=16)
    assert spread.count() == got.count()
    from quillgraph.plans.pairs import or_join
    from quillgraph.plans.search import cohort_cross_reference

    for query in (or_join, cohort_cross_reference):
        assert "_i" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_pair_counts_equal_plain_counts_and_shuffle_no_pairs(spark, monkeypatch):
    import random
    from collections import Counter
    from itertools import combinations

    from quillgraph.operators import pairs as ops
    from quillgraph.plans.graphs import sparse_edges

    monkeypatch.setattr(ops, "PAIRS_AT_ONCE", 50)
    rnd = random.Random(8)
    rows = [(None, 1), ("d1", None)] + [(f"d{min(rnd.randrange(12), 5)}", rnd.randrange(-20, 40)) for _ in range(400)] * 2
    days = {}
    for k, m in rows:
        if k is not None and m is not None:
            days.setdefault(k, set()).add(m)
    want = Counter(p for day in days.values() for p in combinations(sorted(day), 2))
    df = spark.createDataFrame(rows, "k string, m long")
    for least, block_rows in ((1, 1 << 19), (2, 20), (4, 100)):
        got = {(r.a, r.b): r.n for r in ops.pair_counts(df, "k", "m", least, block_rows).collect()}
        assert got == {p: n for p, n in want.items() if n >= least}
    assert ops.pair_counts(df.limit(0), "k", "m").count() == 0
    plan = sparse_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan


def test_co_author_steps_spread_by_rows(spark, monkeypatch):
    from quillgraph.operators import stored
    from quillgraph.plans import graphs, merges, pairs

    sf = "/root/testdata/sf0.001"
    names = (pairs.pair_buckets, pairs.merged_edges, graphs.neighbor_sets, graphs.warm_edge_counts, graphs.edge_explanations, merges.evidence_keys)
    want = [sorted(map(repr, q(spark, sf).collect())) for q in names]
    monkeypatch.setattr(stored, "PARTITION_ROWS", 500)
    for q, rows in zip(names, want, strict=True):
        got = q(spark, sf)
        assert sorted(map(repr, got.collect())) == rows
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression" in plan and ", 12" in plan  # 6000 rows of line items
    assert stored.spread(spark.range(10), 5000, "id").rdd.getNumPartitions() == 10


def test_blocks_of_a_hot_key_are_many_tasks(spark):
    from pyspark.sql import functions as F

    from quillgraph.operators.pairs import blocked_join

    left = spark.range(40).selectExpr("1 AS k", "id AS a")
    right = spark.range(30).selectExpr("1 AS k", "id AS b")
    got = blocked_join(left, right, ["k"], block=8)
    assert got.count() == got.distinct().count() == 1200
    # few bytes, but the pairs are dealt over tasks all the same
    assert got.groupBy(F.spark_partition_id()).count().count() > 1


def test_names_are_dealt_over_tasks_and_nothing_is_broadcast(spark):
    df = spark.createDataFrame([(f"name of {i * i:07d}",) for i in range(4000)], "name string").coalesce(1)
    plan = similar_names(df, df)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # either side is small, and its pieces grow with it
    dealt = plan.count("REPARTITION_BY_NUM")
    assert dealt == 2, "each side is dealt before it becomes many rows"


def test_components_and_records_broadcast_nothing(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40) if i % 10], "a long, b long")
    got = components(links)
    assert {r.node: r.label for r in got.collect()} == {i: (i - 1) // 10 * 10 + 1 for i in range(1, 41)}
    records = spark.createDataFrame([(1, "u/1", None, None, None, "Ada", "Low", "Mill"), (2, "u/1", None, None, None, "Ada", "Lowe", "Mill"), (3, None, None, None, None, "Bo", "X", None)],
                                    "id long, url string, account string, email string, reference string, first string, last string, company string")
    one = ops.resolve(records)
    assert "Broadcast" not in one._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.person_id for r in one.collect()} == {1: 1, 2: 1, 3: 3}


def _plain_counts(members):
    from collections import Counter

    ids = sorted(members)
    return Counter({(a, b): n for i, a in enumerate(ids) for b in ids[i + 1 :] if (n := len(members[a] & members[b]))})


def test_pairs_of_keys_count_as_the_keys_do(monkeypatch):
    import random

    import numpy as np

    from quillgraph.operators import pairs as ops

    monkeypatch.setattr(ops, "PAIRS_AT_ONCE", 300)
    monkeypatch.setattr(ops, "FEW_KEYS", 6)
    rnd = random.Random(3)
    many = {m: set(rnd.sample(range(60), rnd.choice([1, 2, 4, 5, 6, 6, 9, 30]))) for m in range(-40, 360)}
    many |= {m + 1000: set(keys) for m, keys in many.items()}
    want = _plain_counts(many)

    def block(ids):
        rows = [(k, m) for m in sorted(ids) for k in rnd.sample(sorted(many[m]), len(many[m]))]
        keys, members = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        return keys, members, members % 3 == 0

    one, two = block([m for m in many if m % 2]), block([m for m in many if m % 2 == 0])
    for least in (1, 2, 3):
        got = {}
        for cell in ((one, None), (two, None), (one, two)):
            for a, b, n in ops._counted(*cell, least, None):
                for p, k in zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True):
                    assert p not in got
                    got[p] = k
        assert got == {p: n for p, n in want.items() if n >= least and (p[0] % 3 == 0 or p[1] % 3 == 0)}
    made = []
    monkeypatch.setattr(ops, "_two_keys", lambda *x, f=ops._two_keys: made.append(1) or f(*x))
    list(ops._counted(one, two, 2, None))
    assert made  # pairs that share one key only are never made


def test_pair_counts_of_asked_members_and_of_the_best(spark):
    import random

    from pyspark.sql import functions as F

    from quillgraph.operators.pairs import pair_counts

    rnd = random.Random(4)
    days = {m: {rnd.randrange(25) for _ in range(rnd.randrange(1, 12))} for m in range(90)}
    df = spark.createDataFrame([(d, m) for m, own in days.items() for d in own], "k long, m long")
    want = {p: n for p, n in _plain_counts(days).items() if n >= 2}
    got = {(r.a, r.b): r.n for r in pair_counts(df, "k", "m", 2, 60, asked=F.col("m") % 9 == 0).collect()}
    assert got == {p: n for p, n in want.items() if p[0] % 9 == 0 or p[1] % 9 == 0}
    few = {(r.a, r.b): r.n for r in pair_counts(df, "k", "m", 2, 60, best=(3, 4)).collect()}
    assert len(few) < len(want) and all(n == min(4, want[p]) for p, n in few.items())
    for m in days:
        order = lambda found, m=m: sorted((-min(4, n), a + b - m) for (a, b), n in found.items() if m in (a, b))[:3]
        assert order(few) == order(want)


def test_edges_of_the_graph_are_not_stored(spark, monkeypatch):
    from quillgraph.plans import profiles

    def refused(df):
        raise AssertionError("the edges grow with the square of the customers")

    monkeypatch.setattr(profiles, "stored", refused)
    assert profiles.visible_graph(spark, "/root/testdata/sf0.001").count() > 0


def test_edges_among_people_alone_are_counted_for_them_alone(spark):
    from quillgraph.plans.graphs import typed_edges

    sf = "/root/testdata/sf0.01"
    people = spark.range(0, 1500, 4).toDF("person_id")
    every = {tuple(r) for r in typed_edges(spark, sf).collect()}
    assert {tuple(r) for r in typed_edges(spark, sf, people, both=True).collect()} == {r for r in every if r[1] % 4 == 0 and r[2] % 4 == 0} != set()
    assert {tuple(r) for r in typed_edges(spark, sf, people).collect()} == {r for r in every if r[1] % 4 == 0 or r[2] % 4 == 0} != every
