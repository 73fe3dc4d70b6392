"""Vector codes, source audit and approximate neighbours against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_llm import same_as_oracle

from quillgraph.llm import op11_codes as op11
from quillgraph.llm import op12_divergence as op12
from quillgraph.llm import op13_kmeans_tree as op13

SF = "/root/testdata/sf0.001"
ODD_VECTORS = [
    (7, None, 1), (8, [], 1), (9, [1.0, None, 1.0, 1.0], 2), (11, [float("nan")] * 4, 2), (12, [float("inf")] * 4, 3), (None, [1.0] * 4, 3),
    (13, [0.0] * 4, None), (14, [-0.0] * 4, None), (15, [1e30, -1e30, 0.0, 1.0], 4), (50, [0.25, 0.5, 0.75, 1.0], 4), (50, [0.25, 0.5, 0.75, 1.0], 4), (16, [0.1, 0.2], 5), (17, [0.5, 1.0, 1.5, 2.0], 5),
]
VECTORS = "vec_id long, embedding array<float>, label int, x string, code int, v double, rank int, cell string"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1, 0.5, 2, "c") for r in ODD_VECTORS], VECTORS)


@pytest.fixture(scope="module")
def no_vectors(spark):
    return spark.createDataFrame([], VECTORS)


def plain_lloyd(rows, parts, entries, rounds):
    """The contract by plain loops over Python integers; rows are (vec_id, x, label) with x of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda c, p: min((apart(c[p], e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        codes = [[near(c, p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    last = [[near(c, p) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in k) for k in last]
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((r[0], "".join(f"{i:02x}" for _, i in k), e, by_label[r[2]], sha) for r, k, e in zip(rows, last, errors, strict=True))


def test_codes_equal_oracle_and_plain_loops(spark, duck):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    same_as_oracle(op11.compress_embeddings(vectors), duck, op11.oracle())
    rows = [(r.vec_id, [math.floor(4096 * x) for x in r.embedding], r.label) for r in vectors.collect()]
    assert Counter(map(tuple, op11.compress_embeddings(vectors).collect())) == plain_lloyd(rows, 8, 16, 6)


def test_codes_of_odd_rows(spark, odd, no_vectors):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label in ODD_VECTORS if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    most = math.isqrt((1 << 61) // 8) // 2
    filled = [(i, [max(-most, min(most, x)) for x in v] + [0] * (8 - len(v)), label) for i, v, label in kept]
    assert Counter(map(tuple, op11.compress_embeddings(odd).collect())) == plain_lloyd(filled, 8, 16, 6)
    assert op11.compress_embeddings(no_vectors).collect() == []
    assert op11.compress_embeddings(odd.filter("vec_id in (7, 9)")).collect() == []
    few = op11.compress_embeddings(odd.filter("vec_id = 50")).collect()
    assert len(few) == 2 and {(r.code, r.error, r.label_error) for r in few} == {("00" * 8, 0, 0)}


def test_moves_are_only_of_changed_parts(spark):
    """Running sums from plus and minus contributions equal sums taken anew, and unchanged parts give nothing."""
    rng = np.random.default_rng(5)
    x = rng.integers(-4000, 4000, (200, 16))
    prev, code = rng.integers(0, 4, (200, 8)), rng.integers(0, 4, (200, 8))
    code[:150] = prev[:150]
    state = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist()) for a, b, c in zip(x, prev, code, strict=True)], "x array<long>, prev array<int>, code array<int>")
    got = {(r.part, r.entry): (r.n, r.s0, r.s1) for r in op11._moves(state, 8, 2).collect()}
    want = defaultdict(lambda: np.zeros(3, int))
    for i in range(200):
        for p in range(8):
            if prev[i, p] != code[i, p]:
                v = np.array([1, *x[i, 2 * p : 2 * p + 2]])
                want[p, code[i, p]] += v
                want[p, prev[i, p]] -= v
    assert got == {k: tuple(v.tolist()) for k, v in want.items()}
    assert op11._moves(state.limit(150), 8, 2).count() == 0


def test_distances_are_exact_for_large_components():
    rng = np.random.default_rng(6)
    for size in (2**12, 2**26):
        x, book = rng.integers(-size, size, (40, 16)), rng.integers(-size, size, (8, 16, 2))
        book[:, 5] = book[:, 3]
        code, error = op11.nearest(x, book)
        for i in range(40):
            for p in range(8):
                want = min((sum((int(a) - int(b)) ** 2 for a, b in zip(x[i, 2 * p : 2 * p + 2], e, strict=True)), k) for k, e in enumerate(book[p]))
                assert (int(error[i, p]), int(code[i, p])) == want


def plain_audit(rows):
    """The contract by plain loops: rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))) for text, lang, source in rows]
    out = set()
    for lang in {r[0] for r in found}:
        documents = Counter(t for g, _, c in found if g == lang for t in c)
        kept = sorted(t for t, n in documents.items() if n >= 3)
        counts = {s: Counter() for g, s, _ in found if g == lang}
        for g, s, c in found:
            if g == lang:
                counts[s].update({t: n for t, n in c.items() if documents[t] >= 3})

        def frequency(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        whole = frequency(sum(counts.values(), Counter()))
        p = {s: frequency(c) for s, c in counts.items()}
        for s in p:
            value = {o: sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept) for o in p if o != s}
            out |= {(lang, s, "pair", o, value[o], r) for r, o in enumerate(sorted(value, key=lambda o: (-value[o], o.encode())), 1)}
            value = {t: (p[s][t] - whole[t]) ** 2 // whole[t] for t in kept if counts[s][t] and p[s][t] > whole[t]}
            out |= {(lang, s, "term", t, value[t], r) for r, t in enumerate(sorted(value, key=lambda t: (-value[t], t.encode()))[:200], 1)}
    return out


@pytest.mark.parametrize("cells", [op12.BLOCK_CELLS, 64])
def test_audit_equals_oracle_and_plain_loops(spark, duck, monkeypatch, cells):
    monkeypatch.setattr(op12, "BLOCK_CELLS", cells)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same_as_oracle(op12.audit_sources(docs), duck, op12.oracle())
    if cells == 64:
        rnd = random.Random(8)
        words = [f"{a}{b}" for a in "abcdeé" for b in ("x", "Y", "ß", "日本", "")] + ["İ", "Σ", "ſ", "\x85z"]
        rows = [(" ".join(rnd.choices(words, k=rnd.randint(0, 40))), rnd.choice(["en", "en", "de", None, ""]), rnd.choice(["s1", "s2", "é", None, "z"])) for _ in range(300)]
        rows += [(None, "en", "s1"), ("", "xx", "only"), (None, "xx", "other"), ("aa bb", "yy", "one"), ("long " * 4000, "en", "s2")] + [("copy of copies Copy", "en", "s1")] * 50
        df = spark.createDataFrame([(i, *r, 1, "t", 2) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, term string, block int")
        assert set(map(tuple, op12.audit_sources(df).collect())) == plain_audit(rows)
        assert op12.audit_sources(df.limit(0)).collect() == []
        assert op12.audit_sources(df.filter("lang = 'xx'")).count() == 2


def test_audit_counts_in_pieces_and_parts(spark, monkeypatch):
    docs = spark.createDataFrame([("Ab cd-EF " * 50, "en", "s")] * 4 + [("zz", "en", "s")] * 3, "text string, lang string, source string")
    want = Counter(map(tuple, op12.term_counts(docs).collect()))
    text = ("Ab cd-EF éé" * 50).encode()
    for size in (1, 7, 100, 10_000):
        monkeypatch.setattr(op12, "PIECE", size)
        assert [t for p in op12.pieces(text) for t in op12.terms(p)] == op12.terms(text)
    monkeypatch.setattr(op12, "PIECE", 20)
    monkeypatch.setattr(op12, "HELD", 1)
    assert Counter(map(tuple, op12.term_counts(docs).collect())) == want
    assert want[("en", "s", "ab", 200, 4)] == 1 and want[("en", "s", "zz", 3, 3)] == 1


def test_frequencies_are_exact():
    rng = np.random.default_rng(9)
    total = rng.integers(10**14, 9 * 10**15, 200)
    count = (total * rng.random(200)).astype(np.int64) - 1
    assert op12.frequencies(count.copy(), total).tolist() == [1 + 10**9 * (int(c) + 1) // int(t) for c, t in zip(count, total, strict=True)]


def plain_neighbours(rows, k=5):
    clean = [(i, np.array([float(np.float32(x)) for x in v])) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    longest = max(len(v) for _, v in clean)
    clean = [(i, np.concatenate([v, np.zeros(longest - len(v))])) for i, v in clean]
    cosine = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    return {(i, v.tobytes()): sorted(((-cosine(v, w), j) for j, w in clean if j != i))[:k] for i, v in clean if i % 50 == 0}


def recall(got, want):
    """Share of the true neighbours found, copies of a neighbour with the same score counting for each other."""
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r.score)
    hits = sum(sum(a >= -b[0] - 1e-9 for a, b in zip(sorted(by[i], reverse=True), near, strict=False)) for (i, _), near in want.items())
    return hits / sum(map(len, want.values()))


@pytest.mark.parametrize("seed,groups", [(2, 1), (3, 40)])
def test_neighbours_reach_recall(spark, monkeypatch, seed, groups):
    monkeypatch.setattr(op13, "UNIT_ROWS", 300)
    monkeypatch.setattr(op13, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (groups, 24))
    rows = [(i, (centres[i % groups] + rng.normal(0, 1, 24)).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = op13.nearest_embeddings(df).collect(), plain_neighbours(rows)
    assert len(got) == 5 * len(want)
    assert recall(got, want) >= 0.9
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for r in got:
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12) and r.vec_id != r.query_id


def test_neighbours_on_the_given_table(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert recall(op13.nearest_embeddings(vectors).collect(), plain_neighbours([(r.vec_id, r.embedding) for r in vectors.collect()])) >= 0.9


def test_neighbours_of_odd_rows_and_copies(spark, odd, no_vectors):
    want = {}
    for (i, _), near in plain_neighbours([r[:2] for r in ODD_VECTORS]).items():
        want |= {(i, k): (j, -s) for k, (s, j) in enumerate(near, 1)}
    got = {(r.query_id, r["rank"]): (r.vec_id, pytest.approx(r.score, abs=1e-12)) for r in op13.nearest_embeddings(odd).collect()}
    assert got == want and all(j not in (13, 14, 50) for j, _ in got.values())
    assert op13.nearest_embeddings(no_vectors).collect() == []
    assert op13.nearest_embeddings(odd.filter("vec_id < 50")).collect() == []
    copies = spark.createDataFrame([(i, [0.5, 0.25, 1.0]) for i in range(700)] + [(1000, [3.0, 0.1, 0.0]), (3, [0.5, 0.25, 1.0])], "vec_id long, embedding array<double>")
    rows = op13.nearest_embeddings(copies).collect()
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r.vec_id)
    assert by[0] == [1, 2, 3, 3, 4] and by[50] == [0, 1, 2, 3, 3] and by[1000] == [0, 1, 2, 3, 3] and len(by) == 15


def test_width_is_the_cheapest_that_reaches_recall():
    turns = [(0, 0)] * 90 + [(1, 3)] * 8 + [(7, 30)] * 2
    assert op13.widened(turns, 8, 0.9) == (1, 1)
    assert op13.widened(turns, 8, 0.97) == (2, 4)
    assert op13.widened(turns, 8, 1.0) == (8, 31)


def test_tree_holds_every_row_once():
    rng = np.random.default_rng(1)
    unit = rng.normal(0, 1, (1000, 5))
    unit /= op13.norms(unit)[:, None]
    unit[:400] = unit[0]
    tree = op13.KMeansTree(unit, 20)
    assert sorted(tree.order.tolist()) == list(range(1000))
    near = unit[7] @ tree.matrix.T
    every = tree.leaves(near, 10**6)
    assert sorted(i for n in every for i in range(*tree.ranges[n])) == list(range(1000)) and tree.leaves(near, 3) == every[:3]
