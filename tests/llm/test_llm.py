"""The ten operators against brute force, on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import json
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgraph.llm import common
from quillgraph.llm import op01_language as op1
from quillgraph.llm import op02_toxicity as op2
from quillgraph.llm import op03_ngram_join as op3
from quillgraph.llm import op04_packing as op4
from quillgraph.llm import op05_passages as op5
from quillgraph.llm import op06_bpe as op6
from quillgraph.llm import op07_sharding as op7
from quillgraph.llm import op08_merkle as op8
from quillgraph.llm import op09_secrets as op9
from quillgraph.llm import op10_topk as op10
from quillgraph.llm.components import connected_components

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Odd rows for every operator: nulls, empties, ties, repeats, long texts, other scripts.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog", "en"), (1, "The quick brown fox jumps over the lazy dog", "en"), (2, None, None), (3, "", "en"), (4, "  \n\t ", "de"),
    (None, "id is missing here", "en"), (5, "x" * 5000, "en"), (6, "word " * 3000, None), (7, "日本語 テキスト Σίσυφος İ ½ <|endoftext|> a'll", "ja"), (8, "der die das und", "de"),
    (9, "der die das und", "de"), (10, "123 456 !!!", None), (11, "\x1c\x85 odd\x00 bytes", "en"),
]
SCHEMA = "doc_id long, text string, lang string, n int, sig string, score double, spans string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "s", 0.5, "p") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same_as_oracle(frame, duck, sql):
    got, want = frame.toPandas(), duck.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    norm = lambda df: sorted(tuple(None if x is None or x != x else str(x) for x in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert norm(got) == norm(want)


def test_ppm_code_lengths():
    train = {"a": ["hello world", "hello there"], "b": ["bonjour monde", "abc"]}
    model = op1.PpmModel(train)

    def brute(texts, text):
        data, counts = op1.START + op1.START.join(t.encode() for t in texts), defaultdict(Counter)
        for i in range(op1.ORDER, len(data)):
            for o in range(op1.ORDER + 1):
                counts[data[i - o : i]][data[i]] += 1
        x, bits = op1.START + text.lower().encode(), 0.0
        for i in range(op1.ORDER, len(x)):
            for o in range(op1.ORDER, -1, -1):
                c = counts.get(x[i - o : i])
                if c:
                    n, q = sum(c.values()), len(c)
                    if x[i] in c:
                        bits -= math.log2(c[x[i]] / (n + q))
                        break
                    bits -= math.log2(q / (n + q))
            else:
                bits += 8
        return bits

    for text in ("hello monde", "xyz Bonjour!", "h", "hello é", "q" * 50):
        assert model.code_lengths([text])[0] == pytest.approx([brute(train[k], text) for k in ("a", "b")], rel=1e-5)


def test_language_accuracy(docs, odd, none):
    got = {r.doc_id: r for r in op1.identify_languages(docs).collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.95
    out = op1.identify_languages(odd).collect()
    assert len(out) == len(ODD)
    assert all(r.lang_pred == "und" and r.score == 0 for r in out if r.doc_id in (2, 3, 4, 10))
    assert op1.identify_languages(none).count() == 0
    kept = op1.keep_identified(odd)
    assert kept.columns == odd.columns and not {2, 3, 4, 10} & {r.doc_id for r in kept.collect()}


def test_toxicity(spark, odd, none):
    rnd = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(900):
        t = rnd.choices(plain, k=rnd.randint(5, 300))
        if i % 4 == 0:
            t.insert(rnd.randint(0, len(t)), rnd.choice(["moron", "loweix", "loweiy", "scum,"]))
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = op2.score_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()
    held = [(rows[r.doc_id][2], r.predicted) for r in out if r.held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.98
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in op2.score_toxicity(odd, empty).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (5, 0), (8, 0), (9, 1)], "doc_id long, toxic int")
    assert op2.score_toxicity(odd, labels).count() == len(ODD)
    assert op2.score_toxicity(none, labels).count() == 0


def test_factorization_machine_learns_a_term_that_tells_nothing_alone():
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(3000):  # slot 2 is as common in both labels: it turns slot 1 toxic and slot 3 harmless
        a, mention, b = rng.random(3) < (0.3, 0.5, 0.3)
        rows.append(np.unique(np.array([s for s, on in ((1, a), (2, mention), (3, b)) if on] + list(rng.integers(10, 40, 3)), np.int32)))
        labels.append(int(a and mention and not b) | int(b and not mention and not a))
    m = op2.FactorizationMachine(rows, labels)
    score = lambda *s: m.score(m.place[np.array(s)][m.place[np.array(s)] >= 0])
    assert score(1, 2) > 0.8 and max(score(1), score(2, 3), score(2)) < 0.4


def test_toxicity_scores_mean_the_same_at_every_sample(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(6000):
        toxic = int(rnd.random() < 0.06)
        odd_word = rnd.random() < (0.8 if toxic else 0.1)
        rows.append((i, " ".join(rnd.choices([f"w{k}" for k in range(50)], k=8) + ["grumbleword"] * odd_word), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "toxic")
    has = [r[0] for r in rows if "grumbleword" in r[1]]
    rate = sum(rows[i][2] for i in has) / len(has)
    for sample in (1000, 10000):
        score = {r.doc_id: r.score for r in op2.score_texts(docs, op2.fit(labels, docs, sample)).collect()}
        assert abs(sum(score[i] for i in has) / len(has) - rate) < 0.1, sample


def test_factorization_machine_learns_pairs():
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1200):  # toxic only where both slots 1 and 2 are present
        present = [s for s in (1, 2) if rng.random() < 0.5] + list(rng.integers(10, 40, 3))
        rows.append(np.unique(np.array(present, np.int32)))
        labels.append(int({1, 2} <= set(present)))
    m = op2.FactorizationMachine(rows, labels)
    score = lambda *s: m.score(m.place[np.array(s)][m.place[np.array(s)] >= 0])
    assert score(1, 2) > 0.8 and score(1) < 0.4 and score(2) < 0.4


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(sets[i]), None if doc is None else least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def test_jaccard_components(spark, docs, odd, none, duck):
    same_as_oracle(op3.jaccard_components(docs), duck, op3.oracle())
    rnd = random.Random(9)
    base, rows = [rnd.choices([f"v{i}" for i in range(500)], k=60) for _ in range(6)], []
    for i in range(160):  # chains of edits: near copies of near copies, shared halves, repeats
        t = list(base[i % 6])
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(40)}"
        if i % 5 == 0:
            t = t[:30] + base[(i + 1) % 6][30:]
        rows.append((i, " ".join(t)))
    rows += [(500, rows[3][1]), (501, "a b c"), (502, "A b C"), (503, "a b"), (3, rows[3][1])]
    got = op3.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    pairs = [(r[0], r[1]) for r in ODD]
    assert sorted(map(tuple, op3.jaccard_components(odd).collect()), key=str) == brute_components(pairs)
    assert op3.jaccard_components(none).count() == 0
    kept = op3.keep_one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "8", "10", "11", "None"])


def test_components(spark):
    links = spark.createDataFrame([(b, a) for a, b in [(i, i + 1) for i in range(1, 60)] + [(100, 101), (105, 101), (7, 7)]], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 105: 100}


def token_ids(texts):
    lib = Tokenizer.from_file(VOCABULARY)
    return lib, [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_packing(odd, none, docs):
    for frame in (odd, docs):
        source = frame.select("doc_id", "text").collect()
        _, ids = token_ids([r.text for r in source])
        want = Counter((r.doc_id, struct.pack(f"<{len(i) + 1}I", *i, op4.CLOSING_ID)) for r, i in zip(source, ids, strict=True))
        pieces = op4.pack_documents(frame, VOCABULARY).collect()
        by_sequence, padding, total = defaultdict(list), 0, 0
        for p in pieces:
            by_sequence[p.sequence_id].append(p)
        for own in by_sequence.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
            assert at <= op4.WINDOW
            total += at
            padding += op4.WINDOW - at if at & (at - 1) else 0
        assert padding == 0 and total == sum(len(k[1]) // 4 * n for k, n in want.items())
        left = {k[0]: [] for k in want}
        for (doc, run), n in want.items():
            left[doc] += [run] * n
        for p in pieces:  # every piece is the run of a row of its document
            assert any(len(r) // 4 == p.doc_tokens and zlib.crc32(r[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for r in left[p.doc_id])
    assert op4.pack_documents(none, VOCABULARY).count() == 0


def test_packer_places_by_sum_of_squares():
    rnd, window = random.Random(6), 32
    packer, plain, done = op4.Packer(window, open_limit=10**9), [], []
    for doc in range(400):
        size = rnd.randint(1, window - 1)
        packer.place(doc, b"\1\0\0\0" * size)

        def after(level):
            levels = [sum(p[1] for p in w) for w in plain]
            if level:
                levels.remove(level)
            counts = Counter(x for x in [*levels, level + size] if x < window)
            return sum(c * c for c in counts.values())

        level = min((h for h in {0} | {sum(p[1] for p in w) for w in plain} if h + size <= window), key=lambda h: (after(h), h))
        own = next((w for w in reversed(plain) if sum(p[1] for p in w) == level), None) if level else []
        if level:
            plain.remove(own)
        own.append((doc, size))
        (done if level + size == window else plain).append(own)
        got = sorted(level for level, n in enumerate(packer.counts.tolist()) for _ in range(n))
        assert got == sorted(sum(p[1] for p in w) for w in plain)
    assert [[p[0] for p in s] for s in packer.take_closed()] == [[p[0] for p in s] for s in done]


def test_packer_bounds_open_windows():
    packer = op4.Packer(window=64, open_limit=10)
    for i in range(500):  # no two fit together
        packer.place(i, b"\1\0\0\0" * 40)
        assert packer.n_open <= 11
    packer.flush()
    done = packer.take_closed()
    assert sum(len(p[2]) // 4 for s in done for p in s) == 500 * 40
    assert all((n := sum(len(p[2]) // 4 for p in s)) == 64 or n & (n - 1) == 0 for s in done)


def test_packer_without_a_limit_keeps_every_window_open():
    packer = op4.Packer(window=64)
    for i in range(5000):  # no two fit together
        packer.place(i, b"\1\0\0\0" * 40)
    assert packer.n_open == 5000 and not packer.take_closed()
    for i in range(5000):  # and each is filled by what comes later, however many there were
        packer.place(5000 + i, b"\1\0\0\0" * 24)
    assert packer.n_open == 0 and all(len(s) == 2 for s in packer.take_closed())


def test_keep_one_of_each_with_clashing_names(spark):
    names = ["_t", "_d", "_key", "_copies", "row", "id", "key", "t", "d", "copies", "label", "node", "n"]
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, *range(13)), (2, text, *range(13)), (1, text, *range(13)), (3, "other words here", *range(13)), (3, "other words here", *range(13)), (4, None, *range(13)), (None, text, *range(13))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = op3.keep_one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, text, *range(13)), (3, "other words here", *range(13)), (4, None, *range(13))]


def test_a_row_without_id_links_others(spark):
    own = [f"w{i}" for i in range(100)]
    a, b = [f"x{i}" for i in range(9)] + own[9:], own[:91] + [f"y{i}" for i in range(9)]
    rows = [(4, " ".join(a)), (None, " ".join(own)), (7, " ".join(b)), (9, "apart from all of them")]
    found = op3.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {4: 4, 7: 4, 9: 9, None: None}


@pytest.mark.parametrize("kind", ["adjacent", "inserted", "alternating", "stray"])
def test_passages_of_a_chain_below_the_share_are_kept(spark, kind):
    rnd = random.Random(17)
    fresh = lambda n: [f"f{rnd.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], {}
    for i in range(40):
        own, other, places = fresh(30), fresh(30), []
        sizes = {"adjacent": (51, 51), "inserted": (55, 55), "alternating": (45, 60, 45, 60), "stray": (51, 10)}[kind]
        for k, size in enumerate(sizes):
            shared = fresh(size)
            if k:
                gap = rnd.randint(35, 40)
                own += fresh(gap)
                other += [] if kind == "inserted" else fresh(gap)
            if size > 40:
                places.append((len(own), len(own) + size))
            own, other = own + shared, other + shared
        rows += [(2 * i, " ".join(other + fresh(30))), (2 * i + 1, " ".join(own + fresh(30)))]
        planted[2 * i + 1] = places
    found = {}
    for r in op5.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.first_doc_id == r.doc_id - 1 and r.similarity >= op5.LEAST_SHARE
        found.setdefault(r.doc_id, []).append((r.start_word, r.end_word))
    for doc, places in planted.items():
        for a, b in places:
            assert any(x <= a and y >= b for x, y in found.get(doc, [])), (doc, a, b, found.get(doc))
        covered = {w for x, y in found[doc] for w in range(x, y)}
        assert len(covered - {w for a, b in places for w in range(a, b)}) <= 25 * len(places)


def test_passages_with_edits_spread_over_them(spark):
    rnd = random.Random(19)
    fresh = lambda n: [f"f{rnd.randrange(10**9)}" for _ in range(n)]
    edits = {"replace": lambda w: fresh(1), "insert": lambda w: [w, *fresh(1)], "delete": lambda w: []}
    rows, sizes = [], {}
    for kind in [*edits, "mixed"]:
        for every in (7, 8, 12, 20):
            for size in (60, 100, 200):
                p = fresh(size)
                how = lambda: edits[kind if kind != "mixed" else rnd.choice([*edits])]  # noqa: B023, E731
                q = [x for k, w in enumerate(p, 1) for x in (how()(w) if k % every == 0 else [w])]
                n = len(rows)
                rows += [(n, " ".join(fresh(50) + p + fresh(30))), (n + 1, " ".join(fresh(40) + q + fresh(40)))]
                sizes[n + 1] = len(q)
    covered = {}
    for r in op5.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.first_doc_id == r.doc_id - 1 and r.similarity >= op5.LEAST_SHARE
        covered.setdefault(r.doc_id, set()).update(range(max(r.start_word, 40), min(r.end_word, 40 + sizes[r.doc_id])))
    found = [len(covered.get(doc, ())) >= 0.8 * n for doc, n in sizes.items()]
    assert sum(found) >= 0.95 * len(found)


@pytest.mark.parametrize("between", [0, 3])
def test_quilted_passages_equal_brute_force(spark, between):
    """Two documents share a passage whose overlapping parts, too short for passages, all occur earlier elsewhere."""
    rnd = random.Random(23)
    fresh = lambda n: [f"f{rnd.randrange(10**9)}" for _ in range(n)]
    rows = []
    for _ in range(15):
        p = fresh(84)
        parts = [p[a : a + 36] for a in (0, 24, 48)]
        docs = [fresh(20) + x + fresh(25) for x in parts] + [fresh(30) + p + fresh(20)]
        docs += [fresh(20) + parts[k % 3] + fresh(20) for k in range(between)] + [fresh(25) + p + fresh(31)]
        rows += [(len(rows) + k, " ".join(d)) for k, d in enumerate(docs)]
    earlier, want = set(), {}
    for doc, text in rows:
        w = text.split()
        own = {tuple(w[k : k + 50]): k for k in range(len(w) - 49)}
        hit = [k for x, k in own.items() if x in earlier]
        if hit:
            want[doc] = {x for k in hit for x in range(k, k + 50)}
        earlier |= set(own)
    assert len(want) == 15
    got = {}
    for r in op5.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == want


@pytest.mark.parametrize("batch", [10000, 7])
@pytest.mark.parametrize("rare", [False, True])
def test_edited_passages_whose_parts_are_common_are_found(spark, rare, batch):
    """Every part of an edited passage stands in seven documents before its first occurrence and in seven after it; ``rare``: all but two parts. They cost no passage."""
    rnd = random.Random(29)
    fresh = lambda n: [f"f{rnd.randrange(10**9)}" for _ in range(n)]
    rows, planted = [], {}
    for _ in range(12):
        p = fresh(70)
        q = [*p]
        q[::9] = fresh(8)
        parts = [p[a : a + 14] for a in range(0, 60, 7)]
        layer = lambda: [[*fresh(15), *x, *fresh(15)] for _ in range(7) for k, x in enumerate(parts) if not (rare and 3 <= k <= 4)]  # noqa: B023, E731
        docs = [*layer(), [*fresh(20), *p, *fresh(20)], *layer(), [*fresh(25), *q, *fresh(31)]]
        planted[len(rows) + len(docs) - 1] = len(rows) + len(docs) // 2 - 1
        rows += [(len(rows) + k, " ".join(d)) for k, d in enumerate(docs)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    try:
        spark.conf.set(name, str(batch))
        common.BATCHES[name] = batch
        found = op5.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.unset(name)
        common.BATCHES[name] = 1000
    alone = [r for r in rows if r[0] in planted or r[0] in planted.values()]
    want = op5.repeated_passages(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert len(want) >= 9 and sorted(found) == sorted(want)


def test_passages(spark, odd, none):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    passages, rows, holds = [rnd.choices(vocabulary, k=n) for n in (51, 60, 120, 55, 200)], [], {}
    for i in range(90):
        t = rnd.choices(vocabulary, k=rnd.randint(20, 300))
        if i % 3 == 0:
            p = list(passages[i // 3 % 5])
            if i % 2:
                p[len(p) // 2] = f"edit{i}"
                if len(p) > 100:
                    del p[30]
            at = rnd.randint(0, len(t))
            t[at:at] = p
            holds[i] = i // 3 % 5
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = op5.repeated_passages(df).collect()
    first = {}
    for i, p in holds.items():
        first.setdefault(p, i)
    assert {r.doc_id for r in out} == {i for i, p in holds.items() if first[p] != i}
    text = dict(rows)
    for r in out:
        assert text[r.doc_id][r.start : r.end].split() == text[r.doc_id].split()[r.start_word : r.end_word]
        assert r.first_doc_id < r.doc_id and r.similarity >= op5.LEAST_SHARE
    cut = {r.doc_id: r.text for r in op5.cut_passages(df).collect()}
    for i, p in holds.items():  # nothing but the first occurrence is left
        whole = " ".join(passages[p][:20])
        assert (whole in cut[i]) == (first[p] == i)
    assert all(cut[i] == t for i, t in rows if i not in holds)
    assert op5.repeated_passages(none).count() == 0
    assert op5.cut_passages(odd).columns == odd.columns


def test_chains_are_collinear():
    rnd = random.Random(2)
    points = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(x, x + 7) for x in range(0, 300, 9)]
    found = op5.chains(points)
    assert sorted(p for c in found for p in c) == sorted(set(points))
    for c in found:
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:], strict=False))
    assert max(found, key=len)[:1] and len(max(found, key=len)) >= 25


def test_bpe_equals_library(odd, none, docs):
    rnd = random.Random(1)
    texts = [r.text for r in docs.collect()][:60] + [r[1] for r in ODD]
    texts += ["".join(rnd.choice("abeinrst'0 1!?.é\n") for _ in range(rnd.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 0x24F), rnd.randint(0x300, 0x2FFF), rnd.randint(0x1F300, 0x1F6FF)])) for _ in range(20)) for _ in range(800)]
    lib, ids = token_ids(texts)
    table = op6.table(op6.vocabulary(VOCABULARY), op6.decimal, op6.labelled)
    for own, want in zip(table.split(texts), ids, strict=True):
        got, labels = (" ".join(map(t.__getitem__, own)) for t in table.tables)
        assert got.split() == list(map(str, want))
        assert labels == lib.decode(want, skip_special_tokens=False)
    for frame in (odd, docs):
        source = frame.select("doc_id", "text").collect()
        want = []
        for r, run in zip(source, token_ids([r.text for r in source])[1], strict=True):
            digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
            want.append((r.doc_id, len(run), digest(" ".join(map(str, run))), digest(lib.decode(run, skip_special_tokens=False))))
        assert Counter(map(tuple, op6.encode_documents(frame, VOCABULARY).collect())) == Counter(want)
    assert op6.encode_documents(none, VOCABULARY).count() == 0


def test_automaton_walks_equal_library():
    automaton = op6.BpeAutomaton(op6.vocabulary(VOCABULARY))
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(1, 40))) for _ in range(3000)] + ["a" * 300, "ab" * 4000, "!?" * 700]
    words += ["".join(rnd.choices("etaoinshr", k=rnd.randint(1, 15))) for _ in range(5000)]
    ids, ends = automaton.encode([w.encode() for w in words])
    _, want = token_ids(words)
    assert [ids[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == want


def test_arcs_equal_gadgets():
    """Arcs of the compiled tables against states that hold their arcs one by one, merge gadget after merge gadget."""
    automaton = op6.BpeAutomaton(op6.vocabulary(VOCABULARY))
    merges = sorted((int(automaton.made[w]), w) for w in range(len(automaton.made)) if automaton.left[w] >= 0)[:250]
    content = json.loads(op6.vocabulary(VOCABULARY))
    vocab, pairs = content["model"]["vocab"], content["model"]["merges"][:250]
    states, target = [set(t for t in vocab.values() if automaton.left[t] < 0)], defaultdict(int)
    for m, (u, v) in enumerate(((vocab[a], vocab[b]) for a, b in pairs), 1):
        w = merges[m - 1][1]
        states.append(states[target[u]] - {v})
        target[w] = target[v]
        target[u] = m
        for s in states:
            if u in s:
                s.add(w)
    small = json.dumps(content | {"model": content["model"] | {"merges": pairs}})
    compiled, tokens = op6.BpeAutomaton(small), [t for t in vocab.values() if automaton.left[t] < 0][:80] + [w for _, w in merges]
    x, y = (g.ravel() for g in np.meshgrid(tokens, tokens))
    want = np.array([b in states[target[a]] for a, b in zip(x.tolist(), y.tolist(), strict=True)])
    assert (compiled.has_arc(x, y) == want).all()


def test_sharding(spark, docs, odd, none, duck):
    same_as_oracle(op7.shard_rows(docs).drop("grown_shard"), duck, f"SELECT * EXCLUDE grown_shard FROM ({op7.oracle()})")
    rows = op7.shard_rows(odd).collect()
    assert len(rows) == len(ODD)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert all(r.text_crc32 == 0 and r.size == 1 for r in rows if r.doc_id in (2, 3))
    assert op7.shard_rows(none).count() == 0
    for n in (1, 2, 3, 7, 64, 65, 1000):
        got = [r[0] for r in spark.range(n).select(op7.permute(F.col("id"), n, 5)).collect()]
        assert sorted(got) == list(range(n))


def test_merkle(docs, odd, none, duck):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    out = {r.doc_id: r for r in op8.fingerprint_edits(docs).collect()}
    for k, (i, text) in enumerate(rows):
        half, after = len(text) // 2, rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - half] + after[:half]
        r = out[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.fingerprint == r.edited_fingerprint) == (edited == text)
    by_text = defaultdict(set)
    for i, text in rows:
        by_text[text].add(out[i].fingerprint)
    assert all(len(s) == 1 for s in by_text.values()) and len({next(iter(s)) for s in by_text.values()}) == len(by_text)
    far = [r for r in out.values() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in far) > 0.98 * len(far)
    out = op8.fingerprint_edits(odd).collect()
    assert len(out) == len(ODD)
    assert Counter((r.doc_id, r.n_chars) for r in out) == Counter((r[0], len(r[1] or "")) for r in ODD)
    same_as_oracle(op8.fingerprint_edits(docs), duck, op8.oracle())
    assert op8.fingerprint_edits(none).count() == 0


def test_merkle_roots_tell_texts_apart(spark):
    texts = [f"piece {i}" for i in range(3)] + ["a\nb", "b\na", "a\n\nb", "", "x" * 64 + "y" * 64, "y" * 64 + "x" * 64]
    rows = [(i, t) for i, t in enumerate(texts)] + [(50 + i, t) for i, t in enumerate(texts)]
    out = op8.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = defaultdict(set)
    for r in out:
        by_text[texts[r.doc_id % 50]].add(r.fingerprint.split("|")[0])
    assert all(len(x) == 1 for x in by_text.values()) and len(set.union(*by_text.values())) == len(texts)
    near = {r.doc_id: r.near_next for r in out}  # the next document is the one before
    assert near[4] < 1 and near[8] < 1 and near[0] < 1  # same leaves in another order aren't equal


def test_merkle_locates_edits(spark):
    text = "\n".join(f"paragraph number {i} has its own words {i * 7}" for i in range(60))
    changed = text.replace("number 41", "number forty-one")
    df = spark.createDataFrame([(text, changed)], "a string, b string")
    a, b = (op8.serialise(op8.merkle(F.col(c))) for c in "ab")
    r = df.select(op8.changed_sections(a, b).alias("c"), op8.likeness(a, op8.parsed(b)).alias("l"), F.size(op8.changed_sections(a, a)).alias("n")).first()
    assert len(r.c) == 1 and 0.9 < r.l < 1 and r.n == 0


def test_secrets(spark, docs, odd, none, duck):
    same_as_oracle(op9.scan_documents(docs), duck, op9.oracle())
    texts = [
        'é password = "hunter22" and Token:abc then secret: token: abcdef12', "AKIA" + "A1" * 9 + " AKIAshort", "deadbeef" * 5 + "G" + "0" * 23, "api_key='x/y+z==' API-KEY=nope apikey:123456",
        "token=" + "a" * 5, "PASSWD=abcdef,secret=ghijkl" * 300, None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = (("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    for r in op9.scan_documents(df).collect():
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, texts[r.doc_id] or "") if len(m.group(g)) >= n)
        want = ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)
        assert (r.spans, r.base_sha256) == (want, hashlib.sha256(want.encode()).hexdigest())
    masked = {r.doc_id: r.text for r in op9.redact_documents(df).collect()}
    assert masked[0] == "é [secret]\" and Token:abc then secret: token: abcdef12" and masked[6] is None
    assert op9.scan_documents(odd).count() == len(ODD) and op9.scan_documents(none).count() == 0


def test_ledger_scans_only_unseen(spark):
    first = spark.createDataFrame([(1, "token=abcdef"), (2, "plain")], "doc_id long, text string")
    ledger = op9.update_ledger(first).persist()
    later = spark.createDataFrame([(3, "token=abcdef"), (4, "secret=ghijkl")], "doc_id long, text string")
    assert ledger.count() == 2 and op9.update_ledger(later, ledger).count() == 1
    got = {r.doc_id: r.n_assign for r in op9.scan_documents(later, ledger).collect()}
    assert got == {3: 1, 4: 1}


def test_topk(spark, duck):
    same_as_oracle(op10.search_embeddings(spark.read.parquet(f"{SF}/embeddings.parquet")), duck, op10.oracle())
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(50, rows[50][1]), (7, None), (8, []), (9, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (11, [float("nan")] * 6), (12, [float("inf")] * 6), (None, [1.0] * 6), (100, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    clean = [(i, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in {(i, v) for i, v in clean if i % 50 == 0}:
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in clean if i != q and len(w) == len(v))[:5]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(near)}
    assert set(map(tuple, op10.search_embeddings(df).collect())) == want
    assert op10.search_embeddings(df.filter("vec_id < 0")).count() == 0


def test_topk_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(op10, "SHARD_ROWS", 100)
    monkeypatch.setattr(op10, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 8)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(np.float64))
    want = set()
    for q in range(0, 900, 50):
        s = v @ v[q]
        order = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:5]
        want |= {(q, k + 1, i, int(s[i])) for k, i in enumerate(order)}
    assert set(map(tuple, op10.search_embeddings(df).collect())) == want


def test_pipeline_stages(spark, docs, odd):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeated_passages", "secrets", "packing"]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
    pieces = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in frame.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, SF)
    assert odd.count() > 0


def test_texts_with_passages_are_joined_without_a_broadcast(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    found = op5.passages(docs)
    plan = op5._with_spans(docs, found, "spans")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_common_seeds_of_a_pair_travel_packed():
    import random

    import numpy as np
    import pyarrow as pa

    from quillgraph.llm import op05_passages as o

    rnd = random.Random(2)
    docs = {d: sorted((rnd.randrange(30), rnd.randrange(500)) for _ in range(rnd.randrange(1, 40))) for d in range(12)}
    flat = [(d, 7, h, pos) for d, seeds in docs.items() for h, pos in seeds]
    names = ["doc", "key", "h", "pos"]
    stream = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=names) for part in (flat[:50], flat[50:])]
    listed = {row["doc"]: row["seeds"] for b in o._listed(iter(stream)) for row in b.to_pylist()}
    assert all(len(x) == 12 * len(docs[d]) for d, x in listed.items())  # 12 bytes a seed
    pairs = [(a, b) for a in docs for b in docs if b < a]
    columns = [pa.array([p[0] for p in pairs]), pa.array([7] * len(pairs)), pa.array([p[1] for p in pairs]), pa.array([7] * len(pairs)), *(pa.array([listed[p[i]] for p in pairs], pa.binary()) for i in (0, 1))]
    (met,) = o._shared(iter([pa.RecordBatch.from_arrays(columns, names=["doc", "key", "first_doc", "first_key", "seeds", "first_seeds"])]))
    own = o._unpacked({c: np.asarray(met.column(c)) for c in met.schema.names})
    got = sorted(zip(*(own[c].tolist() for c in ("doc", "first_doc", "pos", "first_pos")), strict=True))
    assert got == sorted((a, b, pos, min(p for g, p in docs[b] if g == h)) for a, b in pairs for h, pos in docs[a] if any(g == h for g, _ in docs[b]))
    assert not own["long"].any() and not own["h"].any()
