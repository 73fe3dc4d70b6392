"""Divergence of sources within a language, by dense blocks of terms.

Each task counts terms of its own documents per (language, source) and hands on partial counts; Spark sums them. A language's
kept terms are dealt by hash into blocks of about ``BLOCK_CELLS`` / sources, so that a block is one dense matrix of groups by terms with
a bounded number of cells, whatever the language or source holds. A block's task turns counts into frequencies p, takes the
differences of all pairs of its rows by broadcasting (in slabs of ``BLOCK_CELLS`` at most) and gives one
partial number a pair, and for each group its ``TOP`` largest terms against the language. Partial pair numbers are summed over the
blocks and the per-group heaps are merged by a ranked window, which cuts each heap before it is shuffled.

All arithmetic is exact: 1 + floor(10^9 * (count + 1) / (N + V)) is taken in three steps of a thousand, so that it holds for up to
9 * 10^15 terms a language; a sum of f stays below 2^63 as frequencies add up to about 10^9.

Defined results: null text, lang and source count as ''; a text without letters has no terms but its group occurs; repeated rows count
each; ties go to the smaller item by its UTF-8 bytes; a language without kept terms gives pairs of value 0 and no terms; texts are read whole, very long
ones in pieces cut between terms; an empty table gives no rows. Input columns beyond text, lang and source aren't read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

LEAST_DOCUMENTS = 3
TOP = 200
UNIT = 1_000_000_000
#: Cells of a dense matrix and of a slab of pairs; 8 bytes each.
BLOCK_CELLS = 1 << 18
#: Terms that a task counts before it hands on what it has.
HELD = 1 << 18
#: Bytes of a text that are split at once.
PIECE = 1 << 20
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")
COUNTS = "lang string, source string, term binary, n long, documents long"


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text or piece, only A-Z lower-cased."""
    return TERM.findall(text.lower())  # bytes.lower leaves all but ASCII letters alone


def pieces(text: bytes):
    """The text in pieces of about ``PIECE`` bytes, cut where no term goes on."""
    at = 0
    while len(text) - at > PIECE:
        end = BREAK.search(text, at + PIECE)
        cut = end.start() if end else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(batches):
    held: dict = {}
    size = 0

    def flush():
        out = [[], [], [], [], []]
        for (lang, source), (n, documents) in held.items():
            n[b""], documents[b""] = 0, 0  # that the group occurs
            for column, values in zip(out, ([lang] * len(n), [source] * len(n), n.keys(), n.values(), map(documents.__getitem__, n)), strict=True):
                column.extend(values)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["lang", "source", "term", "n", "documents"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n, documents = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(n)
            if len(text) <= PIECE:
                found = terms(text)
                n.update(found)
                documents.update(set(found))
            else:
                own = set()
                for piece in pieces(text):
                    found = terms(piece)
                    n.update(found)
                    own.update(found)
                documents.update(own)
            size += len(n)
            if size > HELD:
                yield flush()
                held.clear()
                size = 0
    yield flush()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of every term in every group; each group also has a row of the empty term."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    summed = read.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return summed.withColumn("term", F.col("term").cast("string"))


def frequencies(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / total), exactly."""
    whole, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + step
    return 1 + whole


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of frequencies, elementwise."""
    apart = p - q
    return apart * apart // q


def _tile(left: pa.Table, right: pa.Table) -> pa.Table:
    """Partial pair numbers and term heaps of one block of one language."""
    sources = right.column("source").to_pylist()
    encoded = left.column("term").combine_chunks().dictionary_encode()
    if isinstance(encoded, pa.ChunkedArray):
        encoded = encoded.combine_chunks()
    names = encoded.dictionary.to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    names = [names[i] for i in order]
    at = {s: i for i, s in enumerate(sources)}
    counts = np.zeros((len(sources), len(names)), np.int64)
    rows = np.fromiter((at[s] for s in left.column("source").to_pylist()), np.int64, len(left))
    counts[rows, place[np.asarray(encoded.indices)] if len(left) else rows] = np.asarray(left.column("n"))
    kept, total, whole = (np.asarray(right.column(c)) for c in ("kept", "total", "whole"))
    p = frequencies(counts, np.maximum(1, total + kept)[:, None])
    out = {"source": [], "part": [], "item": [], "value": []}

    def add(source: str, part: str, items: list[str], values: list[int]) -> None:
        for column, new in zip(out.values(), ([source] * len(items), [part] * len(items), items, values), strict=True):
            column.extend(new)

    slab = max(1, BLOCK_CELLS // max(1, p.size))
    for a in range(0, len(sources), slab):
        sums = divergences(p[a : a + slab, None, :], p[None, :, :]).sum(2)
        for i, own in enumerate(sums.tolist(), a):
            add(sources[i], "pair", sources[:i] + sources[i + 1 :], own[:i] + own[i + 1 :])
    if names:
        q = frequencies(counts.sum(0), max(1, int(whole[0] + kept[0])))
        for i, source in enumerate(sources):
            more = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            values = divergences(p[i][more], q[more])
            best = np.argsort(-values, kind="stable")[:TOP]  # terms stand in the order of their bytes
            add(source, "term", [names[j] for j in more[best]], values[best].tolist())
    lang = right.column("lang")[0].as_py()
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.table([pa.array([lang] * len(out["item"]), pa.string()), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["lang", *out])


def audit_sources(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each group's divergence from the other sources of its language, and its ``TOP`` terms against the language."""
    counted = materialize(term_counts(docs), "terms")
    everywhere = F.sum("documents").over(W.partitionBy("lang", "term"))
    kept = materialize(
        counted.filter("term <> ''").withColumn("everywhere", everywhere).filter(F.col("everywhere") >= LEAST_DOCUMENTS).select("lang", "source", "term", "n"), "kept"
    )
    groups = counted.filter("term = ''").select("lang", "source")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole"))
    heights = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    width = F.greatest(F.lit(16), F.floor(F.lit(BLOCK_CELLS) / F.col("sources")))
    langs = materialize(
        heights.join(langs, "lang", "left").na.fill(0, ["kept", "whole"]).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / width)).cast("int")), "langs"
    )
    heads = groups.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs, "lang")
    heads = heads.select("lang", "source", "total", "kept", "whole", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = kept.join(langs.select("lang", "blocks"), "lang").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    found = cells.groupBy("lang", "block").cogroup(heads.groupBy("lang", "block")).applyInArrow(_tile, "lang string, source string, part string, item string, value long")
    found = materialize(found, "tiles")
    pairs = found.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= TOP)
    columns = ("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
    return pairs.withColumn("rank", rank).select(*columns).unionByName(best.select(*columns))


def oracle() -> str:
    """DuckDB SQL for :func:`audit_sources`."""
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
words AS MATERIALIZED (SELECT i, lang, source, term, count(*) AS n FROM (SELECT i, lang, source, unnest(w) AS term FROM docs) GROUP BY ALL),
vocabulary AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM words GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM vocabulary GROUP BY lang),
seen AS MATERIALIZED (SELECT w.lang, w.source, w.term, sum(w.n)::BIGINT AS n FROM words w JOIN vocabulary USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM seen GROUP BY ALL) t USING (lang, source)),
freq AS MATERIALIZED (
  SELECT g.lang, g.source, t.term, coalesce(s.n, 0) AS n, 1 + ({UNIT} * (coalesce(s.n, 0) + 1)) // (g.total + l.v) AS p, 1 + ({UNIT} * (t.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN vocabulary t USING (lang) LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = t.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM freq a JOIN freq b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL) f
    ON f.lang = a.lang AND f.source = a.source AND f.other = b.source),
found AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM freq WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM found QUALIFY part = 'pair' OR rank <= {TOP}
"""
