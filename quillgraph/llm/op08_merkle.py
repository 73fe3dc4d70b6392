"""Merkle fingerprints: leaves under paragraphs under sections under one root.

A paragraph is a line; lines of more than 64 code points are divided into pieces of 64,
so that an edit inside a long line leaves its other pieces alone. A leaf is the SHA-256 of its piece, a paragraph's node
that of its leaves. A section ends with each paragraph whose node is 0 modulo 8 (a boundary that moves with the
content), its node is the SHA-256 of its paragraphs' nodes; the root is that of the section nodes and of the text's length. All nodes are
made from whole digests, so roots test equality. The fingerprint is the text ``root|section:leaf,leaf;section:leaf|...`` in
hexadecimal, with section nodes cut to 16 and leaves to 8 digits: differing sections and leaves locate edits.

The likeness of two fingerprints is the share of their distinct (cut) leaves and roots that both have: 1 for equal
texts only.

Defined results: null text counts as empty; an empty text has one empty leaf; rows that repeat
both doc_id and text count as one document and come out as often as they come in; documents with
equal doc_id are ordered by the digest of their text; a null doc_id comes last in descending order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_row_numbers, materialize

PIECE = 64
#: Last digits of a paragraph's node that end a section: 0 modulo 8.
BOUNDARY = ("0", "8")
#: Digits of nodes in a fingerprint.
SECTION_DIGITS, LEAF_DIGITS = 16, 8


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def merkle(text: Column) -> Column:
    """Struct (root string, sections array<struct<node, leaves>>) of a non-null text."""

    def paragraph(line: Column) -> Column:
        pieces = F.when(
            F.length(line) > PIECE,
            F.regexp_extract_all(line, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)),
        ).otherwise(F.array(line))
        return _bind(
            F.transform(pieces, lambda p: F.sha2(p, 256)),
            lambda leaves: F.struct(F.sha2(F.array_join(leaves, ","), 256).alias("node"), F.transform(leaves, lambda x: F.substring(x, 1, LEAF_DIGITS)).alias("leaves")),
        )

    def sections(ps: Column) -> Column:
        last = F.size(ps)
        ends = F.filter(
            F.sequence(F.lit(1), last),
            lambda i: (i == last) | F.substring(F.element_at(ps, i)["node"], -1, 1).isin(*BOUNDARY),
        )
        before = lambda es: F.concat(F.array(F.lit(0)), F.slice(es, F.lit(1), F.size(es) - 1))
        cut = _bind(ends, lambda es: F.zip_with(before(es), es, lambda a, b: F.slice(ps, a + 1, b - a)))
        return F.transform(
            cut,
            lambda own: F.struct(
                F.sha2(F.array_join(F.transform(own, lambda p: p["node"]), ","), 256).alias("node"),
                F.flatten(F.transform(own, lambda p: p["leaves"])).alias("leaves"),
            ),
        )

    def rooted(parts: Column) -> Column:
        nodes = F.array_join(F.transform(parts, lambda s: s["node"]), ",")
        return F.struct(
            F.sha2(F.concat_ws(":", F.length(text).cast("string"), nodes), 256).alias("root"), parts.alias("sections")
        )

    return _bind(F.transform(F.split(text, "\n", -1), paragraph), lambda ps: _bind(sections(ps), rooted))


def serialise(tree: Column) -> Column:
    """Fingerprint text of a :func:`merkle` struct."""
    section = lambda s: F.concat(F.substring(s["node"], 1, SECTION_DIGITS), F.lit(":"), F.array_join(s["leaves"], ","))
    return F.concat(tree["root"], F.lit("|"), F.array_join(F.transform(tree["sections"], section), ";"))


def _number(leaf: Column) -> Column:
    """A cut leaf as an int."""
    return (F.conv(leaf, 16, 10).cast("long") - (1 << 31)).cast("int")


def distinct_leaves(tree: Column) -> Column:
    """Distinct leaves of a :func:`merkle` struct as ints."""
    return F.array_distinct(F.flatten(F.transform(tree["sections"], lambda s: F.transform(s["leaves"], _number))))


def parsed(fingerprint: Column) -> Column:
    """Struct (root, distinct leaves) that a fingerprint names."""
    leaves = F.flatten(
        F.transform(F.split(F.substring_index(fingerprint, "|", -1), ";"), lambda s: F.split(F.substring_index(s, ":", -1), ","))
    )
    return F.struct(
        F.substring_index(fingerprint, "|", 1).alias("root"), F.array_distinct(F.transform(leaves, _number)).alias("leaves")
    )


def likeness(a: Column, b: Column) -> Column:
    """Likeness, from 0 to 1, of a fingerprint and the :func:`parsed` form of another."""

    def compare(x: Column, y: Column) -> Column:
        shared = _bind(
            F.size(F.array_intersect(x["leaves"], y["leaves"])),
            lambda s: s / (F.size(x["leaves"]) + F.size(y["leaves"]) - s + 2),  # and two roots
        )
        return F.when(x["root"] == y["root"], F.lit(1.0)).otherwise(shared)

    return _bind(parsed(a), lambda x: _bind(b, lambda y: compare(x, y)))


def changed_sections(a: Column, b: Column) -> Column:
    """Sections of fingerprint ``a`` that ``b`` doesn't have: where an edit lies."""
    parts = lambda f: F.split(F.substring_index(f, "|", -1), ";")
    return F.array_except(parts(a), parts(b))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint every document and its edited text, and compare with the next document.

    The edited text is the text with its last floor(n/2) code points replaced by the first
    as many of the next document in descending doc_id (after the last, the first).

    The order is found on ids and digests alone. A text is then moved once by its key (one
    exchange serves both joins), and at most half of it, cut to the length wanted, to the
    document before it.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.col("text"), 256)).alias("key"),
        "text",
    )
    ids = keyed.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.max(F.length("text")).alias("n_chars"))
    ranked, n = global_row_numbers(ids, [F.col("doc_id").isNull(), -F.col("doc_id"), F.col("key")])
    follows = ranked.select(
        ((F.col("rn") + max(n - 1, 0)) % max(n, 1)).alias("rn"), F.col("key").alias("next_key")
    )
    pairs = materialize(ranked.join(follows, "rn").select("doc_id", "key", "next_key", "n_chars"), "follows")

    texts = keyed.select("key", "text")  # the same columns on both sides, so that the exchange is reused
    tree = merkle(F.col("text"))
    heads = (
        texts.withColumnRenamed("key", "next_key")
        .join(pairs, "next_key")
        .select(
            "key",
            "doc_id",
            F.expr("substring(text, 1, n_chars div 2)").alias("head"),
            _bind(tree, lambda t: F.struct(t["root"].alias("root"), distinct_leaves(t).alias("leaves"))).alias("next"),
        )
        .groupBy("key")  # a repeated next document offers the same head more than once
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "head", "next")])
    )
    edited = F.concat(F.expr("substring(text, 1, length(text) - length(text) div 2)"), F.col("head"))
    tree = (
        texts.join(heads, "key")
        .select("doc_id", "text", edited.alias("edited"), "next")
        .select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited"), 256).alias("edited_sha256"),
            serialise(merkle(F.col("text"))).alias("fingerprint"),
            serialise(merkle(F.col("edited"))).alias("edited_fingerprint"),
            "next",
        )
    )
    return tree.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), parsed(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )


def oracle() -> str:
    """DuckDB SQL for :func:`fingerprint_edits` over documents of distinct ids."""
    lines = f"list_transform(string_split(t, chr(10)), lambda l: CASE WHEN l = '' THEN [''] ELSE regexp_extract_all(l, '(?s).{{1,{PIECE}}}', 0) END)"
    ends = ", ".join(f"'{d}'" for d in BOUNDARY)
    return f"""
WITH ordered AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS rn, count(*) OVER () AS n FROM documents),
follows AS (
  SELECT a.doc_id, a.text, b.doc_id AS next_id, length(a.text) AS k,
    left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited
  FROM ordered a JOIN ordered b ON b.rn = a.rn % a.n + 1),
texts AS (SELECT doc_id, 0 AS kind, text AS t FROM follows UNION ALL SELECT doc_id, 1, edited FROM follows),
leaves AS (SELECT doc_id, kind, length(t) AS k, list_transform({lines}, lambda ps: list_transform(ps, lambda p: sha256(p))) AS ls FROM texts),
paragraphs AS (SELECT *, list_transform(ls, lambda own: sha256(array_to_string(own, ','))) AS nodes FROM leaves),
ends AS (SELECT *, list_filter(range(1, len(nodes) + 1), lambda i: i = len(nodes) OR nodes[i][64:64] IN ({ends})) AS es FROM paragraphs),
sections AS (
  SELECT doc_id, kind, k, list_transform(range(1, len(es) + 1), lambda j: {{
    'node': sha256(array_to_string(nodes[(CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END) + 1 : es[j]], ',')),
    'leaves': list_transform(flatten(ls[(CASE WHEN j = 1 THEN 0 ELSE es[j - 1] END) + 1 : es[j]]), lambda x: x[1:{LEAF_DIGITS}])}}) AS parts FROM ends),
prints AS (
  SELECT doc_id, kind, sha256(k || ':' || array_to_string(list_transform(parts, lambda p: p.node), ',')) AS root,
    list_distinct(flatten(list_transform(parts, lambda p: p.leaves))) AS ls,
    array_to_string(list_transform(parts, lambda p: p.node[1:{SECTION_DIGITS}] || ':' || array_to_string(p.leaves, ',')), ';') AS rest FROM sections)
SELECT f.doc_id, f.k::BIGINT AS n_chars, sha256(f.edited) AS edited_sha256, x.root || '|' || x.rest AS fingerprint, y.root || '|' || y.rest AS edited_fingerprint,
  CASE WHEN x.root = y.root THEN 1.0::DOUBLE ELSE len(list_intersect(x.ls, y.ls)) / (len(x.ls) + len(y.ls) - len(list_intersect(x.ls, y.ls)) + 2) END AS near_edited,
  CASE WHEN x.root = z.root THEN 1.0::DOUBLE ELSE len(list_intersect(x.ls, z.ls)) / (len(x.ls) + len(z.ls) - len(list_intersect(x.ls, z.ls)) + 2) END AS near_next
FROM follows f JOIN prints x ON x.doc_id = f.doc_id AND x.kind = 0 JOIN prints y ON y.doc_id = f.doc_id AND y.kind = 1
  JOIN prints z ON z.doc_id = f.next_id AND z.kind = 0
"""
