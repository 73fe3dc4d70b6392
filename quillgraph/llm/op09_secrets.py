"""Incremental blob ledger for secret scans.

Every version of a text is addressed by its SHA-256. The ledger holds one row for each
(blob, rule version) that has been scanned, with the spans found, found or not. A scan takes the versions,
keeps one text for each blob, drops those whose (blob, rule version) the ledger has, scans
the rest once, and joins the spans back to every path that holds the blob.

Rules, leftmost and non-overlapping for each kind, positions in code points, end exclusive:

* ``assign``: a secret-like name (letters in either case), a separator, and a value of 6 or more characters
* ``access``: ``AKIA`` and upper-case letters or digits, 20 or more characters in all
* ``hex``: a run of 24 or more of 0-9 a-f

Matches that are too short use up their text and are dropped.

Defined results: null text counts as empty; a text without secrets has zero counts and the digest
of the empty string; repeated rows are each answered; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Part of the ledger's key: raise it when a pattern below changes.
RULE_VERSION = 1

#: Fixed patterns of the rules, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 6, "access": 20, "hex": 24}


SPAN = "array<struct<start:int,rank:int,end:int>>"
BLOCK = 256


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.transform(F.array(value), use)[0]


def prefix_fold(values: Column, op) -> Column:
    """Running results of ``op`` over an int array, from 0; in blocks, so that long arrays stay cheap."""

    def fold(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), op)

    def running(v: Column) -> Column:
        n = F.size(v)
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")),
            lambda b: fold(F.slice(v, b * BLOCK + 1, BLOCK)),
        )

        def within(bases: Column) -> Column:
            return F.transform(
                v,
                lambda _, i: op(
                    F.element_at(bases, F.floor(i / BLOCK).cast("int") + 1),
                    fold(F.slice(v, (F.floor(i / BLOCK) * BLOCK + 1).cast("int"), i % BLOCK + 1)),
                ),
            )

        return _bind(
            blocks,
            lambda b: _bind(F.transform(b, lambda _, i: F.when(i == 0, F.lit(0)).otherwise(fold(F.slice(b, 1, i)))), within),
        )

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(running(values))


def spans_of(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """All kept matches of one kind as array<struct<start, rank, end>>.

    The pieces between the matches (a split by the same pattern) give their positions.
    """
    length = lambda x: F.length(x)
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), length)
    values = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), length) if value_group else found

    def place(sizes: Column) -> Column:
        gaps = F.slice(F.transform(F.split(text, pattern, -1), length), F.lit(1), F.size(sizes))
        ends = prefix_fold(F.zip_with(gaps, sizes, lambda g, m: g + m), lambda a, b: a + b)
        rows = F.zip_with(ends, sizes, lambda e, m: F.struct((e - m).alias("start"), e.alias("end")))
        kept = F.filter(
            F.zip_with(rows, values, lambda r, v: F.struct(r["start"].alias("start"), r["end"].alias("end"), v.alias("v"))),
            lambda r: r["v"] >= LEAST[kind],
        )
        return F.transform(
            kept,
            lambda r: F.struct(r["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), r["end"].alias("end")),
        ).cast(SPAN)

    return _bind(found, lambda sizes: F.when(F.size(sizes) == 0, F.array().cast(SPAN)).otherwise(place(sizes)))


def scan(text: Column) -> Column:
    """All spans of a non-null text, by start, then kind as listed."""
    return F.array_sort(
        F.concat(
            spans_of(text, ASSIGN, "assign", 2), spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")
        )
    )


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ","
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""

    def pieces(done: Column) -> Column:
        # done[i]: the furthest end before span i
        kept = F.zip_with(
            F.slice(done, F.lit(1), F.size(spans)),
            spans,
            lambda d, s: F.when(s["start"] >= d, F.concat(F.substring(text, d + 1, s["start"] - d), F.lit(mark))).otherwise(""),
        )
        tail = F.substring(text, F.element_at(done, -1) + 1, F.length(text))
        return F.concat(F.array_join(kept, ""), tail)

    ends = prefix_fold(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    return F.when(F.size(spans) == 0, text).otherwise(_bind(F.concat(F.array(F.lit(0)), ends), pieces))


def address(versions: DataFrame) -> DataFrame:
    """Versions with their blob address; null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    return versions.withColumns({"text": text, "blob": F.unhex(F.sha2(text, 256))})


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of the blobs in ``versions`` that the ledger hasn't.

    Copies of a text meet before the scan, at most one of each from a task, so
    a text held by a third of all rows is neither a large group nor scanned twice.
    """
    blobs = address(versions).select("blob", "text").dropDuplicates(["blob"])
    if ledger is not None:
        known = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    return blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), scan(F.col("text")).alias("spans"))


def find_secrets(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row for each version with the spans the ledger holds for its blob."""
    current = ledger.filter(F.col("rule_version") == RULE_VERSION).select("blob", "spans")
    return address(versions).drop("text").join(current, "blob", "left")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Secrets of every document, through the ledger."""
    paths = docs.select("doc_id", "text")
    new = materialize(update_ledger(paths, ledger), "ledger")  # a hot blob's join is then split by itself
    whole = new if ledger is None else ledger.unionByName(new)
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    spans = written(F.col("spans"))
    return find_secrets(paths, whole).select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans, 256).alias("base_sha256"),
        spans.alias("spans"),
    )


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked; every row stays, with its columns."""
    spans = materialize(update_ledger(docs.select("text")), "ledger").select("blob", "spans")
    rows = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("blob"))
    text = F.col("row.text")
    masked = F.when(F.size("spans") > 0, redact(text, F.col("spans"))).otherwise(text)
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    new = {"text": F.col("text"), "n_chars": length}
    joined = rows.join(spans, "blob", "left").select("row", masked.alias("text"))
    return joined.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for :func:`scan_documents`."""
    kinds = []
    for rank, (kind, pattern, group) in enumerate((("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0))):
        p = pattern.replace("'", "''")
        kinds.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
      's': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
      'm': length(m[i]), 'v': length(v[i])}})) AS f
  FROM (SELECT doc_id, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m,
      regexp_extract_all(t, '{p}', {group}) AS v FROM texts)""")
    least = " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items())
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(kinds)}),
kept AS (SELECT doc_id, rank, kind, f.s::BIGINT AS s, (f.s + f.m)::BIGINT AS e FROM found
  WHERE f.v >= CASE kind {least} END),
grouped AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k,
  count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN grouped USING (doc_id)
"""
