"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Documents with the same set of 5-word shingles are one row of the incidence matrix, its columns are the shingles. The product
of the matrix with its transpose counts overlaps. It is taken in two blocks of columns, and bounds that follow from the
sizes alone discard pairs before their overlap is counted in full. Two sets of n and m shingles link from an overlap of
need = ceil(80 (n + m) / 180) on.

1. First columns: the ``FIRST`` smallest hashes of each set. Counts are accumulated only between each row and one centre of
   a (column, size band): the row that most documents have. Pairs with half of these columns in common are counted over all their
   columns, and rows that link become one component. A large group of near copies so costs pairs in proportion to its size.
2. Prefix columns: in a common order, with the shingles of many documents last, sets that link share one of their first
   n // 5 + 1 shingles. Only rows of different components meet there, and a pair is dropped unless, at a shared column with ``left`` columns
   still to come (it included) on either side, the smaller ``left`` reaches need. Columns that only one row has are dead: of two
   rows, the one whose prefix ends first can reach at most n - its dead columns. Each row also has a parity of its columns in ``BITS`` bits: a
   column that only one of two rows has turns one bit, so at least as many columns differ as bits do, and
   (n + m) / 9 may. What is left is counted over all columns.

Counting over all columns goes block by block of the hash range; a pair is dropped once its count and what is left of the
smaller side fall below need.

The common order comes from a counting sketch of fixed size over all documents; it changes costs, not results.
A column that many rows of different, unlinked components have early in their order still costs their pairs.

Defined results: no words or null text gives an empty set that links with nothing; fewer than five words are one shingle;
rows with null doc_id get component_id null but still connect others; repeated rows are one matrix row and each is answered; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, trim
from .components import connected_components
from .shingles import batch_words, shingle_sets, signature

#: Counters of the sketch (fixed, whatever the corpus), sent in blocks.
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
#: Columns of each set in the first block, and how many of them a pair must share to be counted there.
FIRST, SHARED = 8, 4
#: Ratio of neighbouring size bands; sets of two bands apart can't link.
BAND = 1.25
#: Bits of a row's parity.
BITS = 512
#: Bytes of a shingle hash in rows sent for counting, and the blocks of columns in which it is done.
WIDE, COLUMN_BLOCKS = 6, 4
#: Rows of one task's table of sets already seen (a copy beyond it is sent again, and dropped later).
SEEN_LIMIT = 500_000


def _named(own: np.ndarray, renamed: dict[int, int]) -> tuple[int, int]:
    """(node, check) of a set: two halves of its signature; ``renamed`` holds the nodes of sets that share a first half."""
    both = np.frombuffer(signature(own), np.int64)
    node, check = int(both[0]), int(both[1])
    if node in renamed:
        node = xxhash.xxh3_64_intdigest(both.tobytes(), renamed[node]) - (1 << 63)
    return node, check


def _texts(batches):
    """(batch rows, shingle sets) of slices of the batches."""
    for batch in batches:
        for part, words in batch_words(batch.column("text")):
            yield batch.slice(part.start, part.stop - part.start), shingle_sets(words)
    trim()


def _rows(docs: DataFrame, renamed: dict[int, int]) -> DataFrame:
    """(doc_id, tkey, n, node, chk) of every document (node null if empty), and a task's sketch as rows (block, counts)."""
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "tkey", "n", "node", "chk", "block", "counts"]

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        id_type = None
        for batch, sets in _texts(batches):
            id_type = batch.schema.field("doc_id").type
            sizes = [len(s) for s in sets]
            named = [_named(s, renamed) if len(s) else (None, None) for s in sets]
            counters = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            sketch += np.bincount(counters, minlength=1 << SKETCH_BITS)
            k = len(sets)
            nodes, checks = zip(*named, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("tkey"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(checks, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                names=names,
            )
        if id_type is not None:
            parts = np.minimum(sketch, 255).astype(np.uint8).reshape(SKETCH_BLOCKS, -1)
            k = len(parts)
            blank = [pa.nulls(k, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    return keyed.mapInArrow(run, f"doc_id {doc_type}, tkey long, n long, node long, chk long, block int, counts binary")


def _levels(raw: DataFrame) -> np.ndarray:
    """How common each sketch counter is: 0, or more for those that chance doesn't explain.

    Tasks' sketches are added block by block; the driver gets ``SKETCH_BLOCKS`` rows of fixed size.
    """

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
                part = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "counts"]
            )

    parts = raw.filter("block IS NOT NULL").select("block", "counts").repartition(SKETCH_BLOCKS, "block")
    total = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.int64)
    for r in parts.mapInArrow(add, "block int, counts binary").collect():
        total[r["block"]] += np.frombuffer(bytes(r["counts"]), np.int64)
    flat = total.ravel()
    # counters hold the mean's worth of unrelated shingles, with a spread of its root
    above = (flat - flat.mean()) / (6 * np.sqrt(flat.mean()) + 8)
    return np.where(above > 1, 1 + np.log2(np.maximum(above, 1)), 0).astype(np.uint8)


def _columns(docs: DataFrame, renamed: dict[int, int], choose, schema: str) -> DataFrame:
    """Matrix entries (h, node, ...) of the columns that ``choose(set)`` gives as arrays; each set once a task."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        seen: set[int] = set()
        for _, sets in _texts(batches):
            held, nodes, times = [], [], []
            for own in sets:
                node = _named(own, renamed)[0] if len(own) else None
                if node is None or node in seen:
                    continue
                if len(seen) < SEEN_LIMIT:
                    seen.add(node)
                held.append(choose(own))
                nodes.append(node)
                times.append(len(held[-1][0]))
            if nodes:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                at = pa.array(np.repeat(np.array(nodes, np.int64), times))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), at, *map(pa.array, columns[1:])], names=names)

    return docs.select("text").mapInArrow(run, schema)


def prefix_size(n):
    """Columns of a set that enter the second block."""
    return n // 5 + 1


def _ordered_prefix(own: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    common = levels[own >> np.uint64(64 - SKETCH_BITS)]
    order = np.argsort(common, kind="stable")[: prefix_size(len(own))]  # own is sorted by hash
    return own[order], common[order]


def _parity(own: np.ndarray) -> list[np.ndarray]:
    """``BITS`` bits in words of 64: how often each value of the columns' lowest bits occurs, modulo 2."""
    odd = np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return list(np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, 1))


def _merged(grows: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: never to be broadcast, at any size."""
    return grows.hint("merge")


def _first_pairs(docs: DataFrame, renamed: dict[int, int], nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows and centres that share enough of their first columns."""
    entries = _columns(docs, renamed, lambda own: (own[:FIRST],), "h long, node long").join(_merged(nodes.select("node", "n", "copies")), "node")
    band = lambda n: F.floor(F.log(F.col(n).cast("double")) / float(np.log(BAND)) + 1e-9).cast("int")
    placed = materialize(entries.distinct().withColumn("own", band("n")), "first").withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    centre = F.max(F.struct("copies", F.xxhash64("node").alias("x"), "node", "n", "own")).alias("c")
    centres = placed.groupBy("h", "band").agg(centre, F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").drop("lo", "hi")
    # a pair is counted in the larger of its own two bands only
    met = placed.join(_merged(centres), ["h", "band"]).filter("node <> c.node AND band = greatest(own, c.own) AND 100 * least(n, c.n) >= 80 * greatest(n, c.n)")
    counted = met.groupBy("node", F.col("c.node").alias("b")).agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.first("c.n").alias("m"))
    enough = F.least(F.lit(SHARED), F.ceil(F.least("n", "m") / 2))
    return _ordered(counted.filter(F.col("shared") >= enough).select(F.col("node").alias("a"), "b"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefix_pairs(docs: DataFrame, renamed: dict[int, int], nodes: DataFrame, levels: np.ndarray, labels: DataFrame) -> DataFrame:
    """Pairs of rows of different components that the bounds over the prefix columns leave."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    entries = _columns(
        docs, renamed, lambda own: ((p := _ordered_prefix(own, shared.value)[0]), np.arange(len(p), dtype=np.int32)), "h long, node long, pos int"
    )
    live = entries.groupBy("h").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("h")
    # two rows at least have each of these columns
    alive = materialize(entries.join(_merged(materialize(live, "columns")), "h", "left_semi"), "alive")
    met = alive.distinct()
    left = met.groupBy("node").agg(F.count("*").alias("alive"))

    def ends(own):
        p, common = _ordered_prefix(own, shared.value)
        return own[:1], np.array([int(common[-1]) << 56 | int(p[-1]) >> 8], np.int64), *_parity(own)

    bits = [f"bits{i}" for i in range(BITS // 64)]
    ending = _columns(docs, renamed, ends, ", ".join(["h long, node long, ending long", *[f"{b} long" for b in bits]])).drop("h")
    facts = materialize(
        left.join(_merged(nodes.select("node", "n")), "node")
        .join(_merged(ending.dropDuplicates(["node"])), "node")
        .join(_merged(labels), "node", "left")
        .select("node", "n", "ending", F.coalesce("label", "node").alias("label"), (F.expr("n - (n div 5 + 1)") + F.col("alive")).alias("most"), *bits),
        "facts",
    )
    before = F.lag("h").over(W.partitionBy("node").orderBy("pos"))
    placed = materialize(met.join(_merged(facts), "node").withColumn("before", before), "placed")
    parts = placed.groupBy("h", "label").agg(F.count("*").alias("c"))
    tops = parts.groupBy("h").agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    mixed = materialize(placed.join(_merged(tops.select("h", F.col("top.label").alias("top"))), "h").withColumn("left", F.col("n") - F.col("pos")), "mixed")
    x, y = mixed.filter("label <> top").alias("x"), _merged(mixed).alias("y")
    once = "x.label <> y.label AND (y.label = y.top OR x.node < y.node)"
    first = "(x.before IS NULL OR y.before IS NULL OR x.before <> y.before)"  # else the column before is shared, too, and tells the pair
    placed_well = "180 * least(x.left, y.left) >= 80 * (x.n + y.n)"
    reach = "CASE WHEN x.ending < y.ending THEN x.most WHEN x.ending > y.ending THEN y.most ELSE greatest(x.most, y.most) END"
    apart = " + ".join(f"bit_count(x.{b} ^ y.{b})" for b in bits)
    pairs = x.join(y, F.expr(f"x.h = y.h AND {once} AND {first} AND {placed_well} AND 180 * ({reach}) >= 80 * (x.n + y.n) AND 9 * ({apart}) <= x.n + y.n"))
    found = materialize(_ordered(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))), "pairs")
    discard(alive, placed, mixed, facts)
    return found


def _pack(own: np.ndarray) -> bytes:
    """The upper ``WIDE`` bytes of sorted hashes, in order."""
    return own.view(np.uint8).reshape(-1, 8)[:, 8 - WIDE :].tobytes()


def _unpack(packed) -> np.ndarray:
    raw = np.frombuffer(packed, np.uint8).reshape(-1, WIDE)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 8 - WIDE :] = raw
    return out.view(np.uint64).ravel()


def links(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sorted rows overlap enough, counted block by block of the columns."""
    need = -(-80 * (len(u) + len(v)) // 180)
    cuts = np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) << np.uint64(62)
    a, b = [0, *np.searchsorted(u, cuts).tolist(), len(u)], [0, *np.searchsorted(v, cuts).tolist(), len(v)]
    count = 0
    for k in range(COLUMN_BLOCKS):
        both = np.concatenate([u[a[k] : a[k + 1]], v[b[k] : b[k + 1]]])
        both.sort(kind="stable")
        count += int((both[1:] == both[:-1]).sum())
        if count + min(len(u) - a[k + 1], len(v) - b[k + 1]) < need:
            return False
    return True


def _linked(docs: DataFrame, renamed: dict[int, int], pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, counted over all columns. Only rows in ``pairs`` are sent."""
    names = ["node", "columns"]

    def rows(batches):
        seen: set[int] = set()
        for _, sets in _texts(batches):
            held, nodes = [], []
            for own in sets:
                node = _named(own, renamed)[0] if len(own) else None
                if node is not None and node not in seen:
                    if len(seen) < SEEN_LIMIT:
                        seen.add(node)
                    nodes.append(node)
                    held.append(_pack(own))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(held, pa.binary())], names=names)

    def count(batches):
        for batch in batches:
            keep = [links(_unpack(x.as_buffer()), _unpack(y.as_buffer())) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = docs.select("text").mapInArrow(rows, "node long, columns binary").join(_merged(wanted), "node", "left_semi")
    sets = materialize(sent.dropDuplicates(["node"]), "sets")
    left = sets.select(F.col("node").alias("a"), F.col("columns").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("columns").alias("sb"))
    found = materialize(pairs.join(_merged(left), "a").join(_merged(right), "b").select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long"), "linked")
    discard(sets)
    return found


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, n, node) of every document, and (node, label) of every node that links."""
    renamed: dict[int, int] = {}
    raw = materialize(_rows(docs, renamed), "rows")
    nodes = raw.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("copies"), F.min("chk").alias("lo"), F.max("chk").alias("hi"))
    nodes = materialize(nodes, "nodes")
    # different sets with one first half: one is expected in 2**32 documents, none in most corpora
    renamed = {r["node"]: seed for seed, r in enumerate(nodes.filter("lo <> hi").select("node").sort("node").collect(), 1)}
    if renamed:
        raw = materialize(_rows(docs, renamed), "rows")
        nodes = materialize(raw.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.count("*").alias("copies")), "nodes")
    levels = _levels(raw)
    near = materialize(_first_pairs(docs, renamed, nodes), "near")
    labels = connected_components(_linked(docs, renamed, near))
    more = _linked(docs, renamed, _prefix_pairs(docs, renamed, nodes, levels, labels))
    named = lambda side: more.join(_merged(labels.withColumnsRenamed({"node": side, "label": f"l{side}"})), side, "left")
    joins = named("a").join(_merged(labels.withColumnsRenamed({"node": "b", "label": "lb"})), "b", "left")
    joins = joins.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    above = connected_components(joins).withColumnsRenamed({"node": "l", "label": "top"})
    outer = above.withColumnsRenamed({"l": "node", "top": "label"})
    inner = labels.join(_merged(above), labels["label"] == above["l"], "left").select("node", F.coalesce("top", "label").alias("label"))
    whole = inner.unionByName(outer.join(_merged(labels), "node", "left_anti").select("node", "label"))
    return raw.filter("block IS NULL").select("doc_id", "tkey", "n", "node"), whole


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document under links at Jaccard similarity 0.8."""
    rows, labels = _labelled(docs)
    ids = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = ids.join(_merged(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = materialize(named.join(_merged(least), "label").select("node", "component_id"), "components")
    full = rows.filter("n > 0").join(_merged(of_node), "node").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    empty = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return full.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id (a null counts as the largest).

    Ties of one doc_id go to the smaller hash of the text. Documents without words stay. Rows that repeat both doc_id and
    text count once.
    """
    rows, labels = _labelled(docs)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tkey")
    mine = rows.filter("n > 0").groupBy("node").agg(F.min(place).alias("place"), F.count("*").alias("copies")).join(_merged(labels), "node", "left")
    chosen = mine.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min(F.struct("place", "copies")).alias("m"))
    full = chosen.select("m.place.doc_id", "m.place.tkey", "m.copies")
    empty = rows.filter("n = 0").groupBy("doc_id", "tkey").agg(F.count("*").alias("copies"))
    kept = materialize(full.unionByName(empty), "kept").select(F.col("doc_id").alias("d"), F.col("tkey").alias("t"), "copies")
    # a row travels as one column, so its own names can't clash with these
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = whole.select("row", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("key"))
    found = own.join(_merged(kept), F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t"))).select("row", "copies")
    # only rows with copies can repeat
    again = found.filter("copies > 1").select("row", F.col("row.doc_id").alias("id"), F.col("row.text").alias("text")).dropDuplicates(["id", "text"])
    return found.filter("copies = 1").select("row.*").unionByName(again.select("row.*"))


def oracle() -> str:
    """DuckDB SQL for :func:`jaccard_components`."""
    return r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM tokens),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = a JOIN sizes k ON k.doc_id = b WHERE 100 * i >= 80 * (m.n + k.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS node, a AS seen FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS c FROM reach GROUP BY node) ON node = d.doc_id
"""
