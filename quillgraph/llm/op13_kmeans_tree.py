"""Approximate nearest neighbours by cosine: a hierarchical k-means tree, searched best bin first.

A k-means tree (``BRANCH`` children a node) of two or three levels is fitted at the driver on at most ``SAMPLE`` vectors; its leaves are the
cells. Every vector goes down the tree to its cell; a cell with more than ``UNIT_ROWS`` vectors is dealt by hash into units, so
that a hot cell is many units. Each unit's task continues the tree over all its rows down to leaves of about ``LEAF_ROWS``.
A query takes cells from a priority queue over the nodes of the upper tree, nearest centre first, and in each unit of those
cells takes leaves from a priority queue in the same way.

How many cells and leaves are visited is calibrated: up to ``CALIBRATION`` rows are searched through all cells and leaves, which is exact, while
the turn at which their neighbours' cell and leaf came up is kept. Visits are widened, cheapest first, until these turns give
``RECALL`` of the neighbours; the queries are then searched with that width.

Equal vectors are one point with the ids that can matter: the k + 1 smallest, each at most k times; more of them could not be among
any query's k best. Scores are recomputed one by one from the original vectors, so equal vectors score equally wherever they lie.

Defined results: a vector that is null, empty or all zero, or holds a null or non-finite component, takes no part, as query or candidate; nor does a row
without vec_id, which a result can't name; shorter vectors count as filled up with zeros; a query's own row is every row with its vec_id;
repeated candidate rows are candidates each, repeated query rows (same id and vector) are asked once; ties go to the smaller
vec_id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

K = 5
BRANCH = 8
LEAF_ROWS = 32
UNIT_ROWS = 4096
BLOCK_ROWS = 512
SAMPLE = 16384
#: Components of the sample, so that long vectors are sampled less.
SAMPLE_CELLS = 1 << 23
CALIBRATION = 256
RECALL = 0.97
STEPS = 8
FOUND = "query_key long, query_id long, vec_id long, score double, cell_turn int, leaf_turn int"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and components (doubles, of one length) of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    kept = vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    v = F.transform(x, lambda c: c.cast("double"))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.concat(v, F.array_repeat(F.lit(0.0), F.lit(longest) - F.size(x))).alias("v"))


def levelled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that no square leaves a double's range; a cosine stays the same."""
    _, exponent = np.frexp(np.abs(v).max(1, initial=0))
    return np.ldexp(v, -exponent[:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(1))


class KMeansTree:
    """Hierarchical k-means tree over rows of unit length; ``order`` lists the rows leaf by leaf."""

    def __init__(self, unit: np.ndarray, leaf_rows: int, levels: int = 64):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.ranges: list[tuple[int, int]] = []
        self.order = np.arange(len(unit))
        if len(unit):
            self._node(unit, 0, len(unit), leaf_rows, levels)
        self.matrix = np.array(self.centres).reshape(len(self.centres), unit.shape[1])

    def _node(self, unit: np.ndarray, a: int, b: int, leaf_rows: int, levels: int) -> int:
        me, own = len(self.centres), unit[self.order[a:b]]
        mean = own.mean(0)
        size = math.sqrt(mean @ mean)
        self.centres.append(mean / size if size > 1e-9 else own[0])
        self.children.append([])
        self.ranges.append((a, b))
        if levels and b - a > leaf_rows:
            near = clusters(own, min(BRANCH, -(-(b - a) // leaf_rows)))
            place = np.argsort(near, kind="stable")
            cuts = np.searchsorted(near[place], np.arange(near.max() + 2))
            if near.max():
                self.order[a:b] = self.order[a:b][place]
                self.children[me] = [self._node(unit, a + i, a + j, leaf_rows, levels - 1) for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i]
        return me

    def leaves(self, near: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves of a best-bin-first traversal; ``near`` is the query's similarity to every node's centre."""
        queue, out = [(0.0, 0)] if len(near) else [], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            while self.children[node]:
                ranked = sorted((-near[c], c) for c in self.children[node])
                for bin_ in ranked[1:]:
                    heapq.heappush(queue, bin_)
                node = ranked[0][1]  # down to the nearest leaf, the other bins wait
            out.append(node)
        return out

    def descend(self, unit: np.ndarray) -> np.ndarray:
        """The leaf that each row of ``unit`` belongs to, going to the nearest child at every node."""
        at = np.zeros(len(unit), np.int64)
        for node, own in enumerate(self.children):  # children have higher numbers
            rows = np.flatnonzero(at == node) if own else []
            if len(rows):
                at[rows] = np.array(own)[(unit[rows] @ self.matrix[own].T).argmax(1)]
        return at


def clusters(unit: np.ndarray, k: int) -> np.ndarray:
    """Cluster of each row after a few spherical k-means steps; centres begin far from each other. Empty clusters are left out."""
    centres, near = [unit[0]], unit @ unit[0]
    for _ in range(k - 1):
        centres.append(unit[near.argmin()])
        near = np.maximum(near, unit @ centres[-1])
    book = np.array(centres)
    for _ in range(STEPS):
        code = (unit @ book.T).argmax(1)
        sums = np.zeros_like(book)
        np.add.at(sums, code, unit)
        size = norms(sums)
        book = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], book)
    return np.unique((unit @ book.T).argmax(1), return_inverse=True)[1].ravel()


def _rows(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    level = levelled(v)
    return level / norms(level)[:, None]


def points(clean: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors with the ids that can matter, ascending."""
    counted = clean.groupBy("v", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    first = counted.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    return first.groupBy("v").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "times"))), lambda s: F.array_repeat(s["vec_id"], s["times"]))).alias("ids"))


def _celled(table: DataFrame, tree: KMeansTree, fields: list[str]) -> DataFrame:
    """``table`` with the cell of each vector."""

    def go(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(tree.descend(_unit(_rows(batch.column("v")))), pa.int32())], [*fields, "cell"])

    kinds = ", ".join(f"{f} {table.schema[f].dataType.simpleString()}" for f in fields)
    return table.select(*fields).mapInArrow(go, f"{kinds}, cell int")


def _build(table: pa.Table) -> pa.Table:
    v = levelled(_rows(table.column("v")))
    tree = KMeansTree(v / norms(v)[:, None], LEAF_ROWS)
    ids = table.column("ids").to_pylist()
    kept = (tree, v[tree.order], [ids[i] for i in tree.order])
    return pa.table({"cell": table.column("cell")[:1], "chunk": table.column("chunk")[:1], "tree": pa.array([pickle.dumps(kept, protocol=5)], pa.binary())})


def _search(k: int, most: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            tree, v, ids = pickle.loads(left.column("tree")[0].as_py())
            length = norms(v)
            unit = v / length[:, None]
            asked = levelled(_rows(right.column("v")))
            size = norms(asked)
            near = (asked / size[:, None]) @ tree.matrix.T
            for i, (key, own, turn) in enumerate(zip(*(right.column(c).to_pylist() for c in ("query_key", "query_id", "cell_turn")), strict=True)):
                found = tree.leaves(near[i], most)
                spans = [tree.ranges[leaf] for leaf in found]
                place = np.concatenate([np.arange(a, b) for a, b in spans])
                turns = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
                about = unit[place] @ (asked[i] / size[i])
                if len(about) > k + 1:  # the query's own point may be among them
                    some = about >= np.partition(about, -(k + 1))[-(k + 1)] - 1e-9
                    place, turns = place[some], turns[some]
                scores = (v[place] * asked[i]).sum(1) / (length[place] * size[i])
                rows = [(-s, vec, t) for p, s, t in zip(place.tolist(), scores.tolist(), turns.tolist(), strict=True) for vec in ids[p] if vec != own]
                out += [(key, own, vec, -s, turn, t) for s, vec, t in heapq.nsmallest(k, rows)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["query_key", "query_id", "vec_id", "score", "cell_turn", "leaf_turn"])

    return search


def _asked(queries: DataFrame, tree: KMeansTree, most: int) -> DataFrame:
    """A row for each query and each of its first ``most`` cells, with the cell's turn."""

    def go(batches):
        for batch in batches:
            near = _unit(_rows(batch.column("v"))) @ tree.matrix.T
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("query_key", "query_id", "v")), pa.array([tree.leaves(n, most) for n in near], pa.list_(pa.int32()))], ["query_key", "query_id", "v", "cells"])

    listed = queries.select("query_key", "query_id", "v").mapInArrow(go, "query_key long, query_id long, v array<double>, cells array<int>")
    return listed.select("query_key", "query_id", "v", F.posexplode("cells").alias("cell_turn", "cell"))


class Index:
    """The tree over all vectors: the upper tree, chunks of each cell (at most BRANCH^3) and a table of units."""

    def __init__(self, clean: DataFrame, k: int = K):
        spark, self.k = clean.sparkSession, k
        distinct = materialize(points(clean, k), "points")
        n, length = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
        room = max(1, min(SAMPLE, SAMPLE_CELLS // max(1, length or 1)))
        sample = distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(room).collect()  # a bounded sample, by hash
        unit = _unit(np.array([r["v"] for r in sample])) if sample else np.zeros((0, 1))
        levels = 2 if n <= BRANCH**2 * UNIT_ROWS else 3
        self.tree = KMeansTree(unit, max(1, LEAF_ROWS * len(sample) // max(1, n)) if n else 1, levels)
        self.cells = sum(not c for c in self.tree.children)
        if not sample:
            self.units = self.chunks = None
            return
        placed = materialize(_celled(distinct, self.tree, ["v", "ids"]), "cells")
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell of the upper tree
        self.chunks = [max(1, math.ceil(counts.get(c, 0) / UNIT_ROWS)) for c in range(len(self.tree.children))]
        chunk = F.pmod(F.xxhash64("v"), self._of(self.chunks)).cast("int")
        self.units = materialize(placed.withColumn("chunk", chunk).groupBy("cell", "chunk").applyInArrow(_build, "cell int, chunk int, tree binary"), "units")

    @staticmethod
    def _of(values: list[int]) -> Column:
        """The value of the row's cell."""
        return F.element_at(F.array(*map(F.lit, values)), F.col("cell") + 1)

    def search(self, queries: DataFrame, cells: int, leaves: int) -> DataFrame:
        """The k best of every query (query_key, query_id, v) in its first cells and leaves, with their turns and rank."""
        asked = materialize(_asked(queries, self.tree, cells), "asked")
        wanted = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        blocks = [max(1, math.ceil(wanted.get(c, 0) / BLOCK_ROWS)) for c in range(len(self.chunks))]
        dealt = asked.withColumn("block", F.pmod("query_key", self._of(blocks)).cast("int"))
        dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), self._of(self.chunks) - 1)))
        units = self.units.withColumn("block", F.explode(F.sequence(F.lit(0), self._of(blocks) - 1)))
        by = ("cell", "chunk", "block")
        found = units.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_search(self.k, leaves), FOUND)
        rank = F.row_number().over(W.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= self.k)


def widened(turns: list[tuple[int, int]], cells: int, recall: float) -> tuple[int, int]:
    """The cheapest (cells, leaves a unit) under which ``recall`` of the turns (cell, leaf) come up."""
    if not turns:
        return max(1, cells), 1 << 30
    need, best = math.ceil(recall * len(turns)), None
    for c in range(1, cells + 1):
        leaf = sorted(t for at, t in turns if at < c)
        if len(leaf) >= need:
            width = leaf[need - 1] + 1
            if best is None or c * (4 + width) < best[0] * (4 + best[1]):
                best = c, width
    return best


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of every query row."""
    spark = vectors.sparkSession
    asks = usable(vectors.withColumn("vec_id", F.when(is_query, F.col("vec_id"))))
    clean = materialize(usable(vectors), "vectors")
    index = Index(clean, k)
    if index.units is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    key = F.xxhash64("vec_id", "v").alias("query_key")
    trial = clean.select(key, F.col("vec_id").alias("query_id"), "v").orderBy(F.xxhash64("query_key"), "query_id").limit(CALIBRATION)
    turns = index.search(trial, index.cells, 1 << 30).select("cell_turn", "leaf_turn").collect()  # CALIBRATION * k rows at most
    cells, leaves = widened([tuple(t) for t in turns], index.cells, recall)
    length = clean.agg(F.max(F.size("v")).alias("n")).first()["n"]
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(length) - F.size("v"))).alias("v")
    queries = asks.select("vec_id", filled).distinct().select(key, F.col("vec_id").alias("query_id"), "v")
    found = index.search(queries, cells, leaves)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest_embeddings(vectors: DataFrame) -> DataFrame:
    """The 5 nearest found of every row whose vec_id is divisible by 50."""
    return nearest(vectors, F.col("vec_id") % 50 == 0)
