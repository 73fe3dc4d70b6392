"""Exact top-k inner-product search by ball trees, branch and bound.

Vectors are dealt to shards of about ``SHARD_ROWS`` rows and each shard builds one ball
tree. Queries go in blocks of about ``BLOCK_ROWS``. A node's inner product with a query is
at most q . centre + |q| * radius; a node is left out for the queries whose current kth score is above
that bound, and children are visited in the order of their bounds. Every block is first
searched in one shard; the kth scores found there are shared with its searches of all other shards.

Equal vectors are one point of a tree with the ids that can matter: the copies of the k + 1
smallest ids, of each at most k. More of them could not be among any query's k best.

Defined results: components become floor(256 * x); a vector that is null or empty or holds a null or non-finite component takes no
part, as query or candidate; a query's own row is every row with its vec_id; repeated candidate rows are candidates each,
repeated query rows (same id and vector) are asked once; rows without an id take no part; ties go to the smaller vec_id; vectors
are compared with those of the same length; an empty table gives no rows.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

K = 5
SHARD_ROWS = 8192
BLOCK_ROWS = 2048
LEAF_ROWS = 64
LOWEST = -(1 << 62)
FOUND = "query_key long, query_id long, vec_id long, score long"


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and integer components of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.coalesce(finite, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.alias("q"), F.size(x).alias("dim")
    )


class BallTree:
    """Ball tree over integer points; ``ids[i]`` are the ids of point i."""

    def __init__(self, points: np.ndarray, ids: list[np.ndarray]):
        order = np.arange(len(points))
        self.nodes: list[tuple[int, int, int, int, np.ndarray, float]] = []
        floats = points.astype(np.float64)
        self._split(floats, order, 0, len(order))
        owned = [ids[i] for i in order]
        self.points = floats[order]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in owned])])
        self.ids = np.concatenate(owned) if owned else np.zeros(0, np.int64)
        self.largest = float(np.abs(self.points).max(initial=0))

    def _split(self, points: np.ndarray, order: np.ndarray, a: int, b: int) -> int:
        own = points[order[a:b]]
        centre = own.mean(0)
        apart = own - centre
        radius = float(np.sqrt((apart**2).sum(1).max()))
        me = len(self.nodes)
        self.nodes.append((a, b, -1, -1, centre, radius))
        if b - a > LEAF_ROWS:
            far = apart[(apart**2).sum(1).argmax()]
            along = apart @ far
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, half)]
            left, right = self._split(points, order, a, a + half), self._split(points, order, a + half, b)
            self.nodes[me] = (a, b, left, right, centre, radius)
        return me

    def search(self, q: np.ndarray, own_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best for each query that reach ``floor`` (its shared kth score)."""
        best = np.full((len(q), k), LOWEST, np.int64)
        best_ids = np.full((len(q), k), np.iinfo(np.int64).max)
        qf = q.astype(np.float64)
        norms = np.sqrt((qf**2).sum(1))
        exact = float(np.abs(qf).max(initial=0)) * self.largest * q.shape[1] < 2**52

        def bound(node: int, rows: np.ndarray) -> np.ndarray:
            _, _, _, _, centre, radius = self.nodes[node]
            slack = 1e-9 * norms[rows] * (np.sqrt((centre**2).sum()) + radius) + 1e-3
            return qf[rows] @ centre + norms[rows] * radius + slack

        stack = [(0, np.arange(len(q)), bound(0, np.arange(len(q))))] if len(self.points) and len(q) else []
        while stack:
            node, rows, upper = stack.pop()
            live = upper >= np.maximum(best[rows, k - 1], floor[rows])
            rows = rows[live]
            if not len(rows):
                continue
            a, b, left, right, _, _ = self.nodes[node]
            if left >= 0:
                bounds = {child: bound(child, rows) for child in (left, right)}
                for child in sorted(bounds, key=lambda c: bounds[c].mean()):  # the larger bound is visited first
                    stack.append((child, rows, bounds[child]))
                continue
            points = self.points[a:b]
            if exact:
                scores = (qf[rows] @ points.T).astype(np.int64)
            else:
                scores = q[rows] @ points.astype(np.int64).T
            f, t = self.first[a], self.first[b]
            times = np.diff(self.first[a : b + 1])
            ids = np.broadcast_to(self.ids[f:t], (len(rows), t - f))
            scores = np.where(ids == own_ids[rows, None], LOWEST, np.repeat(scores, times, axis=1))
            all_scores = np.concatenate([best[rows], scores], 1)
            all_ids = np.concatenate([best_ids[rows], ids], 1)
            top = np.lexsort((all_ids, -all_scores), axis=-1)[:, :k]
            best[rows] = np.take_along_axis(all_scores, top, 1)
            best_ids[rows] = np.take_along_axis(all_ids, top, 1)
        return best, best_ids


def _rows(column: pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).reshape(len(flat), -1)


def _build(k: int):
    def build(table: pa.Table) -> pa.Table:
        points, back = np.unique(_rows(table.column("q")), axis=0, return_inverse=True)
        ids = np.asarray(table.column("vec_id"))
        order = np.lexsort((ids, back.ravel()))
        cuts = np.flatnonzero(np.diff(back.ravel()[order])) + 1
        kept = []
        for own in np.split(ids[order], cuts):
            if len(own) > k:
                values, times = np.unique(own, return_counts=True)
                own = np.repeat(values[: k + 1], np.minimum(times[: k + 1], k))
            kept.append(own)
        blob = pickle.dumps(BallTree(points, kept), protocol=5)
        return pa.table(
            {"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "tree": pa.array([blob], pa.binary())}
        )

    return build


def _search(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_key", "query_id", "vec_id", "score")})
        tree: BallTree = pickle.loads(left.column("tree")[0].as_py())
        keys, own = np.asarray(right.column("query_key")), np.asarray(right.column("query_id"))
        scores, ids = tree.search(_rows(right.column("q")), own, np.asarray(right.column("floor")), k)
        real = scores > LOWEST
        row = np.nonzero(real)[0]
        return pa.table(
            {"query_key": keys[row], "query_id": own[row], "vec_id": ids[real].astype(np.int64), "score": scores[real]}
        )

    return search


def _ranked(found: DataFrame, k: int) -> DataFrame:
    by = W.partitionBy("query_key", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """The k best candidates of every query row, over all rows."""
    clean = materialize(scaled(vectors).withColumn("asks", is_query), "vectors")
    counts = clean.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("asks").cast("int")), F.lit(0)).alias("q")).first()
    shards = max(1, math.ceil(counts["n"] / SHARD_ROWS))
    blocks = max(1, math.ceil(counts["q"] / BLOCK_ROWS))
    # copies of a row read by different tasks go to different shards
    shard = F.pmod(F.xxhash64("vec_id", "q", F.spark_partition_id()), F.lit(shards)).cast("int")
    trees = materialize(
        clean.select("vec_id", "q", "dim", shard.alias("shard"))
        .groupBy("dim", "shard")
        .applyInArrow(_build(k), "dim int, shard int, tree binary"),
        "trees",
    )
    key = F.xxhash64("vec_id", "q")
    queries = (
        clean.filter("asks")
        .select(F.col("vec_id").alias("query_id"), "q", "dim")
        .distinct()
        .withColumnRenamed("query_id", "vec_id")
        .select(key.alias("query_key"), F.col("vec_id").alias("query_id"), "q", "dim")
        .withColumn("block", F.pmod("query_key", F.lit(blocks)).cast("int"))
    )

    def searched(asked: DataFrame) -> DataFrame:
        units = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        by = ("dim", "shard", "block")
        return units.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(_search(k), FOUND)

    home = F.pmod(F.col("block"), F.lit(shards)).cast("int")
    first = materialize(_ranked(searched(queries.select("*", home.alias("shard"), F.lit(LOWEST).alias("floor"))), k), "first")
    shared = first.filter(F.col("rank") == k).select("query_key", "query_id", F.col("score").alias("floor"))
    rest = (
        queries.join(shared, ["query_key", "query_id"], "left")
        .withColumn("floor", F.coalesce("floor", F.lit(LOWEST)))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        .filter(F.col("shard") != home)
    )
    found = first.drop("rank").unionByName(searched(rest)) if shards > 1 else first.drop("rank")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(vectors: DataFrame) -> DataFrame:
    """The 5 best of every row whose vec_id is divisible by 50."""
    return top_k(vectors, F.col("vec_id") % 50 == 0)


def oracle() -> str:
    """DuckDB SQL for :func:`search_embeddings`."""
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
asked AS (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0),
scored AS (
  SELECT a.vec_id AS query_id, a.q, c.vec_id, list_inner_product(a.q, c.q)::BIGINT AS score
  FROM asked a JOIN v c ON a.vec_id <> c.vec_id AND len(a.q) = len(c.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= {K}
"""
