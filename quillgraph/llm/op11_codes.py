"""Product-quantised vector codes by Lloyd rounds that move only what changed.

Vectors become integers floor(4096 * x) and are cut into equal parts; every part position has a codebook of integer
entries. A table in the shared folder keeps each vector with its previous and its new assignments, another one
the running integer sums of every entry. A round assigns all parts under the broadcast codebooks (no shuffle), then the parts
whose assignment changed give their components to the new entry (plus) and take them from the old one (minus); these
contributions are summed in each task and only the sums are shuffled: (entries * parts) rows a task at most. An
entry becomes floor(sum / count). The rounds end early once no entry moves, as nothing could change after that.

Driver and tasks hold the codebooks (entries x vector length) and nothing that grows with the rows.

Defined results: a null vector and one with a null or non-finite component are left out; repeated rows count each; the first entries
are the vectors of the smallest vec_ids (null last, ties by vector), fewer if there are fewer; shorter vectors and lengths that don't divide by
the parts are filled up with zeros; components saturate where a squared distance could leave 64 bits (beyond 23170 at
64 components); null labels are one label; a sum beyond 64 bits is null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import discard, materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096


def scaled(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the vectors that take part, x as integers of one length; and that length."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.filter(x.isNotNull() & F.coalesce(finite, F.lit(False))).select("vec_id", "label", "embedding")
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"] or 0
    length = -(-longest // parts) * parts
    most = math.isqrt((1 << 61) // max(1, length)) // 2
    # floor(4096 * x), held between -most and most
    whole = F.transform(x, lambda v: F.floor(F.greatest(F.least(v.cast("double") * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("long"))
    filled = F.concat(whole, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(x)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", filled.alias("x")), length


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and squared distances of integer vectors under ``book`` (parts, entries, part length); ties to the lower index."""
    parts, _, width = book.shape
    split = np.ascontiguousarray(x.reshape(len(x), parts, width).transpose(1, 0, 2))
    largest = max(np.abs(split).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if 4 * float(largest) ** 2 * max(1, width) < 2**53 else np.int64  # either is exact
    own, entries = split.astype(kind), book.astype(kind)
    apart = (entries**2).sum(2)[:, None, :] - 2 * np.matmul(own, entries.transpose(0, 2, 1))
    code = apart.argmin(2)
    best = np.take_along_axis(apart, code[:, :, None], 2)[:, :, 0] + (own**2).sum(2)
    return code.T, best.astype(np.int64).T


def _vectors(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten()).reshape(-1, length)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), kind))


def _assigned(state: DataFrame, book: np.ndarray) -> DataFrame:
    """``state`` with the codes it had as ``prev`` and the codes under ``book`` as ``code``."""
    length = book.shape[0] * book.shape[2]

    def assign(batches):
        for batch in batches:
            code, _ = nearest(_vectors(batch, length), book)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "label", "x")), batch.column("code"), _lists(code, pa.int32())], ["vec_id", "label", "x", "prev", "code"]
            )

    codes = ArrayType(IntegerType())
    fields = [*(state.schema[c] for c in ("vec_id", "label", "x")), StructField("prev", codes), StructField("code", codes)]
    return state.select("vec_id", "label", "x", "code").mapInArrow(assign, StructType(fields))


def _moves(state: DataFrame, parts: int, width: int) -> DataFrame:
    """Sums of the plus and minus contributions of the parts whose assignment changed: (part, entry, n, s0, s1, ...)."""
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    at = F.col("part")
    cut = (
        state.select("x", "prev", "code", part.alias("part"))
        .select("part", F.slice("x", at * width + 1, F.lit(width)).alias("v"), F.get("prev", at).alias("old"), F.get("code", at).alias("new"))
        .filter(~F.col("old").eqNullSafe(F.col("new")))
    )
    signed = F.explode(F.array(F.struct(F.col("new").alias("entry"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("entry"), F.lit(-1).alias("sign"))))
    moved = cut.select("part", "v", signed.alias("m")).filter("m.entry IS NOT NULL")
    sums = [F.sum(F.col("m.sign") * F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]
    return moved.groupBy("part", F.col("m.entry").alias("entry")).agg(F.sum("m.sign").alias("n"), *sums)


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Codebooks (parts, entries, part length) after the rounds, and the table (vec_id, label, x) they were learned from."""
    rows, length = scaled(vectors, parts)
    width = length // parts
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, width)
    book = np.ascontiguousarray(start.transpose(1, 0, 2))
    state, sums, written = rows.withColumn("code", F.lit(None).cast("array<int>")), None, False
    for _ in range(rounds if len(first) else 0):
        before, state = state, materialize(_assigned(state, book), "codes")
        if written:
            discard(before)
        written = True
        moves = _moves(state, parts, width)
        if sums is not None:
            both = sums.unionByName(moves).groupBy("part", "entry")
            moves = both.agg(*(F.sum(c).alias(c) for c in moves.columns[2:]))
        sums = materialize(moves, "sums")
        after = book.copy()
        for r in sums.collect():  # parts x entries rows at most
            if r["n"]:
                after[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        still = (after == book).all()
        book = after
        if still:
            break
    return book, state


def encode(rows: DataFrame, book: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every row of :func:`train_codebooks`' table; code is an array of indexes in part order."""
    length = book.shape[0] * book.shape[2]

    def finish(batches):
        for batch in batches:
            code, error = nearest(_vectors(batch, length), book)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _lists(code, pa.int32()), pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    kind = StructType([rows.schema["vec_id"], rows.schema["label"], StructField("code", ArrayType(IntegerType())), StructField("error", LongType())])
    if not book.shape[1]:
        return rows.sparkSession.createDataFrame([], kind)
    return rows.select("vec_id", "label", "x").mapInArrow(finish, kind)


def digest(book: np.ndarray) -> str:
    """Hex SHA-256 of all entries' decimal components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress_embeddings(vectors: DataFrame) -> DataFrame:
    """Codes of all vectors with their own error and their label's."""
    book, rows = train_codebooks(vectors)
    coded = materialize(encode(rows, book), "coded")
    # a label may hold a third of all rows: it is summed in parts, and the join may split its rows
    by_label = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)").alias("label_error"))
    joined = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    hexes = F.array_join(F.transform("c.code", lambda i: F.lpad(F.lower(F.hex(i)), 2, "0")), "")
    return joined.select("c.vec_id", hexes.alias("code"), "c.error", "l.label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def oracle() -> str:
    """DuckDB SQL for :func:`compress_embeddings`: every round sums all parts anew."""
    out = [f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, list_transform(embedding, lambda v: floor({SCALE} * v::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = len(embedding)),
size AS MATERIALIZED (SELECT ((max(len(x)) + {PARTS - 1}) // {PARTS})::BIGINT AS w FROM kept),
filled AS MATERIALIZED (SELECT id, list_resize(x, {PARTS} * w, 0) AS x, w FROM kept, size),
parts AS MATERIALIZED (SELECT id, p, x[p * w + 1 : p * w + w] AS v FROM filled, range({PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, id - 1 AS e, v AS c FROM parts WHERE id <= {ENTRIES})"""]
    for r in range(ROUNDS + 1):
        out.append(f"""
near{r} AS MATERIALIZED (
  SELECT id, p, any_value(v) AS v, min((d, e)) AS best FROM (
    SELECT id, a.p, v, e, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM parts a JOIN book{r} b ON a.p = b.p)
  GROUP BY id, p)""")
        if r < ROUNDS:
            out.append(f"""
sums{r} AS (
  SELECT p, e, i, (s - ((s % n) + n) % n) // n AS m FROM (
    SELECT p, best[2] AS e, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM near{r}, size, generate_series(1, w) g(i) GROUP BY ALL)),
book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM sums{r} GROUP BY p, e) n ON b.p = n.p AND b.e = n.e)""")
    return ",".join(out) + f""",
coded AS MATERIALIZED (SELECT id, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{ROUNDS} GROUP BY id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) FROM (SELECT p, e, array_to_string(c, ',') AS t FROM book{ROUNDS})) AS codebooks_sha256
FROM coded JOIN kept USING (id)
"""
