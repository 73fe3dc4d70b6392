"""Feistel sharding: a seeded permutation of global row numbers picks shard and slot.

Row ``i`` of ``n`` (in doc_id order) is split into a pair (x, y) of Z_a x Z_b with
a = ceil(sqrt(n)) and b = ceil(n / a). Six Feistel rounds permute the pairs; where the
result is not below ``n``, the permutation is applied again (cycle walking) until it is.
At most a*b - n pairs lie outside, and a walk visits each at most once, so a walk of that
length always ends inside. Position ``p`` goes to shard ``p mod shards``, slot ``p div shards``;
both can be computed again from ``i`` alone.

Defined results: null text counts as empty (size 1, crc32 0); null doc_id sorts first;
repeated rows each get a place of their own; an empty table gives no rows; columns other
than doc_id and text play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_row_numbers

ROUNDS = 6
PRIME = 2147483647


def round_keys(seed: int) -> list[int]:
    """Six round keys from a seed by a multiplicative generator."""
    keys, state = [], seed % (PRIME - 1) + 1
    for _ in range(ROUNDS):
        state = state * 16807 % PRIME
        keys.append(state)
    return keys


def domain(n: int) -> tuple[int, int]:
    """The sides (a, b) of the smallest near-square that holds n positions."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def mix_sql(value: str, key: int) -> str:
    """Integer round function; the text is valid in Spark SQL and DuckDB (``DIV`` is replaced)."""
    t = f"((({value}) + {key}) * 48271 % {PRIME})"
    return f"((({t}) + DIV({t}, 65536)) * 69621 % {PRIME})"


def _mix(value: Column, key: int) -> Column:
    t = (value + F.lit(key).cast("long")) * 48271 % PRIME
    return (t + F.shiftright(t, 16)) * 69621 % PRIME


def _round(r: int, a: int, b: int, key: int):
    if r % 2 == 0:
        return lambda s: F.struct(((s.x + _mix(s.y, key)) % a).alias("x"), s.y.alias("y"))
    return lambda s: F.struct(s.x.alias("x"), ((s.y + _mix(s.x, key)) % b).alias("y"))


def permute_once(i: Column, a: int, b: int, keys: list[int]) -> Column:
    """One pass of the Feistel network over Z_a x Z_b."""
    state = F.struct(F.floor(i / b).cast("long").alias("x"), (i % b).cast("long").alias("y"))
    for r, key in enumerate(keys):
        # transform over a one-element array binds the pair, so that no round repeats the earlier ones
        state = F.transform(F.array(state), _round(r, a, b, key))[0]
    return F.transform(F.array(state), lambda s: s.x * b + s.y)[0]


def permute(i: Column, n: int, seed: int) -> Column:
    """Position of row ``i`` under the seeded permutation of 0..n-1."""
    a, b = domain(n)
    keys = round_keys(seed)
    spare = a * b - n
    once = permute_once(i, a, b, keys)
    if not spare:
        return once
    walk = lambda v: F.aggregate(
        F.sequence(F.lit(1), F.lit(spare)), v, lambda s, _: F.when(s < n, s).otherwise(permute_once(s, a, b, keys))
    )
    return F.transform(F.array(once), lambda v: F.when(v < n, v).otherwise(walk(v)))[0]


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 20240229) -> DataFrame:
    """Give every document a shard and a gapless slot; row counts differ by at most one.

    Only the id, size and checksum of a text are shuffled, never the text.
    """
    rows = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).cast("long").alias("text_crc32"),
    )
    numbered, n = global_row_numbers(rows, [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    placed = numbered.withColumn("position", permute(F.col("rn"), max(n, 1), seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def oracle(shards: int = 8, seed: int = 20240229) -> str:
    """DuckDB SQL for :func:`shard_rows`, crc32 included."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    x, y = "i // b", "i % b"
    steps = []
    for r, key in enumerate(round_keys(seed)):
        mixed = mix_sql("y" if r % 2 == 0 else "x", key).replace("DIV(", "divide(")
        steps.append((f"(x + {mixed}) % a", "y") if r % 2 == 0 else ("x", f"(y + {mixed}) % b"))
    inner = f"SELECT doc_id, size, text_crc32, i0, n, a, b, {x} AS x, {y} AS y FROM {{src}}"
    for sx, sy in steps:
        inner = f"SELECT doc_id, size, text_crc32, i0, n, a, b, {sx} AS x, {sy} AS y FROM ({inner})"
    once = f"SELECT doc_id, size, text_crc32, i0, n, a, b, x * b + y AS i FROM ({inner})"
    return f"""
WITH RECURSIVE crc_table AS (SELECT {table}::BIGINT[] AS t),
sized AS (
  SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size,
    coalesce(xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8)), 4294967295::BIGINT), 0)::BIGINT AS text_crc32
  FROM documents, crc_table),
counted AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS i0, count(*) OVER () AS n FROM sized),
squared AS (
  SELECT *, CASE WHEN n <= 1 THEN 1 ELSE floor(sqrt(n - 1))::BIGINT + 1 END AS a FROM counted),
boxed AS (SELECT *, (n + a - 1) // a AS b, i0 AS i FROM squared),
walked AS (
  {once.format(src="boxed")}
  UNION ALL
  {once.format(src="(SELECT * FROM walked WHERE i >= n)")}
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (i % {shards})::INTEGER AS shard, i // {shards} AS slot, NULL::INTEGER AS grown_shard
FROM walked WHERE i < n
"""
