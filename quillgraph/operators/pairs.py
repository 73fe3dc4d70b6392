"""Pairs of members of a group: co-occurrence, interval overlap, and merging pairs to edges."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scoring import strength


def co_occurrence(df: DataFrame, key: Sequence[str], member: str, carry: Sequence[str] = ()) -> DataFrame:
    """All pairs a < b of distinct members of each key, with ``carry`` of both sides as ``<name>_a`` and ``<name>_b``.

    One equi-join on the key: both sides share a partitioning, and adaptive execution splits a skewed key.
    """
    one = df.select(*key, F.col(member).alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    two = df.select(*key, F.col(member).alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return one.join(two, list(key)).filter("a < b")


#: Rows (key, member) of a block of members, pairs that a task counts at a time, blocks at least, and keys of a member whose pairs are keys too.
BLOCK_ROWS, PAIRS_AT_ONCE, LEAST_BLOCKS, FEW_KEYS = 1 << 19, 1 << 22, 8, 48
#: Pairs of keys that are looked up by their number.
KEY_PAIRS = 1 << 26


def pair_counts(df: DataFrame, key: str, member: str, least: int = 1, block_rows: int = BLOCK_ROWS, asked: Column | None = None, best: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, n) of all pairs a < b of members (long) that share at least ``least`` distinct keys: the pairs of :func:`co_occurrence`, counted.

    With ``asked``, a condition on a member's rows, only pairs with such a member. With ``best``, (k, cap), only pairs that may be among the k best of
    either member, by n up to cap and then the smaller other; n is cap at most then. The single pairs are never shuffled. Members are dealt over
    blocks; a block is packed into a few bytes a row, and goes so to each two blocks that it is one of. A task counts the pairs between two blocks whole, some
    members at a time, and hands them on as it goes; so it holds the rows of two blocks and some millions of pairs. Where pairs need two keys
    or more, members of few keys meet under each two of their keys: pairs that share a single key are never made.
    """
    rows = df.select(F.col(key).alias("k"), F.col(member).cast("long").alias("m"), (F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))).alias("asked")).dropna()
    blocks = max(LEAST_BLOCKS, math.ceil(rows.count() / block_rows))
    number = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(table: pa.Table) -> pa.Table:
        own = table.column("own")[0].as_py()
        flat = table.select(["m", "k", "asked"]).group_by(["m", "k"]).aggregate([("asked", "max")]).sort_by("m")
        flat = flat.set_column(1, "k", flat.column("k").combine_chunks().dictionary_encode())
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, flat.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(flat)
        return pa.table({"own": pa.array([own], pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    own = F.pmod(F.xxhash64("m"), F.lit(blocks)).cast("int")
    packed = rows.withColumn("own", own).groupBy("own").applyInArrow(pack, "own int, data binary")
    every = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = every.select(F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("left"), "data")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = {left.as_py(): data for b in batches for left, data in zip(b.column("left"), b.column("data"), strict=True)}
        held = [pa.ipc.open_stream(sides[left].as_buffer()).read_all() for left in (True, False) if left in sides]
        keys = pa.chunked_array([c for t in held for c in t.column("k").chunks]).unify_dictionaries()
        codes = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in keys.chunks]).astype(np.int64)
        at = np.cumsum([0, *(len(t) for t in held)])
        blocks_of = [(codes[at[i] : at[i + 1]], t.column("m").to_numpy(), t.column("asked_max").to_numpy(zero_copy_only=False)) for i, t in enumerate(held)]
        for a, b, n in _counted(blocks_of[0], blocks_of[1] if len(held) > 1 else None, least, best):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    # however few bytes their blocks have, cells are dealt over so many partitions that they are even
    return cells.repartition(max(number, min(8 * number, blocks * (blocks + 1))), "lo", "hi").groupBy("lo", "hi").applyInArrow(count, "a long, b long, n long")


Rows = tuple[np.ndarray, np.ndarray]


def _counted(left: tuple, right: tuple | None, least: int, best: tuple[int, int] | None) -> Iterator[list[np.ndarray]]:
    """(a, b, n) of the pairs of two blocks (keys, members, asked), or of one block with itself, some at a time."""
    parts = []  # (left rows, right rows, whether the two are one, whether pairs of keys may stand for keys)
    mine = _parted(*left)
    if right is None:
        whole = list(mine.items())
        for i, ((asked, few), own) in enumerate(whole):
            for (asks, less), other in whole[i:]:
                if asked or asks:
                    parts.append((own, other, own is other, few and less))
    else:
        for (asked, few), own in mine.items():
            for (asks, less), other in _parted(*right).items():
                if asked or asks:
                    parts.append((own, other, False, few and less))
    for own, other, same, few in parts:
        if len(own[0]) and len(other[0]):
            yield from _met(own, other, same, least, few and least > 1, best)


def _parted(keys: np.ndarray, members: np.ndarray, asked: np.ndarray) -> dict[tuple[bool, bool], Rows]:
    """Rows by whether their member is asked for and has few keys; rows are sorted by member."""
    begins = np.flatnonzero(np.concatenate([[True], members[1:] != members[:-1]])) if len(members) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(members)))
    wanted = np.repeat(np.logical_or.reduceat(asked, begins), sizes) if len(begins) else asked
    few = np.repeat(sizes <= FEW_KEYS, sizes)
    return {(a, f): (keys[take], members[take]) for a in (True, False) for f in (True, False) if (take := (wanted == a) & (few == f)).any()}


def _two_keys(keys: np.ndarray, at: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair of keys, member) of rows that are sorted by member."""
    begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.append(begins, len(at)))
    pairs, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(sizes[sizes > 1]):
        first = begins[sizes == size]
        own = np.sort(keys[first[:, None] + np.arange(size)], axis=1)
        i, j = np.triu_indices(size, 1)
        pairs.append((own[:, i] * number + own[:, j]).ravel())
        owners.append(np.repeat(at[first], len(i)))
    return np.concatenate(pairs), np.concatenate(owners)


def _met(left: Rows, right: Rows, same: bool, least: int, few: bool, best: tuple[int, int] | None) -> Iterator[list[np.ndarray]]:
    """(a, b, n) of the pairs between two sets of rows (keys, members), each sorted by member."""
    (own, members), (others_keys, others) = left, right
    names, at = np.unique(members, return_inverse=True)
    ends, place = np.unique(others, return_inverse=True)
    number = int(max(own.max(), others_keys.max())) + 1
    shared = lambda x, y: int(np.bincount(x, minlength=number) @ np.bincount(y, minlength=number))
    twice = lambda x: int((np.bincount(x).astype(np.int64) ** 2).sum()) // 2
    two = few and number * number * len(ends) < 1 << 62 and twice(at) + twice(place) < shared(own, others_keys)
    if two:
        (own, at), (others_keys, place) = _two_keys(own, at, number), _two_keys(others_keys, place, number)
    by_key = np.sort(others_keys * len(ends) + place)
    sorted_keys, place = by_key // len(ends), by_key % len(ends)
    by_member = np.argsort(at, kind="stable")
    at, own = at[by_member], own[by_member]
    codes = number * number if two else number
    if codes <= KEY_PAIRS:
        start = np.concatenate([[0], np.cumsum(np.bincount(sorted_keys, minlength=codes))])
        first, sizes = start[own], start[own + 1] - start[own]
    else:
        first = np.searchsorted(sorted_keys, own, "left")
        sizes = np.searchsorted(sorted_keys, own, "right") - first
    met = sizes > 0
    at, first, sizes = at[met], first[met], sizes[met]
    stops = np.append(np.flatnonzero(at[1:] != at[:-1]) + 1, len(at)) if len(at) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    start = 0
    while start < len(at):
        # whole members, so that a pair's keys are counted at once
        i = max(np.searchsorted(total[stops], total[start] + PAIRS_AT_ONCE, "right") - 1, np.searchsorted(stops, start, "right"))
        stop = stops[i]
        n = sizes[start:stop]
        run = np.arange(total[stop] - total[start]) + np.repeat(first[start:stop] - (total[start:stop] - total[start]), n)
        pairs = np.sort(np.repeat(at[start:stop] * len(ends), n) + place[run])
        edge = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        times = np.diff(np.append(edge, len(pairs)))
        if two:  # n keys make n (n - 1) / 2 pairs of keys
            times = np.rint((1 + np.sqrt(1 + 8.0 * times)) / 2).astype(np.int64)
        pairs, times = pairs[edge][times >= least], times[times >= least]
        i, j = pairs // len(ends), pairs % len(ends)
        if same:
            i, j, times = i[i < j], j[i < j], times[i < j]
        if best is not None:
            i, j, times = _best(i, j, times, same, *best)
        a, b = names[i], ends[j]
        yield [np.minimum(a, b), np.maximum(a, b), times]
        start = stop


def _best(i: np.ndarray, j: np.ndarray, times: np.ndarray, same: bool, k: int, cap: int) -> list[np.ndarray]:
    """The pairs (places of the members, times up to ``cap``) that are among the k best of one of their members."""
    size = int(max(i.max(), j.max())) + 1 if len(i) else 1
    less = cap - np.minimum(times, cap)
    kept = []
    for sides in ([(i, j, less), (j, i, less)], ) if same else ([(i, j, less)], [(j, i, less)]):
        own, other, behind = (np.concatenate(x) for x in zip(*sides, strict=True))
        rows = np.sort((own * (cap + 1) + behind) * size + other)
        own, behind, other = rows // size // (cap + 1), rows // size % (cap + 1), rows % size
        new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
        rank = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
        own, behind, other = own[rank < k], behind[rank < k], other[rank < k]
        x, y = (np.minimum(own, other), np.maximum(own, other)) if same else (own, other) if not kept else (other, own)
        kept.append((x * size + y) * (cap + 1) + behind)
    rows = np.unique(np.concatenate(kept))
    return [rows // (cap + 1) // size, rows // (cap + 1) % size, cap - rows % (cap + 1)]


def interval_overlap_pairs(
    df: DataFrame, key: Sequence[str], member: str, start: str, end: Column, as_of_year: int, carry: Sequence[str] = (), least: int = 1
) -> DataFrame:
    """Pairs of one key whose intervals overlap by at least ``least`` years; an open end is ``as_of_year``."""
    closed = df.withColumns({"_s": F.col(start), "_e": F.coalesce(end, F.lit(as_of_year))})
    pairs = co_occurrence(closed, key, member, [*carry, "_s", "_e"])
    overlap = F.least("_e_a", "_e_b") - F.greatest("_s_a", "_s_b")
    return pairs.withColumn("overlap_years", overlap).filter(F.col("overlap_years") >= least).drop("_s_a", "_s_b", "_e_a", "_e_b")


def overlap_type(team_a: Column, team_b: Column, domain_a: Column, domain_b: Column, gap: Column) -> Column:
    """Team beats domain (with a known gap below 10) beats general."""
    return (
        F.when(team_a.isNotNull() & (team_a == team_b), "career_overlap_same_team")
        .when(domain_a.isNotNull() & (domain_a == domain_b) & gap.isNotNull() & (gap < 10), "career_overlap_same_domain")
        .otherwise("career_overlap_general")
    )


def merge_edges(pairs: DataFrame, kind: Column, evidence: str, year: str, base: Column, decay: Column, as_of_year: int) -> DataFrame:
    """Edges (a, b, type): distinct evidence counts as corroboration, the last year decays the strength."""
    grouped = pairs.withColumn("type", kind).groupBy("a", "b", "type").agg(
        F.count_distinct(evidence).alias("corroborations"), F.max(year).alias("last_active_year")
    )
    years = F.greatest(F.lit(0), F.lit(as_of_year) - F.col("last_active_year"))
    return grouped.withColumn("strength", strength(base, decay, years, F.col("corroborations"), F.lit(1)))


def blocked_join(left: DataFrame, right: DataFrame, key: Sequence[str], block: int = 1024) -> DataFrame:
    """All rows of the equi-join of ``left`` and ``right`` on ``key``, spread by blocks: a hot key is many join keys of about block^2 rows.

    The rows that a key has on a side are dealt by a hash of the whole row over ceil(n / block) blocks, and each block meets each block of the other side.
    The blocks are dealt over all of the session's shuffle partitions, however few bytes they have: the work is in their pairs.
    """
    n = [side.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias(name)) for side, name in ((left, "_l"), (right, "_r"))]
    blocks = n[0].join(n[1], list(key))
    dealt = lambda side, own: F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    one = left.join(blocks, list(key)).select(*left.columns, dealt(left, "_l").alias("_i"), every("_r").alias("_j"))
    two = right.join(blocks, list(key)).select(*right.columns, every("_l").alias("_i"), dealt(right, "_r").alias("_j"))
    # a column of its own deals the cells: Spark drops constant keys from a join and would deal the rows once more, by few bytes
    cell = [*key, "_i", "_j", "_cell"]
    number = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (side.withColumn("_cell", F.xxhash64(*cell[:-1])).repartition(number, "_cell") for side in (one, two))
    return one.join(two.hint("shuffle_hash"), cell).drop("_i", "_j", "_cell")


def shared_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, shared): how many groups the two of each distinct pair (a < b) share, pairs without any left out.

    ``members`` is (company_id, person_id). Members meet within a group and are counted beside the asked pairs, so rows have a fixed
    size: no list of a member's groups travels with each of its pairs.
    """
    met = co_occurrence(members.distinct(), ["company_id"], "person_id").select("a", "b", F.lit(1).alias("n"), F.lit(False).alias("asked"))
    both = pairs.select("a", "b", F.lit(0).alias("n"), F.lit(True).alias("asked")).unionByName(met)
    counted = both.groupBy("a", "b").agg(F.sum("n").cast("int").alias("shared"), F.bool_or("asked").alias("asked"))
    return counted.filter("asked AND shared > 0").select("a", "b", "shared")


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b, ...) seen from each end: (node, partner, ...)."""
    rest = [c for c in edges.columns if c not in ("a", "b")]
    # one pass over the edges, which may be long to compute
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("partner")) for x, y in (("a", "b"), ("b", "a"))))
    return edges.select(F.explode(ends).alias("_e"), *rest).select("_e.node", "_e.partner", *rest)
