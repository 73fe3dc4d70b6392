"""Language identification by prediction by partial matching (PPM).

Every language gets a context tree over lower-case UTF-8 bytes: for each context of 0 to
``ORDER`` bytes, how often each byte followed. After training the counts are frozen. A byte
costs -log2(c / (n + q)) bits in the longest context that has seen it, where n counts the
context's bytes and q its distinct ones; each longer context that was seen, but not with
that byte, costs its escape, -log2(q / (n + q)); a byte unseen anywhere costs 8 bits more.
A text's code length under a language is the exact sum over its bytes; the
language with the shortest wins, ties to the smaller name.

For speed the trees of all languages are compiled into one table for each order: a row holds
the costs of one byte string under every language, escapes included.

The model is fitted on a bounded sample: about ``SAMPLE`` whole texts of each language, drawn
evenly by a hash of the row from all that may be learned from; a text that repeats under one id counts
once. Scoring reads every whole text and shuffles nothing.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no learnable row every text is
``und``; repeated rows are each answered; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, trim

ORDER = 4
#: Texts of each language to learn from.
SAMPLE = 300
UNKNOWN = "und"
CHUNK = 1 << 18
START = b"\n" * ORDER


def bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % modulus, F.lit(0)).cast("int")


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The byte strings of ``order`` + 1 bytes that end at each byte after the first ``ORDER``."""
    key = np.zeros(len(data) - ORDER, np.int64)
    for back in range(order, -1, -1):
        key = key << 8 | data[ORDER - back : len(data) - back]
    return key


class GramTable:
    """Open-addressed table of byte strings; looks up whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rows = np.zeros(1 << self.bits, np.int32)
        self.probes, left, slot = 1, np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            own = left[free][first]
            self.keys[at], self.rows[at] = keys[own], own
            stay = np.ones(len(left), bool)
            stay[np.flatnonzero(free)[first]] = False
            left, slot = left[stay], (slot[stay] + 1) & (len(self.keys) - 1)
            self.probes += bool(len(left))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.keys) - 1)
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.rows[slot[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class PpmModel:
    """Frozen context trees of all languages, compiled to cost rows."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        self.orders: list[tuple[GramTable, np.ndarray]] = []
        self.escapes: list[tuple[GramTable, np.ndarray]] = []
        if not self.languages:
            return
        data = []
        for lang in self.languages:
            joined = START + START.join(t.lower().encode("utf-8", "replace") for t in texts[lang])
            data.append(np.frombuffer(joined, np.uint8).astype(np.int64))
        wide = len(self.languages)
        for order in range(ORDER + 1):
            per = [np.unique(_grams(d, order), return_counts=True) for d in data]
            keys = np.unique(np.concatenate([k for k, _ in per]))
            contexts = np.unique(keys >> 8)
            count = np.zeros((len(keys), wide))
            total, kinds = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
            for j, (k, c) in enumerate(per):
                count[np.searchsorted(keys, k), j] = c
                at = np.searchsorted(contexts, k >> 8)
                np.add.at(total[:, j], at, c)
                np.add.at(kinds[:, j], at, 1)
            escape = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
            own = np.searchsorted(contexts, keys >> 8)
            shorter = self._costs(keys & ((1 << 8 * order) - 1), order - 1) if order else np.full((len(keys), wide), 8.0)
            seen = -np.log2(np.maximum(count, 1) / (total + kinds + (total == 0))[own])
            costs = np.where(count > 0, seen, escape[own] + shorter)
            self.escapes.append((GramTable(contexts), np.vstack([escape, np.zeros(wide)]).astype(np.float32)))
            self.orders.append((GramTable(keys), costs.astype(np.float32)))

    def _costs(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Costs under every language of the last byte of each string of ``order`` + 1 bytes."""
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        table, costs = self.orders[order]
        row = table.find(keys)
        out = costs[row]
        lost = np.flatnonzero(row < 0)
        if len(lost):
            contexts, escape = self.escapes[order]
            short = keys[lost] & ((1 << 8 * order) - 1)
            out[lost] = escape[contexts.find(keys[lost] >> 8)] + self._costs(short, order - 1)
        return out

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under every language."""
        out = np.zeros((len(texts), len(self.languages)))
        held: list[bytes] = []
        owner: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            body = START + text.lower().encode("utf-8", "replace")
            for at in range(0, len(body) - ORDER, CHUNK):
                held.append(body[at : at + CHUNK + ORDER])
                owner.append(i)
                size += len(held[-1])
                if size >= CHUNK:
                    self._add(held, owner, out)
                    held, owner, size = [], [], 0
        if held:
            self._add(held, owner, out)
        return out

    def _add(self, held: list[bytes], owner: list[int], out: np.ndarray) -> None:
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
        costs = self._costs(_grams(data, ORDER), ORDER)
        ends = np.cumsum([len(h) for h in held]) - ORDER
        begins = np.array([0, *(ends[:-1] + ORDER)])
        # the last ORDER strings before the next text run across two texts: not counted
        bounds = np.stack([begins, ends], 1).ravel()
        if bounds[-1] >= len(costs):
            bounds = bounds[:-1]
        sums = np.add.reduceat(costs, bounds, axis=0, dtype=np.float64)[::2]
        np.add.at(out, owner, sums)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that the query may learn from: labelled, and not held out."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket(F.col("doc_id"), 4) != 2))


def fit(labelled: DataFrame) -> PpmModel:
    """Fit the trees on a bounded sample of (text, lang) rows.

    The driver gets one count for each language and the sample.
    """
    key = F.xxhash64("doc_id", "text")
    rows = labelled.select("lang", key.alias("key")).distinct()
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.select("text", "lang", share.alias("share"), unit.alias("unit"), key.alias("key")).filter("unit < share").dropDuplicates(["lang", "key"])
    texts: dict[str, list[str]] = {}
    for r in sorted(chosen.select("unit", "lang", "text").collect()):
        texts.setdefault(r["lang"], []).append(r["text"])
    return PpmModel(texts)


def predict(docs: DataFrame, model: PpmModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, lang_pred, score (posterior under equal priors) and bits_per_byte of every text."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        trim()
        own = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            named = [bool(own.languages) and t is not None and any(map(str.isalpha, t)) for t in texts]
            picked = [t for t, ok in zip(texts, named, strict=True) if ok]
            bits = own.code_lengths(picked)
            langs, scores, rates = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts)
            best = bits.argmin(1) if len(picked) else []
            where = [i for i, ok in enumerate(named) if ok]
            for k, (i, b) in enumerate(zip(where, best, strict=True)):
                langs[i] = own.languages[b]
                scores[i] = float(1 / np.exp2(np.clip(bits[k, b] - bits[k], -1000, 0)).sum())
                rates[i] = float(bits[k, b] / max(1, len(texts[i].encode("utf-8", "replace"))))
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())],
                names=[*keep, "lang_pred", "score", "bits_per_byte"],
            )

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    columns = keep if "text" in keep else [*keep, "text"]
    return small_batches(docs).select(*columns).mapInArrow(run, ", ".join([*fields, "lang_pred string, score double, bits_per_byte double"]))


def keep_identified(docs: DataFrame, limit_bits: float | None = None) -> DataFrame:
    """The documents in a learned language, with all their columns.

    Rejected are ``und`` (null, empty and letterless texts) and, if ``limit_bits`` is given, texts that cost more bits a byte under
    every language. Repeated rows are judged alike; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), "text")
    found = predict(rows, fit(learnable(docs)), ["row"]).filter(F.col("lang_pred") != UNKNOWN)
    return (found if limit_bits is None else found.filter(F.col("bits_per_byte") <= limit_bits)).select("row.*")


def identify_languages(docs: DataFrame) -> DataFrame:
    """Predict the language of every document with a model of those not held out."""
    model = fit(learnable(docs))
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", (bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
