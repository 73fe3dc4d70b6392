"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its distinct lower-case words, stripped of outer punctuation, and their
first 4, 5 and 6 letters (inflected and joined forms share those), hashed to ``2**BITS`` slots. The machine
scores sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the slots present, so
that pairs, such as an insult with a group mention, count beyond their single weights.
Words without a bearing on the label have no weight, so a long text isn't
pulled either way by its length.

Fitting takes a bounded sample of labelled rows: at most about ``SAMPLE`` of each label, drawn evenly by
a hash of the row; the ``TERMS`` slots whose presence tells most about the label, alone or among the rows that hold another
telling or frequent slot, get weights. The bias is shifted by the two sampling shares, so a
score is a chance at the labels' own rate at any size. Scoring reads every whole text and shuffles nothing.

Defined results: a text that is null, empty or has no weighted term scores the sigmoid of the bias; with no row to
learn from the score is 0; null labels and ids are left out of a fit, a label that repeats counts once, and of several texts with one labelled
id one is learned from;
repeated rows are each answered; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .op01_language import bucket

BITS = 20
#: Labelled rows to learn from, of each label.
SAMPLE = 3000
#: Slots that get weights, and the fewest sampled rows that must hold one.
TERMS, LEAST_ROWS = 2048, 3
#: For slots that tell only together: most frequent slots tried as partners beside the telling ones, fewest rows that hold both, standard errors.
PARTNERS, PAIR_ROWS, PAIR_SPREAD = 64, 8, 5
FACTORS, EPOCHS, BATCH, RATE, DECAY = 8, 12, 128, 0.05, 1e-4
THRESHOLD = 0.7
TABLE_LIMIT = 200_000
PREFIXES = (4, 5, 6)


def slots(piece: bytes) -> list[int]:
    """Slots of the terms of a lower-case piece between white space."""
    word = piece.decode("utf-8", "replace")
    while word and not word[0].isalnum():
        word = word[1:]
    while word and not word[-1].isalnum():
        word = word[:-1]
    if not word:
        return []
    terms = [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh32_intdigest(t.encode()) & ((1 << BITS) - 1) for t in terms]


def distinct_pieces(text: str | None) -> set[bytes]:
    """Distinct lower-case pieces between ASCII white space."""
    return set((text or "").lower().encode("utf-8", "replace").split())


def _told_together(flat: np.ndarray, owner: np.ndarray, seen: np.ndarray, y: np.ndarray, telling: np.ndarray):
    """(slot, standard errors) of pairs of slots, one telling or frequent, whose rows differ in label from the rows of that one."""
    kept = seen[flat] >= PAIR_ROWS
    ids, place = np.unique(flat[kept], return_inverse=True)
    own = owner[kept]
    if not len(ids):
        return
    sizes = np.bincount(own, minlength=len(y))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    by_slot = np.argsort(place, kind="stable")
    first = np.concatenate([[0], np.cumsum(seen[ids])])
    frequent = ids[np.argsort(-seen[ids], kind="stable")[:PARTNERS]]
    for slot in np.union1d(np.intersect1d(telling, ids), frequent):
        k = int(np.searchsorted(ids, slot))
        rows = own[by_slot[first[k] : first[k + 1]]]
        base, n = y[rows].mean(), sizes[rows]
        if not 0 < base < 1:
            continue
        at = np.repeat(starts[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(place[at], minlength=len(ids))
        with_1 = np.bincount(place[at], weights=np.repeat(y[rows], n), minlength=len(ids))
        spread = np.sqrt(np.maximum(both * base * (1 - base), 1e-9))
        told = np.where((both >= PAIR_ROWS) & (both < len(rows)), np.abs(with_1 - both * base) / spread, 0)
        found = np.flatnonzero(told > PAIR_SPREAD)
        yield from zip(ids[found].tolist(), told[found].tolist(), strict=True)
        if len(found):
            yield int(slot), float(told[found].max())


class FactorizationMachine:
    """Weights w0, w and factors V over chosen slots."""

    def __init__(self, rows: list[np.ndarray], labels: list[int], seed: int = 7, shares: tuple[float, float] = (1.0, 1.0)):
        """Fit on rows of distinct slots with labels 0 or 1; ``shares`` of the rows of either label were sampled."""
        self.place = np.full(1 << BITS, -1, np.int16)
        self.bias, self.weights = 0.0, np.zeros(0)
        self.factors = np.zeros((0, FACTORS))
        self.fitted = bool(rows)
        if not rows:
            return
        y = np.array(labels, np.float64)
        flat = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        seen = np.bincount(flat, minlength=1 << BITS)
        with_1 = np.bincount(flat, weights=y[owner], minlength=1 << BITS)
        base = y.mean()
        # how far the label's share among the rows with a slot lies from its share at large, in standard errors
        spread = np.sqrt(np.maximum(seen * base * (1 - base), 1e-9))
        told = np.where(seen >= LEAST_ROWS, np.abs(with_1 - seen * base) / spread, 0)
        telling = np.flatnonzero(told > 4)
        told = np.where(told > 4, told, 0)
        for slot, spread_out in _told_together(flat, owner, seen, y, telling):
            told[slot] = max(told[slot], spread_out)
        chosen = np.argsort(-told, kind="stable")[:TERMS]
        chosen = np.sort(chosen[told[chosen] > 0])
        self.place[chosen] = np.arange(len(chosen), dtype=np.int16)
        x = np.zeros((len(rows), len(chosen)), np.float32)
        at = self.place[flat]
        x[owner[at >= 0], at[at >= 0]] = 1
        self._train(x, y, np.random.default_rng(seed))
        self.bias -= float(np.log(shares[1] / shares[0]))  # sampled odds are the true odds times the ratio of the shares

    def _train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        n, m = x.shape
        w, v = np.zeros(m), rng.normal(0, 0.02, (m, FACTORS))
        bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if n else 0.0
        gw, gv, gb = np.full(m, 1e-6), np.full((m, FACTORS), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for i in range(0, n, BATCH):
                part = order[i : i + BATCH]
                xs = x[part].astype(np.float64)
                sums = xs @ v
                raw = bias + xs @ w + 0.5 * (sums**2 - xs @ v**2).sum(1)
                slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                dw = xs.T @ slope + DECAY * w
                dv = xs.T @ (slope[:, None] * sums) - (xs.T @ slope)[:, None] * v + DECAY * v
                db = slope.sum()
                gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
                w, v, bias = w - RATE * dw / np.sqrt(gw), v - RATE * dv / np.sqrt(gv), bias - RATE * db / np.sqrt(gb)
        self.bias, self.weights, self.factors = float(bias), w, v

    def score(self, present: np.ndarray) -> float:
        """Score of a text with these weighted places (any order, repeats allowed)."""
        if not self.fitted:
            return 0.0
        at = np.unique(present)
        v = self.factors[at]
        raw = self.bias + self.weights[at].sum() + 0.5 * (v.sum(0) ** 2 - (v**2).sum(0)).sum()
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


class PlaceTable(dict):
    """Bounded table from a piece to the places of its weighted terms."""

    def __init__(self, machine: FactorizationMachine):
        super().__init__()
        self.machine = machine

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= TABLE_LIMIT:
            self.clear()
        at = self.machine.place[slots(piece)] if self.machine.fitted else np.zeros(0, np.int16)
        value = at[at >= 0].tobytes()
        if len(piece) <= 64:
            self[piece] = value
        return value


def fit(labelled: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Fit on a bounded sample of (doc_id, toxic) rows and their texts.

    The driver gets one count for each label and the slots of the sampled texts. The sampled ids,
    some ``2 * sample`` at any size of the corpus, are broadcast.
    """
    labelled = labelled.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    counts = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    shares = tuple(min(1.0, sample / counts.get(k, 1)) for k in (0, 1))
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    unit = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.filter(unit < share)

    def featurise(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                found = {s for p in distinct_pieces(text) for s in slots(p)}
                rows.append(np.array(sorted(found), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.binary())], names=["doc_id", "toxic", "slots"])

    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")
    found = texts.mapInArrow(featurise, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int, slots binary")
    rows, labels = [], []
    for r in found.groupBy("doc_id", "toxic").agg(F.min("slots").alias("slots")).collect():
        rows.append(np.frombuffer(bytes(r["slots"]), np.int32))
        labels.append(r["toxic"])
    return FactorizationMachine(rows, labels, shares=shares)


def score_texts(docs: DataFrame, machine: FactorizationMachine) -> DataFrame:
    """doc_id and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        own = shared.value
        look = PlaceTable(own).__getitem__
        for batch in batches:
            scores = []
            for text in batch.column("text").to_pylist():
                found = b"".join(map(look, distinct_pieces(text)))
                scores.append(own.score(np.frombuffer(found, np.int16)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return small_batches(docs).select("doc_id", "text").mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double"
    )


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document with a machine fitted on the labels not held out."""
    machine = fit(labels.filter(bucket(F.col("doc_id"), 3) != 1), docs)
    return score_texts(docs, machine).select(
        "doc_id",
        (bucket(F.col("doc_id"), 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
