"""Sum-of-squares online packing of documents into sequences of at most 4096 tokens.

Each task packs its own documents as they come, so nothing is shuffled. A level array counts the
open windows at each fill level. A document goes to the level that makes the sum of the
squared counts smallest (a new window counts as level 0; full windows leave the array).
Documents longer than a window are first cut into full windows and a rest.

When a task ends, the open windows are closed:
the emptiest are cut to fill the fullest, and the last one is cut into sequences of
power-of-two lengths, which need no padding. A task holds its open windows, which are at most the ids of its own split of
the input (166 windows were the most on 80,000 texts in one task); ``open_limit`` closes them
earlier where a caller asks for it, and is off otherwise, so that no placement depends on a limit.

Sequence numbers carry the task's partition above bit 33, so they are unique without a
count over all tasks, and a repeated task gives the same numbers.

Defined results: null text counts as empty and is packed as the single closing id; repeated rows
are each packed; an empty table gives no rows; very long texts are cut, never shortened.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import runs, small_batches, trim
from .op06_bpe import packed, table, vocabulary

WINDOW = 4096
CLOSING_ID = 2

SCHEMA = pa.schema(
    [
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)


class Packer:
    """Packs token runs of one task; ``emit(pieces)`` gets each closed sequence.

    A piece is (document, start, bytes of ids, tokens of the document).
    """

    def __init__(self, window: int = WINDOW, open_limit: int | None = None):
        self.window, self.open_limit = window, open_limit
        self.counts = np.zeros(window + 1, np.int64)
        self.at_level: list[list[list]] = [[] for _ in range(window + 1)]
        self.closed: list[list] = []
        self.n_open = 0

    def place(self, doc, ids: bytes) -> None:
        """Pack one document's ids (4 bytes each)."""
        n, window = len(ids) // 4, self.window
        cut = 0
        while n - cut >= window:
            self.closed.append([(doc, cut, ids[4 * cut : 4 * (cut + window)], n)])
            cut += window
        if cut < n:
            self._fit((doc, cut, ids[4 * cut :], n), n - cut)
            if self.open_limit is not None and self.n_open > self.open_limit:
                self.flush()

    def _fit(self, piece, size: int) -> None:
        counts, window = self.counts, self.window
        # change of the sum of squares when a window moves from level h to h + size
        change = 1 - 2 * counts[: window - size + 1]
        change[counts[: window - size + 1] == 0] = 1 << 60
        change[0] = 0
        gain = 2 * counts[size:] + 1
        gain[window - size] = 0
        change += gain
        level = int(change.argmin())
        if level:
            own = self.at_level[level].pop()
            counts[level] -= 1
            self.n_open -= 1
        else:
            own = []
        own.append(piece)
        if level + size == window:
            self.closed.append(own)
        else:
            self.at_level[level + size].append(own)
            counts[level + size] += 1
            self.n_open += 1

    def flush(self) -> None:
        """Close all open windows without padding."""
        runs = [(level, own) for level in range(self.window, 0, -1) for own in self.at_level[level]]
        self.at_level = [[] for _ in range(self.window + 1)]
        self.counts[:] = 0
        self.n_open = 0
        low, spare = len(runs) - 1, []
        high = 0
        while high <= low:
            level, own = runs[high]
            room = self.window - level
            while room and (spare or low > high):
                if not spare:
                    spare = runs[low][1][::-1]
                    low -= 1
                doc, start, ids, n = spare.pop()
                take = min(room, len(ids) // 4)
                own.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    spare.append((doc, start + take, ids[4 * take :], n))
                room -= take
            high += 1
            if room:
                self._powers(own)
            else:
                self.closed.append(own)
        if spare:
            self._powers(spare[::-1])

    def _powers(self, own: list) -> None:
        left = sum(len(p[2]) // 4 for p in own)
        rest = own[::-1]
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            out = []
            while want:
                doc, start, ids, n = rest.pop()
                take = min(want, len(ids) // 4)
                out.append((doc, start, ids[: 4 * take], n))
                if 4 * take < len(ids):
                    rest.append((doc, start + take, ids[4 * take :], n))
                want -= take
            self.closed.append(out)

    def take_closed(self) -> list[list]:
        """The sequences closed since the last call."""
        out, self.closed = self.closed, []
        return out


def pack_documents(docs: DataFrame, vocabulary_path: str, window: int = WINDOW, open_limit: int | None = None) -> DataFrame:
    """Pack all documents; one row for each piece. With ``open_limit`` a task closes all windows whenever it holds more open ones."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        trim(keep=True)
        known = table(content.value, packed)
        closing = CLOSING_ID.to_bytes(4, "little")
        packer = Packer(window, open_limit)
        number = TaskContext.get().partitionId() << 33
        id_type = None

        def rows():
            nonlocal number
            ids, columns = [], [[] for _ in SCHEMA]
            for sequence in packer.take_closed():
                offset = 0
                for doc, start, run, n in sequence:
                    size = len(run) // 4
                    ids.append(doc)
                    for column, value in zip(columns, (start, size, zlib.crc32(run), n, number, offset), strict=True):
                        column.append(value)
                    offset += size
                number += 1
            arrays = [pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *arrays], names=["doc_id", *SCHEMA.names])

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            texts, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for part in runs(texts):
                split = known.split(texts[part])
                look = known.tables[0].__getitem__
                for doc, own in zip(ids[part], split, strict=True):
                    packer.place(doc, b"".join(map(look, own)) + closing)
                yield rows()
        if id_type is not None:
            packer.flush()
            yield rows()
        known.forget()
        trim(keep=True)

    return small_batches(docs).select("doc_id", "text").mapInArrow(
        pack,
        f"doc_id {doc_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
