"""Word and shingle hashes shared by the near-duplicate operators, taken from whole Arrow batches at once.

Words lie between ASCII white space (``[^\\x20\\x09-\\x0D]+``), A-Z count as a-z; a null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words in a shingle.
WIDTH = 5
#: Bytes of text that are worked on at once (one text at least).
PART_BYTES = 1 << 20
_MULTIPLIERS = np.array([xxhash.xxh3_64_intdigest(f"place {i}".encode()) | 1 for i in range(64)], np.uint64)
_FOLD = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """The words of consecutive texts: their hashes, and where each text's words begin.

    Words ``first[i]`` to ``first[i + 1]`` are text i's. ``starts`` and ``ends`` are byte places in ``data``.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray):
        self.hashes, self.first, self.starts, self.ends, self.data = hashes, first, starts, ends, data

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> np.ndarray:
        """Hashes of text i's words in order."""
        return self.hashes[self.first[i] : self.first[i + 1]]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every word, taken 8 bytes at a time; words of up to 7 bytes can't collide."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    left = ends - starts
    h = mixed((eight[starts] & _MASKS[np.minimum(left, 8)]) + (np.minimum(left, 8).astype(np.uint64) << np.uint64(59)))
    long = np.flatnonzero(left > 8)
    at = 8
    while len(long):
        rest = np.minimum(left[long] - at, 8)
        chunk = (eight[starts[long] + at] & _MASKS[rest]) + rest.astype(np.uint64)
        h[long] = mixed((h[long] ^ mixed(chunk * _MULTIPLIERS[1])) * _MULTIPLIERS[0] + np.uint64(at))
        at += 8
        long = long[left[long] > at]
    return h


def batch_words(column: pa.Array) -> Iterator[tuple[slice, Words]]:
    """The words of a string column, in slices of about ``PART_BYTES``."""
    filled = pc.fill_null(column, "").cast(pa.large_string())
    if not len(filled):
        return
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    raw = filled.buffers()[2]
    raw = memoryview(raw) if raw is not None else memoryview(b"")
    begin = 0
    while begin < len(filled):
        end = int(np.searchsorted(offsets, offsets[begin] + PART_BYTES, "right")) - 1
        end = min(max(end, begin + 1), len(filled))
        own = offsets[begin : end + 1] - offsets[begin]
        data = bytes(raw[offsets[begin] : offsets[end]]).translate(_FOLD) + b" " * 16
        codes = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(codes) + 1, bool)
        inside[1:] = codes != 32
        cut = np.zeros(len(codes) + 1, bool)  # a text ends a word
        cut[own[:-1]] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut[:-1]))
        ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:-1])) + 1
        first = np.searchsorted(starts, own)
        yield slice(begin, end), Words(_word_hashes(data, starts, ends), first, starts, ends, codes)
        begin = end


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every run of ``width`` words."""
    n = len(hashes) - width + 1
    out = np.full(max(n, 0), np.uint64(width))
    for i in range(width if n > 0 else 0):
        out += hashes[i : i + n] * _MULTIPLIERS[i]
    return mixed(out)


def shingle_sets(words: Words) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text: of ``WIDTH`` words, or of the whole sequence if it is shorter."""
    whole = window_hashes(words.hashes, WIDTH)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            own = np.sort(whole[a : b - WIDTH + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        else:
            out.append(window_hashes(words.hashes[a:b], b - a) if b > a else words.hashes[a:b])
    return out


def signature(shingles: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return xxhash.xxh3_128_digest(shingles.tobytes())
