"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens. It starts with one
state and an arc for each base symbol. Merge m = (u, v) -> w then adds one gadget: the
state that u leads to is copied as state m without its arc for v, u is led to the copy,
and w gets arcs wherever u has one, to where v led. All arcs of one token lead to one
state, so the automaton is held as ``target`` (token -> state) and, for each state, the
state it copies and the token whose arc it lost. On the way from a state to the one it began as, a token's arc is lost once at most, so the
states that lost one token are disjoint intervals of the tree of copies: whether a state has an arc is one search in a sorted table.
Exactly one path spells a word, and its arcs are the word's BPE tokens.

Encoding is one forward pass without steps back. A trie over the bytes of all tokens gives the tokens that begin at each
place. Every place is reached by the last arc of exactly one path that spells the bytes before it, so a token is taken where the state
reached there has an arc for it. Many words are walked at once, as arrays, place by place. Decoding emits the labels of the arcs.

Pre-splitting follows the vocabulary file: special tokens first, then NFC, lower case and
words by the file's pattern (for scripts beyond Latin by the library's own splitter). Words seen before are
answered from a bounded table.

Defined results: null text counts as empty and has no tokens; repeated rows are each
answered; an empty table gives no rows; texts and words of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import KEPT, runs, small_batches, trim
from .op01_language import GramTable

#: Entries in a worker's table of words; beyond it a new table starts, and what is used again moves on from the old one.
TABLE_LIMIT = 300_000
#: Bytes of words that are walked at once (one word at least).
WALK_BYTES = 1 << 19
#: White space of the vocabulary file's pattern among the characters below U+0250.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
BEYOND_LATIN = re.compile("[^\x00-\u024f]")
NEVER = 1 << 40


def latin_words() -> re.Pattern:
    """The vocabulary file's word pattern for lower-case text below U+0250."""
    kinds: dict[str, str] = {}
    for c in map(chr, range(0x250)):
        kind = unicodedata.category(c)[0]
        kind = "space" if c in SPACES else kind if kind in "LN" else "other"
        kinds[kind] = kinds.get(kind, "") + re.escape(c)
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[{kinds['other']}]+")


def byte_symbols() -> list[str]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table, spare = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class BpeAutomaton:
    """The compiled automaton of one vocabulary file."""

    def __init__(self, content: str):
        """Compile the JSON text of a vocabulary file."""
        spec = json.loads(content)
        suffix = spec["model"]["end_of_word_suffix"]
        vocab = spec["model"]["vocab"]
        self.labels = {i: t for t, i in vocab.items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        self.latin = latin_words()
        # only the library's normaliser and splitter are used, so it needs no vocabulary
        self.library = Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "post_processor": None, "model": spec["model"] | {"vocab": {}, "merges": []}}))
        size = max(self.labels) + 1
        self.left, self.made = np.full(size, -1), np.full(size, NEVER)
        self._compile([(vocab[a], vocab[b], vocab[a + b if not a.endswith(suffix) else a + b]) for a, b in spec["model"]["merges"]], size)
        # bytes of each token; the end of a word is a line feed, which no word holds
        texts = {i: (t[: -len(suffix)] if t.endswith(suffix) else t, t.endswith(suffix)) for t, i in vocab.items()}
        self._plant({i: bytes(self.byte_of[c] for c in t) + b"\n" * ends for i, (t, ends) in texts.items()}, size)

    def _compile(self, merges: list[tuple[int, int, int]], size: int) -> None:
        target, copied, lost = [0] * size, [0], [-1]
        for m, (u, v, w) in enumerate(merges, 1):
            copied.append(target[u])
            lost.append(v)
            target[w] = target[v]
            target[u] = m
            self.left[w], self.made[w] = u, m
        # intervals of the tree of copies, in which a copy comes after its origin
        below = [1] * len(copied)
        for s in range(len(copied) - 1, 0, -1):
            below[copied[s]] += below[s]
        begin, free = [0] * len(copied), [1] * len(copied)
        for s in range(1, len(copied)):
            begin[s] = free[copied[s]]
            free[copied[s]] += below[s]
            free[s] = begin[s] + 1
        self.begin = np.array(begin)[np.array(target)]
        keys = np.array(lost[1:], np.int64) << 32 | np.array(begin[1:])
        order = np.argsort(keys)
        self.lost_keys = np.concatenate([[-1], keys[order]])
        self.lost_ends = np.concatenate([[-1], (np.array(begin[1:]) + np.array(below[1:]))[order]])
        self.lost_states = np.concatenate([[NEVER], order + 1])

    def _plant(self, texts: dict[int, bytes], size: int) -> None:
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        for token, text in texts.items():
            node = 0
            for b in text:
                node = children.setdefault(node << 8 | b, len(children) + 1)
            ends[node] = token
        self.children = GramTable(np.array(list(children), np.int64))
        self.child = np.array(list(children.values()), np.int64)
        self.token_at = np.full(len(children) + 1, -1)
        self.token_at[list(ends)] = list(ends.values())
        self.size_of = np.zeros(size, np.int64)
        self.size_of[list(texts)] = [len(t) for t in texts.values()]

    def has_arc(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the state that each ``last`` leads to has an arc for ``token``."""
        at, has, live = self.begin[last], np.ones(len(last), bool), np.arange(len(last))
        limit, token = np.full(len(last), NEVER), token.copy()
        while len(live):  # a merged token's arc was added where its left part still had one
            slot = np.searchsorted(self.lost_keys, token << 32 | at, "right") - 1
            gone = (self.lost_keys[slot] >> 32 == token) & (at < self.lost_ends[slot]) & (self.lost_states[slot] <= limit)
            has[live[gone]] = False
            on = ~gone & (self.left[token] >= 0)
            live, at, limit, token = live[on], at[on], self.made[token[on]], self.left[token[on]]
        return has

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pre-split words, given as their UTF-8 bytes, one word after another, and where each word's ids end."""
        ids, counts, begin, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0, 0
        for i, word in enumerate(words, 1):
            size += len(word) + 1
            if size >= WALK_BYTES or i == len(words):
                flat, own = self._walk(words[begin:i])
                ids.append(flat)
                counts.append(own)
                begin, size = i, 0
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))

    def _walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"\n".join(words) + b"\n", np.uint8).astype(np.int64)
        sizes = np.array([len(w) + 1 for w in words])
        end = np.cumsum(sizes)
        start = end - sizes
        # every token that begins at every place; the end mark stops a path in the trie
        places, nodes, found, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], 0
        while len(places):
            row = self.children.find(nodes << 8 | codes[places + depth])
            hit = row >= 0
            places, nodes = places[hit], self.child[row[hit]]
            depth += 1
            tokens = self.token_at[nodes]
            ends = tokens >= 0
            found.append((places[ends], tokens[ends]))
            inside = places + depth < len(codes)
            places, nodes = places[inside], nodes[inside]
        place = np.concatenate([f[0] for f in found])
        token = np.concatenate([f[1] for f in found])
        within = place - np.repeat(start, sizes)[place]
        order = np.argsort(within, kind="stable")
        place, token, within = place[order], token[order], within[order]
        cuts = np.searchsorted(within, np.arange(int(sizes.max()) + 1)).tolist()
        last = np.full(len(codes) + 1, -1)  # last token of the path up to a place
        for a, b in zip(cuts, [*cuts[1:], len(place)], strict=True):
            at, own = place[a:b], token[a:b]
            stop = at + self.size_of[own]
            # a word's end and the next word's start are one place: the start has no token before it
            open_ = last[stop] < 0
            at, own, stop = at[open_], own[open_], stop[open_]
            if a:
                ok = self.has_arc(last[at], own)
                own, stop = own[ok], stop[ok]
            last[stop] = own
        live, at, taken = np.arange(len(words)), end.copy(), []
        while len(live):
            own = last[at[live]]
            taken.append((live, own))
            at[live] -= self.size_of[own]
            live = live[at[live] > start[live]]
        owner = np.concatenate([t[0] for t in taken[::-1]])
        flat = np.concatenate([t[1] for t in taken[::-1]])
        return flat[np.argsort(owner, kind="stable")].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def split(self, text: str | None) -> list:
        """Pre-split words (text or bytes) and special tokens (ids)."""
        if not text:
            return []
        if "<|" not in text and (text.isascii() or not BEYOND_LATIN.search(text)):
            lower = text.lower()  # nothing below U+0250 composes, so NFC changes nothing
            if text.isascii() or not BEYOND_LATIN.search(lower):
                return self.latin.findall(lower)
        out: list = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:  # the library's own tables, as Unicode versions differ
                folded = self.library.normalizer.normalize_str(part)
                out += [bytes(self.byte_of[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(folded)]
        return out


class WordTable:
    """Bounded tables from a word to its encoded forms; ``forms`` give a form's values for (ids, ends of words)."""

    def __init__(self, automaton: BpeAutomaton, *forms):
        self.automaton, self.forms = automaton, forms
        self.forget()

    def forget(self) -> None:
        """Drop all words; the automaton stays."""
        self.tables: list[dict] = [{} for _ in self.forms]
        self.old: list[dict] = [{} for _ in self.forms]

    def split(self, texts: list[str | None]) -> list[list]:
        """The words of texts, all of them in the tables afterwards."""
        out = [self.automaton.split(t) for t in texts]
        if len(self.tables[0]) >= TABLE_LIMIT:
            self.old, self.tables = self.tables, [{} for _ in self.forms]
        new = set().union(*out).difference(self.tables[0])
        again = new.intersection(self.old[0])
        for table, old in zip(self.tables, self.old, strict=True):
            table.update((w, old[w]) for w in again)
        words = [w for w in new if w.__class__ is not int and w not in again]
        special = [w for w in new if w.__class__ is int and w not in again]
        ids, ends = self.automaton.encode([w.encode() if w.__class__ is str else w for w in words])
        ids = np.concatenate([ids, np.array(special, np.uint32)])
        ends = np.concatenate([ends, (ends[-1] if len(ends) else 0) + 1 + np.arange(len(special))])
        for table, form in zip(self.tables, self.forms, strict=True):
            table.update(zip(words + special, form(self.automaton, ids, ends.tolist()), strict=True))
        return out


def packed(automaton: BpeAutomaton, ids: np.ndarray, ends: list[int]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    flat = ids.astype("<u4").tobytes()
    return [flat[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]


def decimal(automaton: BpeAutomaton, ids: np.ndarray, ends: list[int]) -> list[str]:
    """Ids of each word in decimal, joined by one space."""
    written = list(map(str, ids.tolist()))
    return [" ".join(written[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def labelled(automaton: BpeAutomaton, ids: np.ndarray, ends: list[int]) -> list[str]:
    """Labels of each word's ids, joined by one space, as a tokenizer without a decoder does."""
    labels = list(map(automaton.labels.__getitem__, ids.tolist()))
    return [" ".join(labels[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def table(content: str, *forms) -> WordTable:
    """The worker's table for a vocabulary file's text; it outlives a task, without its words."""
    key = (hashlib.sha256(content.encode()).hexdigest(), *[f.__name__ for f in forms])
    if key not in KEPT:
        KEPT.clear()
        KEPT[key] = WordTable(BpeAutomaton(content), *forms)
    return KEPT[key]


def vocabulary(path: str) -> str:
    """The text of a vocabulary file, to be broadcast (a few MB, whatever the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode and decode every whole text; one row for each document, no shuffle."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(vocabulary_path))

    def encode(batches):
        known = table(content.value, decimal, labelled)
        sha256 = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            counts, digests, decoded = [], [], []
            texts = batch.column("text").to_pylist()
            for part in runs(texts):
                split = known.split(texts[part])
                in_ids, in_labels = (t.__getitem__ for t in known.tables)
                for own in split:
                    ids = " ".join(map(in_ids, own))
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    digests.append(sha256(ids))
                    decoded.append(sha256(" ".join(map(in_labels, own))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        known.forget()
        trim(keep=True)

    return small_batches(docs).select("doc_id", "text").mapInArrow(
        encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
