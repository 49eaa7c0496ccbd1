"""Byte-level BPE encoding by merge replay, and decoding.

The distinct pretokens of a batch of documents form one array of byte symbols.
An inverted index from merge rank to symbol positions is popped in rank order:
each pop merges at its positions and looks up only the two new neighbour pairs
of each. A pop takes the leftmost position of every word and leaves further
ones for the next pop of that rank, so a merge that opens a lower rank is
followed by that rank first, as when each word is encoded alone.

A batch is the unit of the replay, so a task's memory is bounded; pieces that
come again are found in the worker's table.

Rows: null text counts as empty and gives no ids; a null id is kept as it is;
repeated rows are encoded each for itself; an empty table gives no rows. Other
columns of the input are not read."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from foldspark.llm.chunks import PieceTable

# Texts are encoded this many at a time within an Arrow batch; that and the table below
# bound the memory of a worker.
_TEXTS = 1000
# Pieces the table of a worker holds.
_PIECES = 250_000
_NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of a byte-level vocabulary, with all pairs that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        ranks = self.ranks
        size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[p] for p in self.pairs.tolist()], dtype=np.int64)
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank each pair merges to, ``_NONE`` where it doesn't."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], _NONE)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, gathered from the flat token table."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids) or not ends[-1]:
            return b""
        shift = self.starts[ids] - (ends - lengths)
        return self.bytes[np.arange(ends[-1]) + np.repeat(shift, lengths)].tobytes()


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of every word. A word that is a token itself is that token."""
    whole = [vocab.ranks.get(w) for w in words]
    rest = [w for w, r in zip(words, whole, strict=True) if r is None and w]
    split = iter(_merge(rest, vocab))
    return [np.empty(0, np.int64) if not w else np.array([r]) if r is not None else next(split)
            for w, r in zip(words, whole, strict=True)]


def _merge(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    if not words:
        return []
    lengths = np.array([len(w) for w in words])
    symbols = vocab.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
    n = len(symbols)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = n  # no pair leaves its word
    before[ends - lengths] = -1
    alive = np.ones(n + 1, dtype=bool)
    rank = np.full(n + 1, _NONE)
    left = np.flatnonzero(after < n)
    rank[left] = vocab.rank_of(symbols[left], symbols[left + 1])

    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Put positions into the index under their present rank."""
        at = at[rank[at] < _NONE]
        if not len(at):
            return
        at = at[np.argsort(rank[at], kind="stable")]
        kinds, first = np.unique(rank[at], return_index=True)
        for r, group in zip(kinds.tolist(), np.split(at, first[1:]), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(queue, r)
            index[r].append(group)

    enter(left)
    while queue:
        r = heapq.heappop(queue)
        groups = index.pop(r)
        at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        at = at[alive[at] & (rank[at] == r)]
        if not len(at):
            continue
        at.sort()
        owner = word[at]
        lead = np.ones(len(at), dtype=bool)
        lead[1:] = owner[1:] != owner[:-1]
        if not lead.all():
            enter(at[~lead])
        at = at[lead]
        gone = after[at]
        symbols[at] = r
        alive[gone] = False
        behind = after[gone]
        after[at] = behind
        inner = behind < n
        before[behind[inner]] = at[inner]
        rank[at] = _NONE
        some = at[inner]
        if len(some):
            rank[some] = vocab.rank_of(symbols[some], symbols[after[some]])
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        if len(ahead):
            rank[ahead] = vocab.rank_of(symbols[ahead], symbols[after[ahead]])
        enter(np.concatenate([some, ahead]))
    kept = alive[:n]
    counts = np.add.reduceat(kept.astype(np.int64), ends - lengths)
    return np.split(symbols[kept], np.cumsum(counts)[:-1])


@cache
def _table(path: str, pattern: str) -> PieceTable:
    vocab, split = vocabulary(path), regex.compile(pattern)

    def encode_many(pieces: list[str]) -> Iterable[bytes]:
        parts = [split.findall(p) for p in pieces]
        words = sorted({w for p in parts for w in p})
        ids = replay([w.encode() for w in words], vocab)
        known = {w: i.astype("<i4").tobytes() for w, i in zip(words, ids, strict=True)}
        return [b"".join([known[w] for w in p]) for p in parts]
    return PieceTable(encode_many, _PIECES)


def _lists(values: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(v) // 4 for v in values)])
    flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(values))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _encoded(batches, path: str, pattern: str):
    table = _table(path, pattern)
    for b in batches:
        for at in range(0, b.num_rows, _TEXTS):
            part = b.slice(at, _TEXTS)
            yield pa.record_batch([part.column(0), _lists(table.encode(part.column(1).to_pylist()))],
                                  names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>)`` of every whole text."""
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(
        lambda batches: _encoded(batches, path, pattern), "doc_id long, ids array<int>")


def _decoded(batches, path: str):
    vocab = vocabulary(path)
    for b in batches:
        for at in range(0, b.num_rows, _TEXTS):
            part = b.slice(at, _TEXTS)
            lists = part.column("ids")
            texts = [vocab.decode(i.values.to_numpy(zero_copy_only=False)) if i.is_valid else b""
                     for i in lists]
            yield pa.record_batch([part.column("doc_id"), lists, pa.array(texts, pa.binary())],
                                  names=["doc_id", "ids", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the bytes that its ids stand for."""
    return encoded.select("doc_id", "ids").mapInArrow(
        lambda batches: _decoded(batches, path), "doc_id long, ids array<int>, decoded binary")
