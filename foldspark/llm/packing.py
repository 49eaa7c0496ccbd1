"""Hierarchical multi-length packing of token sequences.

Documents are cut into full windows of the largest context size; what remains
of each goes to the smallest tier it fits. The tiers are packed from the
largest down: every piece opens a window of its tier, and the gap behind it is
filled with the longest pieces of the shorter tiers that fit, then with a cut
one. Closed windows are dealt to step groups of equal tokens and nearly equal
attention cost.

Packing runs inside each input partition, over a pool of bounded size, so no
text or token is shuffled and a task's memory does not depend on the partition.
A partition's last tokens are cut into windows of falling powers of two, so
nothing is padded.

Rows: null text counts as empty and gives the end token alone; a null id is
kept as it is; repeated rows are packed each for itself; an empty table gives
no rows. Other columns of the input are not read, so they cannot clash."""

from __future__ import annotations

import bisect
import gc
import os
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from foldspark.llm.chunks import JoinedTable

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32 * 2048
# Tokens a task gathers before it packs, and keeps back as filling for later.
_GATHER, _KEEP = 1 << 19, 1 << 17
# Windows wait in the step builder until this many steps can be dealt at once.
_STEPS = 4
# Sequence and step numbers of a partition start at its number times this.
_SPAN = 1 << 40
# Pieces of an output batch, and strings the tokenizer encodes at once; its
# encodings are large.
_ROWS, _STRINGS = 1024, 16
# Texts encoded at once.
_TEXTS = 2000

_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
           ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
           ("offset", pa.int64()), ("window", pa.int32()), ("step_id", pa.int64())]
SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long, window int, step_id long")

_TABLES: dict[tuple[str, int], JoinedTable] = {}
# Pieces of text a worker remembers; fewer take less memory and more time.
PIECES = 600_000


def _tokenizer_table(path: str, pieces: int = PIECES) -> JoinedTable:
    """The worker's table for one tokenizer file; ids as little-endian uint32."""
    if (path, pieces) not in _TABLES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def encode_many(texts):
            for at in range(0, len(texts), _STRINGS):
                for e in tokenizer.encode_batch_fast(texts[at:at + _STRINGS], add_special_tokens=False):
                    yield e.ids

        # a byte-level vocabulary writes every byte as one character
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        lengths = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        lengths[list(vocab.values())] = [len(t) for t in vocab]
        _TABLES[path, pieces] = JoinedTable(encode_many, lengths, pieces)
    return _TABLES[path, pieces]


class _Piece:
    """Tokens ``start`` to ``end`` of a document; ``ids`` holds all its bytes."""

    __slots__ = ("doc", "ids", "start", "end", "total")

    def __init__(self, doc, ids: bytes, start: int, end: int, total: int):
        self.doc, self.ids, self.start, self.end, self.total = doc, ids, start, end, total

    def __len__(self) -> int:
        return self.end - self.start

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        at = self.start + n
        return (_Piece(self.doc, self.ids, self.start, at, self.total),
                _Piece(self.doc, self.ids, at, self.end, self.total))


class _Tier:
    """Pieces of one tier, sorted by length."""

    def __init__(self):
        self.sizes: list[int] = []
        self.pieces: list[_Piece] = []

    def put(self, piece: _Piece) -> None:
        at = bisect.bisect_left(self.sizes, len(piece))
        self.sizes.insert(at, len(piece))
        self.pieces.insert(at, piece)

    def take(self, most: int | None = None) -> _Piece | None:
        """The longest piece, or the longest of at most ``most`` tokens."""
        at = len(self.sizes) if most is None else bisect.bisect_right(self.sizes, most)
        if not at:
            return None
        self.sizes.pop(at - 1)
        return self.pieces.pop(at - 1)


class Packer:
    """Streams documents into windows: ``(window, step, pieces)``."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        if any(t & (t - 1) for t in tiers) or step_tokens % max(tiers):
            raise ValueError("tiers are powers of two, and steps multiples of the largest")
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.pool = {t: _Tier() for t in self.tiers}
        self.pooled, self.closed, self.waiting, self.step = 0, [], 0, 0

    def add(self, doc, ids: bytes) -> Iterator[tuple[int, int, list[_Piece]]]:
        total, top = len(ids) // 4, self.tiers[-1]
        full = total - total % top
        for start in range(0, full, top):
            self._close(top, [_Piece(doc, ids, start, start + top, total)])
        if total > full:
            # the rest alone stays in memory, not the whole document
            self._route(_Piece(doc, ids[4 * full:], full, total, total))
        if self.pooled >= _GATHER:
            self._pack(_KEEP)
        yield from self._deal(_STEPS * self.step_tokens)

    def finish(self) -> Iterator[tuple[int, int, list[_Piece]]]:
        self._pack(0)
        yield from self._deal(0)

    def _route(self, piece: _Piece) -> None:
        self.pool[next(t for t in self.tiers if t >= len(piece))].put(piece)
        self.pooled += len(piece)

    def _close(self, window: int, pieces: list[_Piece]) -> None:
        self.closed.append((window, pieces))
        self.waiting += window

    def _pack(self, keep: int) -> None:
        for window in reversed(self.tiers):
            while self.pooled > keep and (piece := self.pool[window].take()):
                self.pooled -= len(piece)
                self._fill(window, piece)

    def _fill(self, window: int, piece: _Piece) -> None:
        pieces, gap = [piece], window - len(piece)
        shorter = [t for t in reversed(self.tiers) if t < window]
        while gap and (whole := self._first(shorter, gap)):
            pieces.append(whole)
            gap -= len(whole)
        while gap:
            # nothing fits whole: cut a piece, of the shorter tiers if they have one
            longer = self._first([*shorter, window, *(t for t in self.tiers if t > window)], None)
            if longer is None:
                break
            part, rest = longer.cut(min(gap, len(longer)))
            pieces.append(part)
            gap -= len(part)
            if len(rest):
                self._route(rest)
        if not gap:
            self._close(window, pieces)
        else:
            self._tail(pieces)

    def _first(self, tiers: Iterable[int], most: int | None) -> _Piece | None:
        for t in tiers:
            if piece := self.pool[t].take(most):
                self.pooled -= len(piece)
                return piece
        return None

    def _tail(self, pieces: list[_Piece]) -> None:
        """No tokens are left: the last ones fill windows of falling size."""
        left = sum(map(len, pieces))
        while left:
            size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                part, rest = pieces[0].cut(min(room, len(pieces[0])))
                window.append(part)
                room -= len(part)
                pieces = [rest, *pieces[1:]] if len(rest) else pieces[1:]
            self._close(size, window)
            left -= size

    def _deal(self, hold: int) -> Iterator[tuple[int, int, list[_Piece]]]:
        """Deal waiting windows to steps once ``hold`` tokens wait. The largest
        go first, each to the step of least attention cost that has room."""
        if not self.waiting or self.waiting < hold:
            return
        steps = max(1, self.waiting // self.step_tokens)
        room, cost = [self.step_tokens] * steps, [0] * steps
        rest = []
        for window, pieces in sorted(self.closed, key=lambda c: -c[0]):
            fits = [k for k in range(steps) if room[k] >= window]
            if not fits and hold:
                rest.append((window, pieces))
                continue
            if not fits:
                fits = [steps]
                steps += 1
                room.append(self.step_tokens)
                cost.append(0)
            k = min(fits, key=lambda s: (cost[s], -room[s]))
            room[k] -= window
            cost[k] += window * window
            yield window, self.step + k, pieces
        self.step += steps
        self.closed, self.waiting = rest, sum(w for w, _ in rest)


def _ids_of(piece: _Piece) -> bytes:
    # a routed rest holds only the document's last bytes
    skip = 4 * piece.total - len(piece.ids)
    return piece.ids[4 * piece.start - skip:4 * piece.end - skip]


def _uncollected(batches):
    """``batches`` with the cycle collector off: a table of many strings and
    lists of ids by the million make it search often, and hold no cycles."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


def _packed(batches, path: str, end_id: int, tiers, step_tokens: int, pieces: int):
    table = _tokenizer_table(path, pieces)
    base = TaskContext.get().partitionId() * _SPAN
    packer, end = Packer(tiers, step_tokens), struct.pack("<I", end_id)
    rows, sequence = [], base

    def out(windows):
        nonlocal sequence
        for window, step, pieces in windows:
            offset = 0
            for p in pieces:
                rows.append((p.doc, p.start, len(p), _ids_of(p), p.total, sequence, offset, window,
                             base + step))
                offset += len(p)
            sequence += 1

    def batch():
        made = pa.record_batch([pa.array(c, t) for c, (_, t) in
                                zip(zip(*rows, strict=True), _FIELDS, strict=True)],
                               names=[n for n, _ in _FIELDS])
        rows.clear()
        return made

    for b in batches:
        texts = b.column(1)
        for at in range(0, b.num_rows, _TEXTS):
            docs = b.column(0).slice(at, _TEXTS).to_pylist()
            for doc, ids in zip(docs, table.encode(texts.slice(at, _TEXTS)), strict=True):
                out(packer.add(doc, ids + end))
                if len(rows) >= _ROWS:
                    yield batch()
    out(packer.finish())
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, tiers=TIERS,
         step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text",
         pieces: int = PIECES) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences: the
    document, its tokens before the piece, the piece's length and ids
    (little-endian uint32), the document's tokens with the end token, sequence
    and offset, the sequence's window size and its step group."""
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(
        lambda batches: _uncollected(_packed(batches, tokenizer_path, end_id, tiers, step_tokens, pieces)), SCHEMA)
