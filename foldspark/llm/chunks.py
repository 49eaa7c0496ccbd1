"""Encode whole texts through a bounded table of space-delimited pieces.

The split pattern of the byte-level vocabularies never joins a space to what
stands before it. A text in which no space touches another white-space
character can therefore be cut before every space, and the pieces encoded
apart; for the same reason closing punctuation can be cut from a piece. Other
texts are encoded whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A space next to white space, by the widest definition of white space.
_TOUCH = re.compile(r" \s|\s ")
_CLOSING = ".,;:!?%&*$#)"
# Longer pieces are rare and not worth a place in the table.
_LONG = 64


class PieceTable:
    """Maps pieces to encoded bytes; ``encode_many`` fills in unknown ones.

    Beyond ``limit`` pieces, only those that came again stay, or else those of
    the present texts, so a worker's memory is bounded by the table and one
    batch of texts."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[bytes]], limit: int = 500_000):
        self._encode_many, self._limit = encode_many, limit
        self._table: dict[str, bytes] = {}
        self._again: set[str] = set()  # pieces that a later call found in the table

    def _encoded(self, strings: Iterable[str]) -> dict[str, bytes]:
        todo = sorted(set(strings))
        return dict(zip(todo, self._encode_many(todo), strict=True)) if todo else {}

    def _learn(self, missing: set[str]) -> None:
        table, whole, closed = self._table, set(), []
        for p in missing:
            core = p.rstrip(_CLOSING)
            if len(core) < len(p) and core and core[-1].isalnum():
                closed.append((p, core, p[len(core):]))
                if core not in table:
                    whole.add(core)
            else:
                whole.add(p)
        table.update((p[1:], ids) for p, ids in self._encoded(" " + p for p in whole).items())
        ends = self._encoded(end for _, _, end in closed)
        for p, core, end in closed:
            table[p] = table[core] + ends[end]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        cut = [[t or ""] if _TOUCH.search(t or "") else (t or "").split(" ") for t in texts]
        pieces: set[str] = set()
        for parts in cut:
            pieces.update(parts[1:])
        known = pieces & self._table.keys()
        missing = pieces - known
        self._again |= known
        if len(self._table) + len(missing) > self._limit:
            keep = self._again if len(self._again) + len(missing) < self._limit else known
            self._table = {p: self._table[p] for p in keep}
            self._again = set(known)
        self._learn(missing)
        first = self._encoded(parts[0] for parts in cut)
        find = self._table.__getitem__
        out = [b"".join((first[parts[0]], *map(find, parts[1:]))) for parts in cut]
        for p in missing:
            if len(p) > _LONG:
                self._table.pop(p, None)
        return out


# The same for the regular expressions of Arrow, whose \\s is ASCII only.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ARROW_TOUCH = f" {_BLANK}|{_BLANK} "
# Pieces that stand in one string for the tokenizer.
_JOINED = 2000
# Texts whose ids are gathered at once.
_GATHERED = 200


class JoinedTable:
    """As ``PieceTable``, for tokenizers whose ids stand for a known number of
    bytes. Texts are cut and their distinct pieces found in Arrow; unknown
    pieces are encoded many to a string, and the ids cut where the bytes of a
    piece end.

    The table has two generations: what the younger one lacks is moved over
    from the older one, and once the younger holds half of ``limit`` it takes
    the older one's place. So pieces that come again stay, and the many that
    occur once go. Pieces with closing punctuation are not kept, but put
    together from the word and its end."""

    def __init__(self, encode_many: Callable[[list[str]], Iterable[list[int]]], byte_lengths: np.ndarray,
                 limit: int = 600_000):
        self._encode_many, self._lengths, self._limit = encode_many, byte_lengths, limit
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _apart(self, strings: list[str]) -> list[bytes]:
        return [np.array(ids, dtype="<u4").tobytes() for ids in self._encode_many(strings)] if strings else []

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece behind a space."""
        groups = [pieces[at:at + _JOINED] for at in range(0, len(pieces), _JOINED)]
        out: list[bytes] = []
        for group, ids in zip(groups, self._encode_many([" " + " ".join(g) for g in groups]) if groups else [],
                              strict=True):
            ids = np.array(ids, dtype="<u4")
            stops = np.cumsum(self._lengths[ids])
            want = np.cumsum([len(p.encode()) + 1 for p in group])
            at = np.searchsorted(stops, want)
            if at[-1] >= len(stops) or (stops[at] != want).any():
                out.extend(self._apart([" " + p for p in group]))
                continue
            flat, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
            out.extend(flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        return out

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of the missing pieces, which enter the table."""
        # white space at a piece's end would touch the next one's space
        inner = [p for p in missing if p and not p[-1].isspace()]
        ends = [p for p in missing if not p or p[-1].isspace()]
        found = dict(zip(inner, self._joined(inner), strict=True))
        found.update(zip(ends, self._apart([" " + p for p in ends]), strict=True))
        if 2 * len(self._young) > self._limit:
            self._old, self._young = self._young, {}
        self._young.update((p, ids) for p, ids in found.items() if len(p) <= _LONG)
        return found

    def _find(self, piece: str) -> bytes | None:
        ids = self._young.get(piece)
        if ids is None and (ids := self._old.get(piece)) is not None:
            self._young[piece] = ids
        return ids

    def _ids_of(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each behind a space."""
        ids = list(map(self._young.get, pieces))
        # plain lists side by side: tuples by the hundred thousand keep the collector busy
        unknown, later, closed, cores, tails = set(), [], [], [], []
        for k in [k for k, known in enumerate(ids) if known is None]:
            piece = pieces[k]
            core = piece.rstrip(_CLOSING)
            if len(core) < len(piece) and core and core[-1].isalnum():
                closed.append(k)
                cores.append(core)
                tails.append(piece[len(core):])
                if self._find(core) is None:
                    unknown.add(core)
            elif (known := self._find(piece)) is not None:
                ids[k] = known
            else:
                unknown.add(piece)
                later.append(k)
        closings = sorted(set(tails))
        ends = dict(zip(closings, self._apart(closings), strict=True))
        young, old, found = self._young, self._old, self._learn(sorted(unknown))
        for k in later:
            ids[k] = found[pieces[k]]
        for k, core, end in zip(closed, cores, tails, strict=True):
            known = found.get(core) or young.get(core) or old[core]
            ids[k] = known + ends[end]
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each whole text, as little-endian 32-bit numbers."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _ARROW_TOUCH)
        encoded = self._apart(texts.filter(whole).to_pylist())
        cut = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        if not len(cut):
            return encoded
        heads = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        kinds = cut.flatten().dictionary_encode()
        piece = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = kinds.dictionary.to_pylist()
        # the first piece of a text has no space before it
        first, own = np.unique(piece[heads], return_inverse=True)
        piece[heads] = len(pieces) + own
        ids = self._ids_of(pieces) + self._apart([pieces[k] for k in first.tolist()])
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(ids), dtype="<u4")
        stops, plain = [*heads[1:].tolist(), len(piece)], []
        for a, b in zip(range(0, len(heads), _GATHERED), [*range(_GATHERED, len(heads), _GATHERED), len(heads)],
                        strict=True):
            some = piece[heads[a]:stops[b - 1]]
            n = size[some]
            at = np.cumsum(n) - n
            gathered = flat[np.repeat(start[some] - at, n) + np.arange(int(n.sum()))].tobytes()
            cuts = [*(4 * at[heads[a:b] - heads[a]]).tolist(), len(gathered)]
            plain.extend(gathered[x:y] for x, y in zip(cuts, cuts[1:], strict=False))
        by_kind = {True: iter(encoded), False: iter(plain)}
        return [next(by_kind[w]) for w in whole.to_pylist()]
