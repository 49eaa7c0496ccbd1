"""SimHash near-duplicates by Golay-code keys.

Fingerprints of up to four differing bits link. A fingerprint has three
segments of at most 22 bits. If two linked fingerprints agree in a segment,
one of the other two has at most two errors: they share that segment and a
Golay key of the other (six tables). If no segment agrees, the errors are one,
one, and at most two, so the first two segments both share a Golay key (one
table). Every link therefore meets under some key, with some 60 keys each.

Equal fingerprints are one node. Rows of a key meet sorted in one task, which
verifies the pairs and gives out a spanning forest of its links instead of all
of them. Keys with more than ``TILE`` rows are handed on and compared in a
second pass, as pairs of tiles spread over tasks. Components come from
alternating star rounds over the forests.

Rows: null and wordless texts have fingerprint zero. A null id belongs to its
fingerprint's component, whose number is the smallest other id, or null if
there is none. Repeated rows stay repeated. An empty table gives no rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from foldspark.llm import golay
from foldspark.llm.frames import Aside
from foldspark.operators.graph import components
from foldspark.session import cut

WORDS = 4
MOST_BITS = 4
SEED = 42
# Rows of one key that a task compares by itself.
TILE = 4096
# Shingles whose bits are counted at once.
_SHINGLES = 1 << 14
# Low bit and length of the segments.
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_EXACT = [(i, j) for i in range(3) for j in range(3) if i != j]


def bounds(text: str | None, width: int) -> tuple[bytes, list[int], list[int]]:
    """A text's words joined by single blanks, and where its shingles of
    ``width`` words start and end; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return b"", [], []
    joined = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist(), len(joined)]
    if len(words) < width:
        return joined, [0], [len(joined)]
    return joined, starts[:len(words) - width + 1], ends[width - 1:]


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a whole text."""
    joined, starts, ends = bounds(text, WORDS)
    if not starts:
        return 0
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), _SHINGLES):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(
            starts[at:at + _SHINGLES], ends[at:at + _SHINGLES], strict=True)], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    set_bits = (2 * total > len(starts)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    prints = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=len(texts))
    return pa.array(prints.view(np.int64))


def with_fingerprint(docs: DataFrame, name: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint of each text as a signed long."""
    return docs.withColumn(name, _fingerprints(docs[text_col].cast("string")))


def as_hex(column: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints, and the row each belongs to. A key holds
    its table's number in the low three bits."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64)
             for low, size in _SEGMENTS]
    coded = [golay.keys(p) for p in parts]
    made, rows = [], []
    for table, (i, j) in enumerate(_EXACT):
        found, valid = coded[j]
        key = (parts[i][:, None] << 12 | found) << 3 | table
        made.append(key[valid])
        rows.append(np.nonzero(valid)[0])
    (a, valid_a), (b, valid_b) = coded[0], coded[1]
    key = (a[:, :, None] << 12 | b[:, None, :]) << 3 | len(_EXACT)
    valid = valid_a[:, :, None] & valid_b[:, None, :]
    made.append(key[valid])
    rows.append(np.nonzero(valid)[0])
    return np.concatenate(made), np.concatenate(rows)


def _keyed(batches):
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            prints = b.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
            key, row = keys_of(prints.view(np.uint64))
            yield pa.record_batch([pa.array(key), pa.array(prints[row])], names=["key", "print"])


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a`` and ``b``; roots are the sets' lowest numbers."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (flat := root[root]) is not None and not np.array_equal(flat, root):
            root = flat


def _forest(key: np.ndarray, prints: np.ndarray, tile: np.ndarray | None = None):
    """Edges of a spanning forest of the links within equal keys, which stand
    together. With tiles, keys are compared across two tiles only."""
    nodes, node = np.unique(prints, return_inverse=True)
    root, step, at = np.arange(len(nodes)), 0, np.arange(len(key))
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        other = at + step
        near = np.bitwise_count((prints[at] ^ prints[other]).view(np.uint64)) <= MOST_BITS
        root = _unite(root, node[at[near]], node[other[near]])
    linked = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[linked], nodes[root[linked]]


class _Seen:
    """Connections a task has given out; holds linked fingerprints only."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (up := self.root.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            self.root[p] = x
        return x

    def new(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        out = []
        for x, y in zip(a, b, strict=True):
            rx, ry = self.find(x), self.find(y)
            if rx != ry:
                self.root[max(rx, ry)] = min(rx, ry)
                out.append((x, y))
        return out


def _linked(batches, tile: int | None):
    """Links of key-sorted rows: ``(a, b, key)``, key null. A key of more than
    ``tile`` rows is handed on instead, as rows with its key and no ``b``."""
    seen = _Seen()
    kept_key, kept = np.empty(0, np.int64), np.empty(0, np.int64)
    large = None  # the key being handed on

    def handed(key, prints):
        return pa.record_batch([pa.array(prints), pa.nulls(len(prints), pa.int64()), pa.array(key)],
                               names=["a", "b", "key"])

    def links(key, prints):
        pairs = seen.new(*(x.tolist() for x in _forest(key, prints)))
        a, b = zip(*pairs, strict=True) if pairs else ((), ())
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                                pa.nulls(len(a), pa.int64())], names=["a", "b", "key"])

    for batch in batches:
        key = np.concatenate([kept_key, batch.column(0).to_numpy(zero_copy_only=False)])
        prints = np.concatenate([kept, batch.column(1).to_numpy(zero_copy_only=False)])
        if large is not None:
            same = key == large
            if same.any():
                yield handed(key[same], prints[same])
                key, prints = key[~same], prints[~same]
            if len(key):
                large = None
        if not len(key):
            kept_key, kept = key, prints
            continue
        kinds, first, count = np.unique(key, return_index=True, return_counts=True)
        order = np.argsort(first)
        kinds, first, count = kinds[order], first[order], count[order]
        if tile is not None:
            big = np.repeat(count > tile, count)
            if big.any():
                yield handed(key[big], prints[big])
                if count[-1] > tile:
                    large = int(kinds[-1])
                key, prints = key[~big], prints[~big]
        last = 0 if large is not None or not len(key) else int(count[-1])
        whole = len(key) - last
        yield links(key[:whole], prints[:whole])
        kept_key, kept = key[whole:], prints[whole:]
    if len(kept_key):
        yield links(kept_key, kept)


_LINKS = "a long, b long, key long"


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """``(a, b)`` over distinct fingerprints (one column ``print``), which
    connect just what links connect: a pair is of one component, but need not
    be a link itself."""
    keyed = prints.mapInArrow(_keyed, "key long, print long")
    found = cut(keyed.repartition("key").sortWithinPartitions("key")
                .mapInArrow(lambda batches: _linked(batches, tile), _LINKS))
    small = found.filter(F.col("key").isNull()).select("a", "b")
    large = found.filter(F.col("key").isNotNull()).select("key", F.col("a").alias("print"))
    if large.isEmpty():
        return small
    # Each tile of a large key meets every other once; a pair of tiles is a key.
    sizes = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / tile).cast("long").alias("tiles"))
    tiled = large.join(sizes, "key").withColumn("t", F.pmod(F.xxhash64("print"), F.col("tiles")))
    pairs = tiled.select("print", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1),
        lambda u: F.xxhash64("key", F.least("t", u), F.greatest("t", u)))).alias("key"))
    more = (pairs.select("key", "print").repartition("key").sortWithinPartitions("key")
            .mapInArrow(lambda batches: _linked(batches, None), _LINKS))
    return small.unionByName(more.select("a", "b"))


def classes(rows: DataFrame) -> DataFrame:
    """``(print, lowest)`` from ``rows(print, id)``: each distinct fingerprint
    with the lowest id of its component; ids are of any ordered type."""
    nodes = cut(rows.groupBy("print").agg(F.min("id").alias("id")))
    member = components(links(nodes.select("print"))).select(F.col("id").alias("print"), "comp")
    placed = nodes.join(member, "print", "left").select(
        "print", "id", F.coalesce("comp", "print").alias("comp"))
    lowest = placed.groupBy("comp").agg(F.min("id").alias("lowest"))
    return placed.join(lowest, "comp").select("print", "lowest")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row."""
    rows = cut(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")),
                                "print", "text").select("id", "print"))
    return rows.join(classes(rows), "print", "left").select(
        F.col("id").alias("doc_id"), as_hex(F.col("print")).alias("fingerprint"),
        F.col("lowest").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the lowest id, null ids
    last; of several rows with that id one stays."""
    # A row is known by its id and a hash over all of its columns.
    own = Aside(docs)
    whole = F.xxhash64(*own.frame.columns)
    number = F.coalesce(own.column(id_col).cast("long"), F.lit(-1))
    rows = cut(own.frame.select(
        F.struct(own.column(id_col).isNull().alias("no"), number.alias("number"),
                 whole.alias("whole")).alias("id"),
        _fingerprints(own.column(text_col).cast("string")).alias("print")))
    kept = classes(rows).select(F.col("lowest.number").alias("_number"),
                                F.col("lowest.whole").alias("_whole")).distinct()
    marked = own.frame.withColumns({"_number": number, "_whole": whole})
    return own.restore(marked.join(kept, ["_number", "_whole"], "left_semi")
                       .dropDuplicates(["_number", "_whole"]))
