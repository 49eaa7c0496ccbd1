"""Target-distribution importance resampling over hashed word features.

Every run of one to ``most`` words is a feature, its bucket the CRC-32 of its
UTF-8 bytes modulo the number of buckets. Bucket counts over all documents and
over all target texts give each bucket's gain, the log of the ratio of its
smoothed shares; a document's weight is the sum of its features' gains. Gumbel
noise from a digest of the id makes the highest scores a draw without
replacement in proportion to the exponential of the weights.

CRC-32 is linear over XOR: a span's checksum is the XOR of what each of its
bytes gives by its distance from the end, and a constant of the length. The
contributions come from a table of (distance, byte), the spans of a batch of
texts are one flat array of them, and ``bitwise_xor.reduceat`` folds it at the
span starts. A span longer than the table is cut into blocks counted from its
end; the checksum so far moves on by a whole block of zero bytes, and the
block's own XOR joins it.

Words are cut by bytes: ASCII letters and digits, and every byte of a code
point beyond ASCII, belong to a word; A-Z are lowered and nothing else.

Rows: null and wordless texts have no features and weight 0, and are not drawn.
A null id draws by the empty text and comes last among equal scores. Repeated
rows count, and are drawn, each for itself. Without documents or targets the
smoothed shares still exist; an empty table gives no rows. Extra columns are
not read."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.shape import dense_index
from foldspark.session import cut

BUCKETS = 10_000
# Distances from a span's end that the table holds.
BLOCK = 256
# Bytes of text whose features are hashed at once; a longer text is a part of its own.
_PART = 1 << 20
# Spans, or blocks of spans, whose contributions stand in memory at once.
_SPANS = 1 << 14
_ONES = 0xFFFFFFFF


def _byte_steps() -> np.ndarray:
    """What a register's low byte turns into when one byte has been shifted out;
    zlib's own checksums of single bytes give it."""
    return np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], dtype=np.uint32)


class PositionTable:
    """Contributions by (distance from the end, byte), the register that ones
    become after so many zero bytes, and a step over a whole block of zeros."""

    def __init__(self, block: int = BLOCK):
        self.block, step = block, _byte_steps()
        self.table = np.empty((block, 256), dtype=np.uint32)
        self.table[0] = step
        for d in range(1, block):
            self.table[d] = self._zero(self.table[d - 1], step)
        self.lengths = np.empty(block + 1, dtype=np.uint32)
        self.lengths[0] = _ONES
        for n in range(1, block + 1):
            self.lengths[n] = self._zero(self.lengths[n - 1:n], step)[0]
        # the step is linear: one table of 256 for each byte of the register
        self.jump = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
        for _ in range(block):
            self.jump = self._zero(self.jump, step)

    @staticmethod
    def _zero(register: np.ndarray, step: np.ndarray) -> np.ndarray:
        return (register >> np.uint32(8)) ^ step[register & np.uint32(255)]

    def _over_block(self, register: np.ndarray) -> np.ndarray:
        out = self.jump[0][register & np.uint32(255)]
        for k in range(1, 4):
            out = out ^ self.jump[k][(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def checksums(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """CRC-32 of the spans of ``data``; they may overlap, and none is empty."""
        slices = range(0, len(starts), _SPANS)
        return np.concatenate([self._some(data, starts[at:at + _SPANS], lengths[at:at + _SPANS]) for at in slices]
                              or [np.empty(0, dtype=np.uint32)])

    def _some(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        blocks = -(-lengths // self.block)
        head = lengths - (blocks - 1) * self.block
        # one entry per block: the first block of a span is the short one
        owner = np.repeat(np.arange(len(starts)), blocks)
        first = np.cumsum(blocks) - blocks
        nth = np.arange(len(owner)) - first[owner]
        size = np.where(nth == 0, head[owner], self.block)
        begin = starts[owner] + np.where(nth == 0, 0, head[owner] + (nth - 1) * self.block)
        folded = np.concatenate([self._folded(data, begin[at:at + _SPANS], size[at:at + _SPANS])
                                 for at in range(0, len(owner), _SPANS)])
        out = folded[first] ^ self.lengths[head]
        more, k = np.flatnonzero(blocks > 1), 1
        while len(more):
            out[more] = self._over_block(out[more]) ^ folded[first[more] + k]
            k += 1
            more = more[blocks[more] > k]
        return out ^ np.uint32(_ONES)

    def _folded(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The XOR of each block's contributions."""
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        distance = np.repeat(size, size) - 1 - inside
        return np.bitwise_xor.reduceat(self.table[distance, data[np.repeat(begin, size) + inside]], at)


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


_LOWER = _lowered()
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_TABLES: dict[int, PositionTable] = {}


def position_table(block: int = BLOCK) -> PositionTable:
    """The worker's table."""
    if block not in _TABLES:
        _TABLES[block] = PositionTable(block)
    return _TABLES[block]


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts joined by one space each, where they start, their
    lengths, and the text each is from."""
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)]
    word = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    lengths = ends - starts
    # a separator behind each word is taken along, and becomes the space
    kept = word.copy()
    kept[ends] = True
    data = np.where(word, data, np.uint8(32))[kept]
    return data, np.cumsum(lengths + 1) - lengths - 1, lengths, np.searchsorted(text_ends, starts, side="right")


def features(texts: list[bytes], most: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature of the texts, and each text's words."""
    data, starts, lengths, owner = words_of(texts)
    found, owners = [], []
    for n in range(1, most + 1):
        first = np.arange(max(0, len(starts) - n + 1))
        first = first[owner[first] == owner[first + n - 1]]
        last = first + n - 1
        found.append(position_table().checksums(data, starts[first], starts[last] + lengths[last] - starts[first]))
        owners.append(owner[first])
    return (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(owners), np.bincount(
        owner, minlength=len(texts))


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Where each part starts, and its texts as bytes."""
    at, held, size = 0, [], 0
    for k, t in enumerate(texts):
        text = (t.as_py() or "").encode()
        if held and size + len(text) > _PART:
            yield at, held
            at, held, size = k, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def bucket_counts(texts: DataFrame, most: int = 1, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket, over the one column of ``texts``."""
    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                total += np.bincount(features(part, most, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counts = [0] * buckets
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"]] = r["n"]
    return counts


def gains(source: list[int], target: list[int]) -> list[int]:
    """Each bucket's gain in thousandths, from its counts in both."""
    buckets, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000.0 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
            for s, t in zip(source, target, strict=True)]


def fit(docs: DataFrame, targets: DataFrame, text_col: str = "text", most: int = 1,
        buckets: int = BUCKETS) -> list[int]:
    """Gains of the buckets by all of ``docs`` and all of ``targets``; counts of
    all buckets are what reaches the driver."""
    return gains(*(bucket_counts(t.select(t[text_col].cast("string")), most, buckets) for t in (docs, targets)))


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text",
          most: int = 1) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every document."""
    def run(batches):
        value = np.array(gain, dtype=np.int64)
        for batch in batches:
            for at, part in _parts(batch.column(1)):
                bucket, owner, words = features(part, most, len(value))
                order = np.argsort(owner, kind="stable")
                n = np.bincount(owner, minlength=len(part))
                running = np.concatenate([[0], np.cumsum(value[bucket[order]])])
                ends = np.cumsum(n)
                yield pa.record_batch(
                    [batch.column(0).slice(at, len(part)), pa.array(words.astype(np.int64)), pa.array(n),
                     pa.array(running[ends] - running[ends - n])], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long")


def resample(weighed: DataFrame, seed: int = 2024, share: tuple[int, int] = (10, 100),
             least_words: int = 20) -> DataFrame:
    """``weighed`` with its score, and the rank of the drawn: of the N rows with
    ``least_words`` words the floor(N * share) of highest score, ties to the
    smaller id. Rows are ranked by a range-partitioned sort."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weighed.withColumn("score", (F.col("weight") + noise).cast("long")))
    fit_for = scored.filter(F.col("n_words") >= least_words)
    drawn = fit_for.count() * share[0] // share[1]
    # copies of a row go by their place, which splits them between sorted partitions
    ranked = dense_index(fit_for.withColumn("_place", F.monotonically_increasing_id()),
                         [F.desc("score"), F.asc_nulls_last("doc_id"), "_place"], "_index").drop("_place")
    rank = F.when(F.col("_index") < drawn, F.col("_index") + 1)
    rest = scored.filter(F.col("n_words") < least_words)
    return (ranked.withColumn("rank", rank.cast("long")).drop("_index")
            .unionByName(rest.withColumn("rank", F.lit(None).cast("long"))))
