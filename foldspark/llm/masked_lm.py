"""Document scores by masked pseudo-likelihood.

A small bidirectional network predicts every word from the ``WINDOW`` words on
either side; a document's score is the sum of the log probabilities it gives to
each of its words. Whole words are counted over all documents in a table that
grows with them. A word's probability is that of its class, from the network,
times its share of the class's occurrences; the ``SINGLE_CLASSES`` most frequent
words are classes of their own, the rest fill classes of falling frequency and
about equal mass. The network sees a word as its symbol: its own one for the
``SINGLE_SYMBOLS`` most frequent, else one shared by words of like frequency.
Words that the counted documents lack are one explicit unknown word.

Work runs in parts of about ``PART_BYTES`` of consecutive documents: a part numbers
its words, its distinct words meet the counts in a join, and the numbers turn
into symbols inside the part. Training is data-parallel over all documents and
all words: in each of ``ROUNDS`` rounds the tasks start from the same weights,
descend on every word of the round's documents (each belongs to one round), and
Spark averages the weights, weighted by words. What reaches the driver has a
fixed size: the most frequent words, sums by frequency band and symbol, and the
weights. The weights depend on how the input is split into tasks; the same split
gives the same weights.

Rows: null text counts as empty; a text without words has no words, a sum of 0
and a null mean. A null id is kept as it is; repeated rows count, train and are
scored each for itself; an empty table gives no rows. Columns besides id and
text are not read."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.session import Rounds, cut

# Predicted classes and context symbols; of each, the first part are single words.
CLASSES, SINGLE_CLASSES = 128, 96
SYMBOLS, SINGLE_SYMBOLS = 1024, 768
# The last two symbols: words not counted, and places beyond the text.
UNKNOWN, EDGE = SYMBOLS - 2, SYMBOLS - 1
WINDOW, WIDTH = 3, 32
ROUNDS = 2
BATCH, RATE, SEED = 2048, 0.01, 7
# Text bytes of a part, and distinct words at which it ends too.
PART_BYTES, PART_WORDS = 16 << 20, 1 << 19
# Words whose predictions are held at once.
_WORDS = 1 << 11
_OFFSETS = np.array([o for o in range(-WINDOW, WINDOW + 1) if o])
_GROUPS = UNKNOWN - SINGLE_SYMBOLS
# Frequency bands to a doubling.
_BANDS = 8
_PARTS = "part long, doc_id long, ids binary, place int, word binary, n long"
_ENCODED = "doc_id long, symbols binary, inside double"


class _Numbers(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 between ASCII white space, lower-cased in A-Z."""
    return (text or b"").lower().split()


def pack(ids: np.ndarray) -> bytes:
    """Lower halves of the numbers, then the upper ones, which compress well."""
    return np.concatenate([ids & 0xFFFF, ids >> 16]).astype(np.uint16).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    low, high = np.frombuffer(packed, np.uint16).reshape(2, -1).astype(np.uint32)
    return high << 16 | low


def _part_rows(batches):
    """Document rows (word numbers) and, after a part's documents, its word rows."""
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
    names = ["part", "doc_id", "ids", "place", "word", "n"]

    def rows(*columns):
        size = max(len(c) for c in columns if c is not None)
        return pa.record_batch([pa.nulls(size, t) if c is None else pa.array(c, t)
                                for c, t in zip(columns, types, strict=True)], names=names)

    def vocabulary():
        words = list(numbers)
        for lo in range(0, len(words), 1 << 16):
            some = words[lo:lo + (1 << 16)]
            yield rows([part] * len(some), None, None, np.arange(lo, lo + len(some)), some,
                       tally[lo:lo + len(some)])

    part = TaskContext.get().partitionId() << 32
    numbers, tally, size = _Numbers(), np.zeros(0, np.int64), 0
    for b in batches:
        ids, held = [], []

        def documents():
            grown = np.bincount(np.concatenate(held), minlength=len(numbers))
            grown[:len(tally)] += tally
            return grown, rows([part] * len(ids), ids, [pack(x) for x in held], None, None, None)

        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            text = text.as_py()
            ids.append(doc_id)
            held.append(np.fromiter(map(numbers.__getitem__, words_of(text)), np.uint32))
            size += len(text or b"")
            if size >= PART_BYTES or len(numbers) >= PART_WORDS:
                tally, out = documents()
                yield out
                yield from vocabulary()
                part, numbers, tally, size, ids, held = part + 1, _Numbers(), np.zeros(0, np.int64), 0, [], []
        if ids:
            tally, out = documents()
            yield out
    yield from vocabulary()


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as word numbers of their part, and every part's distinct words."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")
                       ).mapInArrow(_part_rows, _PARTS)


@dataclass
class Vocabulary:
    """``table(word, n, symbol)`` of every counted word; class by symbol and the
    log of its class's occurrences by symbol."""

    table: DataFrame
    classes: np.ndarray
    log_mass: np.ndarray


def classes_of(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and log class mass by symbol, from the symbols' occurrences; the
    unknown word counts once."""
    mass = mass.astype(float)
    mass[UNKNOWN] = 1.0
    classes = np.arange(SYMBOLS)
    rest = mass[SINGLE_CLASSES:]
    middle = (np.cumsum(rest) - rest / 2) / rest.sum()
    wide = CLASSES - SINGLE_CLASSES
    classes[SINGLE_CLASSES:] = SINGLE_CLASSES + np.minimum((middle * wide).astype(int), wide - 1)
    total = np.bincount(classes, mass, CLASSES)
    return classes, np.log(np.maximum(total, 1.0))[classes]


def vocabulary(parts: DataFrame, kept: Rounds) -> Vocabulary:
    """Counts, symbols and classes of all words of ``parts``."""
    spark = parts.sparkSession
    counts = kept.keep("counts", parts.filter(F.col("word").isNotNull()).groupBy("word")
                       .agg(F.sum("n").alias("n")))
    # SINGLE_SYMBOLS rows, one row a band and one a symbol reach the driver.
    top = counts.orderBy(F.desc("n"), "word").limit(SINGLE_SYMBOLS).collect()
    single = spark.createDataFrame([(r["word"], k) for k, r in enumerate(top)], "word binary, single int")
    table = counts.join(F.broadcast(single), "word", "left").withColumn(
        "band", F.floor(F.log2("n") * _BANDS).cast("int"))
    bands = (table.filter("single IS NULL").groupBy("band").agg(F.sum("n").alias("mass"))
             .orderBy(F.desc("band")).collect())
    masses = np.array([r["mass"] for r in bands], dtype=float)
    total = max(1.0, masses.sum())
    # Words of a band lie on its stretch of the mass axis, spread by their hash.
    lies = spark.createDataFrame([(r["band"], float(a / total), float(m / total)) for r, a, m in
                                  zip(bands, np.cumsum(masses) - masses, masses, strict=True)],
                                 "band int, above double, share double")
    spread = F.pmod(F.xxhash64("word"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    group = F.least(F.floor((F.col("above") + F.col("share") * spread) * _GROUPS), F.lit(_GROUPS - 1))
    table = table.join(F.broadcast(lies), "band", "left").select(
        "word", "n", F.coalesce("single", (group + SINGLE_SYMBOLS).cast("int")).cast("short").alias("symbol"))
    mass = np.zeros(SYMBOLS)
    for r in table.groupBy("symbol").agg(F.sum("n").alias("n")).collect():
        mass[r["symbol"]] = r["n"]
    return Vocabulary(table, *classes_of(mass))


def encode(parts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``(doc_id, symbols, inside)``: 16-bit symbols of all words and the sum of
    the logs of the words' shares of their classes."""
    log_mass = vocab.log_mass

    def encoded(docs: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        symbol, inside = np.empty(len(place), np.uint16), np.empty(len(place))
        symbol[place] = own = words.column("symbol").to_numpy()
        inside[place] = np.log(words.column("n").to_numpy()) - log_mass[own]
        held = [unpack(x.as_py()) for x in docs.column("ids")]
        return pa.table([docs.column("doc_id"), pa.array([symbol[x].tobytes() for x in held], pa.binary()),
                         pa.array([float(inside[x].sum()) for x in held], pa.float64())],
                        names=["doc_id", "symbols", "inside"])

    words = (parts.filter(F.col("word").isNotNull()).select(F.col("part").alias("of"), "place", "word")
             .join(vocab.table, "word", "left")
             .select("of", "place", F.coalesce("symbol", F.lit(UNKNOWN).cast("short")).alias("symbol"),
                     F.coalesce("n", F.lit(1)).alias("n")))
    docs = parts.filter(F.col("ids").isNotNull()).select("part", "doc_id", "ids")
    return docs.groupBy("part").cogroup(words.groupBy("of")).applyInArrow(encoded, _ENCODED)


_SHAPES = {"embed": (SYMBOLS, WIDTH), "place": (2 * WINDOW, WIDTH), "hidden": (WIDTH,),
           "out": (WIDTH, CLASSES), "bias": (CLASSES,)}
PARAMETERS = sum(int(np.prod(s)) for s in _SHAPES.values())


class Network:
    """Place-weighted sum of context embeddings, tanh, softmax over classes."""

    def __init__(self, flat: np.ndarray | None = None):
        if flat is None:
            random = np.random.default_rng(SEED)
            flat = random.normal(0, 0.1, PARAMETERS).astype(np.float32)
        self.flat = flat.astype(np.float32).copy()
        at = 0
        for name, shape in _SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + size].reshape(shape))
            at += size

    def seen(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of all places and hidden values of the places ``at``, which
        have ``WINDOW`` places on either side."""
        embedded, inner = self.embed[padded], len(padded) - 2 * WINDOW
        total = np.tile(self.hidden, (inner, 1))
        for k, o in enumerate(_OFFSETS):
            total += embedded[WINDOW + o:WINDOW + o + inner] * (1 + self.place[k])
        return embedded, np.tanh(total[at - WINDOW])

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """``(CLASSES, n)`` logits, the largest of a place being 0."""
        out = self.out.T @ hidden.T
        out += self.bias[:, None]
        out -= out.max(axis=0)
        return out

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the classes ``target`` at the places ``at``."""
        logits = self.logits(self.seen(padded, at)[1])
        found = logits[target, np.arange(len(target))]
        return found - np.log(np.exp(logits, out=logits).sum(axis=0))

    def gradient(self, padded: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean negative log probability."""
        embedded, hidden = self.seen(padded, at)
        off = self.logits(hidden)
        np.exp(off, out=off)
        off /= off.sum(axis=0)
        off[target, np.arange(len(target))] -= 1
        grad, share = Network(np.zeros(PARAMETERS)), np.float32(1 / len(target))
        grad.out[:] = (off @ hidden).T * share
        grad.bias[:] = off.sum(axis=1) * share
        back = (off.T @ (self.out.T * share)) * (1 - hidden * hidden)
        grad.hidden[:] = back.sum(axis=0)
        # What a place gets back as a neighbour is a sum of shifts; places of
        # equal symbols then stand together and are added up.
        inner = len(padded) - 2 * WINDOW
        wide, spread = np.zeros((inner, WIDTH), np.float32), np.zeros_like(embedded)
        wide[at - WINDOW] = back
        for k, o in enumerate(_OFFSETS):
            near = slice(WINDOW + o, WINDOW + o + inner)
            grad.place[k] = np.einsum("ij,ij->j", embedded[near], wide)
            spread[near] += wide * (1 + self.place[k])
        order = np.argsort(padded, kind="stable")
        held = padded[order]
        starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        grad.embed[held[starts]] = np.add.reduceat(spread[order], starts, axis=0)
        return grad.flat


def windows(texts: list[np.ndarray], size: int):
    """``(padded, at)`` of all words of the texts in order, in slices of equal
    numbers of words, at most ``size``: symbols with ``EDGE`` around texts, and
    the places of the slice's words among them."""
    gap = np.full(WINDOW, EDGE, np.uint16)
    padded = np.concatenate([x for t in texts for x in (gap, t)] + [gap])
    starts = np.cumsum([0] + [len(t) for t in texts])
    total = int(starts[-1])
    slices = -(-total // size)
    for k in range(slices):
        at = np.arange(total * k // slices, total * (k + 1) // slices)
        at += WINDOW * np.searchsorted(starts, at, side="right")
        low = at[0] - WINDOW
        yield padded[low:at[-1] + WINDOW + 1], at - low


def descend(flat: np.ndarray, examples, rate: float = RATE) -> tuple[np.ndarray, int]:
    """Weights after one pass of Adam over ``(padded, at, target)`` batches, and
    the number of words seen."""
    net, seen, step = Network(flat), 0, 0
    first, second = np.zeros(PARAMETERS, np.float32), np.zeros(PARAMETERS, np.float32)
    for padded, at, target in examples:
        step += 1
        grad = net.gradient(padded, at, target)
        first += 0.1 * (grad - first)
        second += 0.001 * (grad * grad - second)
        net.flat -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-7)
        seen += len(target)
    return net.flat, seen


def _symbols(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in column]


def _weight_rows(batches, flat, classes):
    examples = ((padded, at, classes[padded[at]]) for b in batches if b.num_rows
                for padded, at in windows(_symbols(b.column(0)), BATCH))
    trained, seen = descend(flat.value, examples)
    if seen:
        yield pa.record_batch([pa.array(np.arange(PARAMETERS), pa.int32()),
                               pa.array(trained.astype(np.float64) * seen),
                               pa.array(np.full(PARAMETERS, float(seen)))], names=["k", "v", "w"])


def train(encoded: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Network weights from every word of all encoded documents."""
    context, flat = encoded.sparkSession.sparkContext, Network().flat
    turn = F.pmod(F.xxhash64("symbols"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        start = context.broadcast(flat)
        # At most PARAMETERS rows reach the driver.
        rows = (encoded.filter(turn == k).select("symbols").mapInArrow(
            partial(_weight_rows, flat=start, classes=classes), "k int, v double, w double")
            .groupBy("k").agg((F.sum("v") / F.sum("w")).alias("v")).collect())
        if rows:
            flat = np.empty(PARAMETERS, np.float32)
            flat[[r["k"] for r in rows]] = [r["v"] for r in rows]
    return flat


def _score_rows(batches, classes, flat):
    net = Network(flat.value)
    for b in batches:
        if not b.num_rows:
            continue
        texts = _symbols(b.column(1))
        # One more place, so that an empty text at the end has a start.
        logs, done = np.zeros(sum(map(len, texts)) + 1), 0
        for padded, at in windows(texts, _WORDS):
            logs[done:done + len(at)] = net.log_probabilities(padded, at, classes[padded[at]])
            done += len(at)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        sums = np.where(sizes > 0, np.add.reduceat(logs, starts) + b.column(2).to_numpy(), 0.0).round(6)
        yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()),
                               pa.array(sums / np.maximum(sizes, 1), pa.float64(), mask=sizes == 0)],
                              names=["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])


def rate(encoded: DataFrame, classes: np.ndarray, flat: np.ndarray) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, mean_log_likelihood)`` of encoded documents."""
    weights = encoded.sparkSession.sparkContext.broadcast(flat)
    return encoded.mapInArrow(partial(_score_rows, classes=classes, flat=weights),
                              "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")


def fit(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary and network weights from all documents."""
    kept = Rounds(docs.sparkSession)
    parts = kept.keep("parts", numbered(docs.withColumn("_id", F.lit(0)), "_id", text_col))
    vocab = vocabulary(parts, kept)
    flat = train(kept.keep("encoded", encode(parts, vocab)), vocab.classes)
    vocab.table = kept.result(vocab.table)
    return vocab, flat


def score(docs: DataFrame, vocab: Vocabulary, flat: np.ndarray, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """Scores of documents, those of the fit or others."""
    parts = cut(numbered(docs, id_col, text_col))
    return rate(encode(parts, vocab), vocab.classes, flat)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of the documents under a model of the same documents; their words
    are numbered and encoded once."""
    kept = Rounds(docs.sparkSession)
    parts = kept.keep("parts", numbered(docs, id_col, text_col))
    vocab = vocabulary(parts, kept)
    encoded = cut(encode(parts, vocab))
    kept.clear()
    return rate(encoded, vocab.classes, train(encoded, vocab.classes))
