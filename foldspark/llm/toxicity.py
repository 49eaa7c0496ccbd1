"""Toxicity scoring by a counterfactually regularised linear classifier.

A text's features are its lower-case words and their beginnings; the model sees
the logarithm of their counts. It is fitted on a bounded sample of labelled
rows (``FIT_ROWS``, those of lowest hash): Spark counts every feature of the
sample by label and keeps the ``FEATURES`` most telling ones, then a logistic
regression is trained in numpy on the sample's vectors.

In every sampled sentence that names a group, the group terms are swapped for
others of their category or for a neutral word. The training loss adds the mean
squared change of the sentence's score, so that a group's name by itself cannot
carry a score, however the labels are distributed over groups.

Rows: null text counts as empty and gets the score of a text without known
features. A null id is kept as it is; labels without an id, with a null label
or without a document are not used. Repeated rows are scanned each for itself,
and repeated labels count as often as they stand. An empty table gives no rows;
without labels of both kinds every score is the share of label 1 (0 if there
are no labels). All columns of the input stay, the score column is set anew."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foldspark.session import cut

# Labelled rows the classifier is fitted on, at most.
FIT_ROWS = 8_000
FEATURES = 1_024
# Lengths of the word beginnings that count as features.
BEGINNINGS = range(4, 9)
# Sampled documents a feature must be in.
LEAST_DOCS = 4
# Weight of the squared score changes, and of the squared weights.
SWAP_PENALTY, DECAY = 10.0, 1e-4
ROUNDS, RATE = 400, 0.05
# Characters of a document that are scanned at once.
_CHARS = 1 << 20

# Group terms by category; the first of each is the neutral word.
GROUPS = (
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("person", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "gay",
     "lesbian", "bisexual", "transgender", "straight", "black", "white", "asian", "latino", "african",
     "european", "american", "mexican", "chinese", "indian", "arab", "disabled", "blind", "deaf"),
    ("humans", "women", "men", "girls", "boys", "immigrants", "refugees", "foreigners"),
    ("human", "woman", "man", "girl", "boy", "immigrant", "refugee", "foreigner"),
    ("gens", "musulmans", "chrétiens", "juifs", "femmes", "hommes", "immigrés", "réfugiés", "noirs", "arabes"),
    ("menschen", "muslime", "christen", "juden", "frauen", "männer", "einwanderer", "flüchtlinge",
     "ausländer", "schwarze"),
    ("personas", "musulmanes", "cristianos", "judíos", "mujeres", "hombres", "inmigrantes", "refugiados",
     "negros", "árabes"),
)

_CATEGORY = {term: k for k, terms in enumerate(GROUPS) for term in terms}
_NAMED = re.compile(r"\b(?:" + "|".join(sorted(_CATEGORY, key=len, reverse=True)) + r")\b")
_SENTENCE = re.compile(r"[^.!?\n]+")
_NOT_WORD = re.compile(r"[\W_]+")


@dataclass(frozen=True)
class Model:
    """Weights by pattern: `` word `` for a whole word, `` begin`` for a beginning."""

    weights: tuple[tuple[str, float], ...]
    bias: float


def _plain(text: str) -> str:
    """Lower-case words with a space around each."""
    return f" {_NOT_WORD.sub(' ', text.lower()).strip()} "


def _patterns(plain: str) -> Counter:
    """All feature patterns of a text with their counts."""
    words = Counter(plain.split())
    out = Counter()
    for word, n in words.items():
        out[f" {word} "] += n
        for k in BEGINNINGS:
            if k < len(word):
                out[f" {word[:k]}"] += n
    return out


@lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, p in enumerate(patterns):
        found.add_word(p, k)
    found.make_automaton()
    return found


def _counts(plain: str, patterns: tuple[str, ...]) -> Counter:
    """Counts of the known patterns in a text, by their number."""
    return Counter(k for _, k in _automaton(patterns).iter(plain)) if patterns else Counter()


def swapped(sentence: str) -> list[str]:
    """The lower-case sentence with its group terms replaced: once by the next
    term of their category, and once by its neutral word."""
    def following(m):
        terms = GROUPS[_CATEGORY[m[0]]]
        return terms[(terms.index(m[0]) + 1) % len(terms)]
    sentence = sentence.lower()
    return [_NAMED.sub(following, sentence),
            _NAMED.sub(lambda m: GROUPS[_CATEGORY[m[0]]][0], sentence)]


def _feature_rows(batches):
    """Documents with each feature by label, summed over a task's batches."""
    for b in batches:
        seen = {False: Counter(), True: Counter()}
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[label].update(_patterns(_plain(text or "")).keys())
        names = sorted(seen[False] | seen[True])
        yield pa.record_batch([pa.array(names, pa.string()),
                               pa.array([seen[True][n] for n in names], pa.int64()),
                               pa.array([seen[False][n] for n in names], pa.int64())],
                              names=["pattern", "bad", "good"])


def _vector_rows(batches, patterns):
    for b in batches:
        found = [sorted(_counts(_plain(t or ""), patterns).items()) for t in b.column(0).to_pylist()]
        yield pa.record_batch([
            pa.array([[k for k, _ in f] for f in found], pa.list_(pa.int32())),
            pa.array([[n for _, n in f] for f in found], pa.list_(pa.int32())), b.column(1)],
            names=["at", "n", "label"])


def _swap_rows(batches, patterns):
    """Products of the feature changes of all swapped sentences."""
    for b in batches:
        total, swaps = Counter(), 0
        for text in b.column(0).to_pylist():
            for sentence in _SENTENCE.findall(text or ""):
                if not _NAMED.search(sentence.lower()):
                    continue
                before = _counts(_plain(sentence), patterns)
                for other in swapped(sentence):
                    after = _counts(_plain(other), patterns)
                    change = {k: d for k in before | after
                              if (d := math.log1p(after[k]) - math.log1p(before[k]))}
                    swaps += 1
                    for i, x in change.items():
                        for j, y in change.items():
                            total[i, j] += x * y
        keys = [(-1, -1), *sorted(total)]
        yield pa.record_batch([pa.array([i for i, _ in keys], pa.int32()),
                               pa.array([j for _, j in keys], pa.int32()),
                               pa.array([float(swaps), *(total[k] for k in keys[1:])], pa.float64())],
                              names=["i", "j", "v"])


def _telling(counts: DataFrame, docs: tuple[int, int], features: int) -> tuple[str, ...]:
    """The patterns whose presence tells most of the label (likelihood ratio)."""
    bad, good = docs

    def term(part, whole, share):
        return F.when(part > 0, part * F.log(part / (whole * share))).otherwise(0.0)

    share = (F.col("bad") + F.col("good")) / (bad + good)
    gain = (term(F.col("bad"), bad, share) + term(F.col("good"), good, share)
            + term(bad - F.col("bad"), bad, 1 - share) + term(good - F.col("good"), good, 1 - share))
    top = (counts.filter(F.col("bad") + F.col("good") >= LEAST_DOCS).withColumn("gain", F.round(gain, 9))
           .orderBy(F.desc("gain"), "pattern").limit(features).collect())
    return tuple(sorted(r["pattern"] for r in top))


def train(x: np.ndarray, y: np.ndarray, products: np.ndarray, penalty: float = SWAP_PENALTY,
          rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Logistic weights with the penalty ``w' products w``, by Adam."""
    w, bias = np.zeros(x.shape[1]), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30)))
        off = (p - y) / len(y)
        grad = np.append(x.T @ off + 2 * penalty * (products @ w) + 2 * DECAY * w, off.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        change = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - change[:-1], bias - change[-1]
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
        text_col: str = "text", fit_rows: int = FIT_ROWS, features: int = FEATURES,
        penalty: float = SWAP_PENALTY) -> Model:
    """A model from the labelled rows of lowest hash."""
    sample = (labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_bad"))
              .dropna().orderBy(F.xxhash64("_id"), "_id", "_bad").limit(fit_rows))
    # At most fit_rows pairs of an integer and a flag, so the broadcast is bounded.
    rows = cut(docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
               .join(F.broadcast(sample), "_id").select("_text", "_bad"))
    sizes = {r["_bad"]: r["n"] for r in rows.groupBy("_bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        return Model((), 30.0 if bad else -30.0)
    counts = (rows.mapInArrow(_feature_rows, "pattern string, bad long, good long")
              .groupBy("pattern").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")))
    patterns = _telling(counts, (bad, good), features)
    vectors = rows.mapInArrow(lambda b: _vector_rows(b, patterns),
                              "at array<int>, n array<int>, label boolean").collect()
    x = np.zeros((len(vectors), len(patterns)), dtype=np.float32)
    for k, row in enumerate(vectors):
        x[k, row["at"]] = np.log1p(row["n"])
    y = np.array([float(row["label"]) for row in vectors])
    products, swaps = np.zeros((len(patterns),) * 2), 0.0
    for r in (rows.mapInArrow(lambda b: _swap_rows(b, patterns), "i int, j int, v double")
              .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()):
        if r["i"] < 0:
            swaps = r["v"]
        else:
            products[r["i"], r["j"]] = r["v"]
    w, bias = train(x, y, products / max(swaps, 1.0), penalty)
    return Model(tuple((p, float(v)) for p, v in zip(patterns, w, strict=True)), bias)


def score_text(text: str | None, patterns: tuple[str, ...], weights: np.ndarray, bias: float) -> float:
    total: Counter = Counter()
    text = text or ""
    at = 0
    while at < len(text):  # parts end at white space, so no word is cut
        end = min(at + _CHARS, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        total.update(_counts(_plain(text[at:end]), patterns))
        at = end
    logit = bias + sum(weights[k] * math.log1p(n) for k, n in sorted(total.items()))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def score(model: Model, text: Column) -> Column:
    """The score of each whole text, 0 to 1."""
    patterns = tuple(p for p, _ in model.weights)
    values = np.array([w for _, w in model.weights])
    bias = model.bias

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([score_text(t.as_py(), patterns, values, bias) for t in texts], pa.float64())
    return scored(text.cast("string"))


def with_score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    return docs.withColumn(name, score(model, docs[text_col]))
