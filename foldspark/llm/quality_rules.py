"""Quality filtering by a learned decision list, in DataFrame functions only.

``statistics`` derives counts and shares from each whole text. ``learn`` grows
threshold conjunctions by sequential covering: a rule takes, one at a time, the
condition of highest information gain over the growing rows not yet covered, is
pruned on the other rows, and is kept while it stays precise there. The counts
behind each choice are one aggregation over ``(feature, bucket)``; only these
histograms, of a size set by the number of features and thresholds, reach the
driver. ``rejects`` states the list as one ordered Spark conditional.

Rules are fitted on a bounded sample of labelled rows (``FIT_ROWS``, those of
lowest hash); statistics and verdicts cover all rows.

Rows: null text has no words; it and every text without words has zero for all
counts and shares. A null id is kept as it is, and labels without an id, with
a null label or without a document are not used. Repeated rows are judged each
for itself. An empty table gives no rows, and without labels of both kinds the
list is empty and rejects nothing. All columns of the input stay, but ``stats``
is set anew."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.session import cut

# Labelled rows the rules are fitted on, at most.
FIT_ROWS = 20_000
# Thresholds per feature: this many quantiles of the rejected rows, and of the others.
QUANTILES = 24
MAX_CONDITIONS = 4
MAX_RULES = 16
# Share of rejected rows a rule must reach among the pruning rows it covers.
PRECISION = 0.99
# Rows of a covering step's positives below which learning ends.
LEAST_COVER = 5
PRUNE_PART = 3  # one row in so many prunes, the others grow
# A document with fewer words, or a larger percentage of repeated ones, fails.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("words", "word_length", "symbols_per_word", "duplicate_lines", "repeated_words",
            "upper_share", "exclaims_per_word", "distinct_words")


def _coverage(positions: Column) -> Column:
    """Words in the three-word windows that start at the sorted positions."""
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(positions, start, lambda acc, p: F.struct(
        (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats``: the counts of each whole text, and a double for
    each of ``FEATURES``.

    Windows are compared by a 64-bit hash of their words, so that two of a
    text's n windows are taken for equal with a chance of n squared over 2^65."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    keep = docs.columns
    out = docs.drop("stats").withColumn("_text", text)
    keep = [c for c in out.columns if c != "_text"]
    out = out.withColumn("_words", F.array_remove(F.split("_text", _SPACE), ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_n", F.size("_words"))
    hashes = F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    out = out.withColumn("_windows", F.slice(hashes, F.lit(1), F.greatest(F.col("_n") - 2, F.lit(0))))
    # Most texts repeat nothing; only the others are sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeats, F.sort_array(
        F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    out = out.withColumn("_again", F.sort_array(F.transform(F.filter(
        "_sorted", lambda x, k: (x["h"] == F.get("_sorted", k - 1)["h"])
        | (x["h"] == F.get("_sorted", k + 1)["h"])), lambda x: x["i"])))
    out = out.withColumn("_repeated", F.coalesce(_coverage(F.col("_again")), F.lit(0)))

    def count(pattern):
        return F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))

    out = out.select(
        *keep, F.col("_n").alias("_w"), F.col("_repeated").alias("_r"),
        F.length(F.array_join("_words", "")).alias("_c"), count(r"[#*$%&|<>]").alias("_s"),
        F.size("_lines").alias("_l"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("_d"),
        count(r"\p{Lu}").alias("_u"), count("!").alias("_e"),
        F.size(F.array_distinct("_words")).alias("_v"))

    def per(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0).cast("double")

    return out.select(*keep, F.struct(
        *(F.col(c).cast("long").alias(n) for c, n in (
            ("_w", "n_words"), ("_c", "word_chars"), ("_s", "n_symbols"), ("_d", "n_dup_lines"),
            ("_r", "n_repeat_words"))),
        F.col("_w").cast("double").alias("words"), per("_c", "_w").alias("word_length"),
        per("_s", "_w").alias("symbols_per_word"), per("_d", "_l").alias("duplicate_lines"),
        per("_r", "_w").alias("repeated_words"), per("_u", "_c").alias("upper_share"),
        per("_e", "_w").alias("exclaims_per_word"), per("_v", "_w").alias("distinct_words")).alias("stats"))


def base_failed() -> Column:
    """Too few words, or too large a part of them repeated."""
    n = F.col("stats.n_words")
    return (n < LEAST_WORDS) | (100 * F.col("stats.n_repeat_words") > MOST_REPEATED * n)


@dataclass(frozen=True)
class Condition:
    """``feature > threshold``, or ``<=`` where ``above`` is false."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"stats.{self.feature}")
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def rejects(rules: list[Rule]) -> Column:
    """Number (from 1) of the first rule that holds, null if none does."""
    out = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_all(rule), F.lit(k)).otherwise(out)
    return out


def _thresholds(rows: DataFrame) -> dict[str, list[float]]:
    """Quantiles of each feature among the rejected and among the other rows."""
    at = F.array(*(F.lit((k + 0.5) / QUANTILES) for k in range(QUANTILES)))
    found = rows.groupBy("_bad").agg(
        *(F.percentile_approx(f"stats.{f}", at, F.lit(1000)).alias(f) for f in FEATURES)).collect()
    return {f: sorted({t for row in found for t in row[f] or ()}) for f in FEATURES}


def _histogram(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[tuple[str, int, bool], int]:
    """Rows by feature, number of thresholds below the value, and class."""
    def below(f):
        return F.size(F.filter(F.array(*map(F.lit, thresholds[f])), lambda t: t < F.col(f"stats.{f}")))

    entries = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), below(f).alias("b")) for f in FEATURES)))
    counts = (rows.select("_bad", entries.alias("e")).groupBy("e.f", "e.b", "_bad")
              .agg(F.count(F.lit(1)).alias("n")).collect())
    return {(r["f"], r["b"], r["_bad"]): r["n"] for r in counts}


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best(histogram, thresholds, p0: int, n0: int) -> Condition | None:
    """The condition of highest gain; of equal ones the first in order."""
    best, most = None, 1e-9
    for f in FEATURES:
        below = [0, 0]
        for k, t in enumerate(thresholds[f]):
            for bad in (False, True):
                below[bad] += histogram.get((f, k, bad), 0)
            for above, p, n in ((True, p0 - below[1], n0 - below[0]), (False, below[1], below[0])):
                if p and (gain := _gain(p, n, p0, n0)) > most:
                    best, most = Condition(f, above, t), gain
    return best


def _grow(rows: DataFrame, thresholds) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        histogram = _histogram(rows, thresholds)
        p0, n0 = (sum(n for (f, _, b), n in histogram.items() if f == FEATURES[0] and b == bad)
                  for bad in (True, False))
        if not rule and p0 < LEAST_COVER or not n0 or not (found := _best(histogram, thresholds, p0, n0)):
            break
        rule, rows = (*rule, found), rows.filter(found.column())
    return rule


def _prune(rule: Rule, rows: DataFrame) -> tuple[Rule, float]:
    """The prefix that separates the pruning rows best, and its precision."""
    counts = rows.agg(*(F.coalesce(F.sum(F.when(_all(rule[:k]) & (F.col("_bad") == bad), 1)), F.lit(0))
                        .alias(f"c{k}{bad:d}") for k in range(1, len(rule) + 1) for bad in (True, False))).first()
    best, most, precision = rule, -2.0, 0.0
    for k in range(len(rule), 0, -1):
        p, n = counts[f"c{k}1"], counts[f"c{k}0"]
        if p + n and (p - n) / (p + n) >= most:
            best, most, precision = rule[:k], (p - n) / (p + n), p / (p + n)
    return best, precision


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules that reject documents like those labelled 0, in order."""
    sample = (labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad"))
              .dropna().orderBy(F.xxhash64("_id"), "_id", "_bad").limit(fit_rows))
    # At most fit_rows pairs of an integer and a flag, so the broadcast is bounded.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(F.broadcast(sample), "_id")
    rows = cut(statistics(texts, text_col).select("_id", "_bad", "stats"))
    thresholds = _thresholds(rows)
    prune = F.pmod(F.xxhash64("_id", F.lit("prune")), F.lit(PRUNE_PART)) == 0
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        left = rows.filter(rejects(rules).isNull())
        rule = _grow(left.filter(~prune), thresholds)
        if not rule:
            break
        rule, precision = _prune(rule, left.filter(prune))
        if precision < PRECISION:
            break
        rules.append(rule)
    return rules


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with ``stats``, ``base_failed``, ``rule`` (the first that
    rejects it, else null) and ``kept``."""
    out = statistics(docs.drop("base_failed", "rule", "kept"), text_col)
    return (out.withColumn("base_failed", base_failed()).withColumn("rule", rejects(rules))
            .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()))
