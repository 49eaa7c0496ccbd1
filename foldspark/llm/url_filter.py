"""URL verdicts by host rules and, where no rule fits, by segmented words.

Hosts and paths are cut at anything but letters; each run of letters is split
into words by the most probable sequence under a unigram model (Viterbi). The
model counts the words of all page titles, of hyphened host labels and of path
names of several words, and path names of one run that ``COMMON_HOSTS`` hosts or
more share, so it grows with the pages and a concatenated name doesn't vouch for
itself. Substrings of the distinct runs meet these counts in a join; no
vocabulary is broadcast.

The words of hosts and paths then feed a multinomial naive Bayes model. Its
labelled examples are the URLs that a rule judges. Both classes are mixed with
the words of all URLs (``ALL_SHARE``), of which the blocked class gives a part
(``SEED_PART``) to the seed words. These shares are relative, so that the model
does not depend on the number of pages. Few URLs are to be blocked
(``BLOCKED_PRIOR``), so weak evidence does not block. Counting and scoring work
on distinct hosts and distinct paths with their numbers masked, and scores are
joined back to the pages.

Rows: a null URL, or one without ``://``, has empty host and path and no words,
which the method allows, as it allows any tie. A null page id is kept as it is;
repeated rows are judged each for itself; an empty table gives no rows. Without
URLs that a rule judges only the seed words count. Columns besides id, URL and
html are not read."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from foldspark.session import cut

LONGEST_WORD = 20
# No host label is longer; longer runs of letters are cut into parts of this length.
LONGEST_LABEL = 63
ALL_SHARE, SEED_PART = 0.8, 0.3
SMOOTHING = 20.0
# A path name of one run is a word if this many hosts have it.
COMMON_HOSTS = 3
# Share of URLs to be blocked, before any word is seen.
BLOCKED_PRIOR = 0.4

# Words of unwanted hosts (gambling, drugs, adult, advertising, fraud).
SEEDS = ("ads", "adult", "banner", "bet", "bets", "betting", "bonus", "casino", "cheap", "click", "credit",
         "escort", "free", "jackpot", "loan", "loans", "malware", "nude", "payday", "pharmacy", "pills",
         "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "tracking", "viagra", "warez",
         "win", "xxx")


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, below a path."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next of ``/?#``, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Number of the longest rule that fits, null if none does; of equally long
    ones the first."""
    out = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name), k))
    for k in reversed(order):
        r = rules[k]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), number) if values else F.lit(None).cast("string")


def _short(runs: Column) -> Column:
    """Runs with those longer than a label cut."""
    return F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(r) - 1) / LONGEST_LABEL).cast("int")),
        lambda k: F.substring(r, k * LONGEST_LABEL + 1, F.lit(LONGEST_LABEL)))))


def _parts(text: Column) -> Column:
    """Runs of letters, lower-case; longer ones than a label are cut."""
    return _short(F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), ""))


def path_tokens(path: Column) -> Column:
    """Words and masked numbers of a path."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(path), r"\p{N}+", "0"), r"[^\p{L}0]+"), "")


def word_counts(pages: DataFrame, url: str, html: str | None) -> DataFrame:
    """``(word, n)`` over titles, hyphened labels and the names in paths."""
    link = F.col(url)
    hyphened = F.filter(F.split(host_of(link), r"\."), lambda x: x.contains("-"))
    names = F.split(path_of(link), "/")
    several = F.filter(names, lambda x: F.size(_parts(x)) > 1)
    sources = [_parts(F.array_join(hyphened, " ")), _parts(F.array_join(several, " "))]
    if html is not None:
        sources.append(_parts(F.regexp_extract(F.col(html), r"(?is)<title[^>]*>(.*?)</title", 1)))
    words = pages.select(F.explode(F.concat(*(F.coalesce(s, F.array().cast("array<string>"))
                                              for s in sources))).alias("word"))
    alone = F.filter(names, lambda x: F.size(_parts(x)) == 1)
    shared = (pages.select(host_of(link).alias("host"), F.explode(_parts(F.array_join(alone, "/"))).alias("word"))
              .groupBy("word", "host").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts")))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(shared.filter(F.col("hosts") >= COMMON_HOSTS).drop("hosts"))
            .filter(F.length("word") <= LONGEST_WORD).groupBy("word").agg(F.sum("n").alias("n")))


def split_words(run: str, counts: dict[str, int], total: int) -> list[str]:
    """The most probable words that make up ``run``; of equal ones the split
    whose last word is longest. Unknown words cost ten times more per letter."""
    best = [0.0] + [-math.inf] * len(run)
    start = [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        for at in range(max(0, end - LONGEST_WORD), end):
            n = counts.get(run[at:end])
            cost = math.log(n / total) if n else math.log(10 / total) - (end - at) * math.log(10)
            if best[at] + cost > best[end]:
                best[end], start[end] = best[at] + cost, at
    out, end = [], len(run)
    while end:
        out.append(run[start[end]:end])
        end = start[end]
    return out[::-1]


def segment(runs: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``(run, words)`` of distinct runs of at most ``LONGEST_LABEL`` letters."""
    length = F.length("run")
    pieces = runs.select("run", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), length), lambda at: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), length - at + 1)),
            lambda n: F.substring("run", at, n)))))).alias("word"))
    # A run has at most LONGEST_LABEL * LONGEST_WORD substrings, so its group is bounded.
    known = pieces.join(counts, "word", "left").groupBy("run").agg(
        F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("known"))

    @F.arrow_udf(ArrayType(StringType()))
    def split(run: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([split_words(r, {k["word"]: k["n"] for k in f}, total) for r, f in
                         zip(run.to_pylist(), found.to_pylist(), strict=True)], pa.list_(pa.string()))
    return known.select("run", split("run", "known").alias("words"))


def run_words(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """``(run, words)`` of distinct runs; each seed counts as a word of usual frequency."""
    seeds = runs.sparkSession.createDataFrame([(s,) for s in SEEDS], "word string")
    average = counts.agg(F.sum("n").alias("s"), F.avg("n").alias("a")).first()
    usual = max(1, round(average["a"] or 1))
    total = (average["s"] or 0) + usual * len(SEEDS)
    counts = (counts.unionByName(seeds.withColumn("n", F.lit(usual).cast("long")))
              .groupBy("word").agg(F.sum("n").alias("n")))
    return segment(runs, counts, total)


def _odds(tokens: DataFrame) -> DataFrame:
    """``(token, odds)``: log of a word's probability in blocked over allowed."""
    counts = cut(tokens.groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "allowed"))))
    sums = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "blocked", "allowed")),
                      F.count(F.lit(1)).alias("size")).first()

    # Each class starts from the words of all URLs, as so many words of its own.
    overall = (F.col("n") + 0.5) / (sums["n"] + 0.5 * (sums["size"] + 1))

    def share(column):
        return (F.col(column) + SMOOTHING * overall) / (sums[column] + SMOOTHING)

    seed = F.when(F.col("token").isin(*SEEDS), 1.0 / len(SEEDS)).otherwise(0.0)
    blocked = (1 - ALL_SHARE) * share("blocked") + ALL_SHARE * (
        SEED_PART * seed + (1 - SEED_PART) * overall)
    allowed = (1 - ALL_SHARE) * share("allowed") + ALL_SHARE * overall
    return counts.select("token", F.log(blocked / allowed).alias("odds"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
          html_col: str | None = "html") -> DataFrame:
    """``(page_id, host, path, rule, verdict, odds)`` of every page; ``odds`` is
    the method's log odds for blocking, whether or not a rule fits."""
    url = F.col(url_col)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    judged = judged.withColumn("number", fitting_rule(rules, F.col("host"), F.col("path")))
    action = _pick([r.action for r in rules], F.col("number"))
    judged = judged.withColumn("shape", F.array_join(path_tokens(F.col("path")), "/"))
    tallies = (F.count(F.lit(1)).alias("n"), F.count(F.when(action == "block", 1)).alias("blocked"),
               F.count(F.when(action == "allow", 1)).alias("allowed"))
    hosts = cut(judged.groupBy("host").agg(*tallies))
    shapes = cut(judged.groupBy("shape").agg(*tallies))
    counts = cut(word_counts(pages, url_col, html_col))
    host_runs = hosts.select("host", F.explode(_parts(F.col("host"))).alias("run"))
    # a masked number is a run of its own
    shape_runs = shapes.select("shape", F.explode(_short(
        F.regexp_extract_all("shape", F.lit(r"(\p{L}+|0)"), F.lit(1)))).alias("run"))
    words = cut(run_words(host_runs.select("run").union(shape_runs.select("run")).distinct(), counts))
    of_host = cut(host_runs.join(words, "run").select("host", F.explode("words").alias("token")))
    of_shape = cut(shape_runs.join(words, "run").select("shape", F.explode("words").alias("token")))
    sums = ("token", "n", "blocked", "allowed")
    odds = cut(_odds(of_host.join(hosts, "host").select(*sums)
                     .unionByName(of_shape.join(shapes, "shape").select(*sums))))
    by_host = of_host.join(odds, "token").groupBy("host").agg(F.sum("odds").alias("host_odds"))
    by_shape = of_shape.join(odds, "token").groupBy("shape").agg(F.sum("odds").alias("path_odds"))
    prior = F.lit(math.log(BLOCKED_PRIOR / (1 - BLOCKED_PRIOR)))
    total = F.round(prior + F.coalesce("host_odds", F.lit(0.0)) + F.coalesce("path_odds", F.lit(0.0)), 9)
    return (judged.join(by_host, "host", "left").join(by_shape, "shape", "left")
            .withColumn("odds", total)
            .select("page_id", "host", "path", _pick([r.name for r in rules], F.col("number")).alias("rule"),
                    F.coalesce(action, F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"),
                    "odds"))
