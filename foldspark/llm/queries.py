"""Registered queries of the training-data operators and their DuckDB twins.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import (bpe, chat, importance, masked_lm, packing, quality_rules, secret_scan, sharding, simhash,
                           topk, toxicity, url_filter, whitening)
from foldspark.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(column):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5)) == 0


@_query
def op1_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").filter(~_held_out("doc_id"))
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


# Speaker markers of four transcript styles, by role.
STYLES = [("System: ", "User: ", "Assistant: "), ("### Instructions: ", "### Human: ", "### Bot: "),
          ("[system] ", "[user] ", "[assistant] "), ("Context: ", "Q: ", "A: ")]


def transcripts(conversations: DataFrame) -> DataFrame:
    """``conversations`` as raw transcripts: every conversation in one of
    ``STYLES``, with one turn in five lacking its marker."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, chat.ROLES)), F.lower("role")), F.lit(0)).cast("int")
    table = F.array(*(F.array(*map(F.lit, s)) for s in STYLES))
    mark = F.coalesce(F.get(F.get(table, style), number - 1), F.lit(""))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(5)) == 0
    return conversations.withColumn("text", F.concat(
        F.when(bare, "").otherwise(mark), F.coalesce("text", F.lit(""))))


@_query
def op2_chat_roles(spark, sf_dir):
    raw = transcripts(_table(spark, sf_dir, "conversations"))
    lines = chat.observed(chat.lines_of(raw, "conv_id", "text", "turn", "role"))
    model = chat.fit(lines.filter(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0))
    return chat.parse(lines, model).withColumnRenamed("id", "conv_id")


@_query
def op3_topk(spark, sf_dir):
    vectors = topk.integer_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 256)
    return topk.search(vectors, F.col("id") % 50 == 0, 5)


ORACLES["op3_topk"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


URL_RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/es/"),
             url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("allow", "com", "/fr/"),
             url_filter.Rule("block", "com", "/de/")]


@_query
def op4_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


@_query
def op5_packing(spark, sf_dir):
    pieces = packing.pack(_table(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "window", "step_id")


@_query
def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op7_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs.select("doc_id", "text"), rules).select(
        "doc_id", *(f"stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                          "n_repeat_words")), "base_failed", "kept", "rule")


@_query
def op8_secret_scan(spark, sf_dir):
    found = secret_scan.scan(_table(spark, sf_dir, "documents")).select("doc_id", "spans")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of_kind(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        "doc_id", *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS),
        F.sha2(joined(of_kind(*secret_scan.BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


@_query
def op9_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@_query
def op10_masked_lm(spark, sf_dir):
    return masked_lm.fit_and_score(_table(spark, sf_dir, "documents"))


@_query
def op11_whitening(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows)
    error = whitening.identity_error(rows, model, 8)
    ratios = (model.values / model.trace).tolist() if model.trace else []
    share = F.array(*map(F.lit, ratios)) if ratios else F.array().cast("array<double>")
    return (whitening.whiten(rows, model, 8)
            .select("vec_id", "deviation", F.posexplode("whitened").alias("_k", "whitened"))
            .select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                    "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).alias("identity_error")))


# CRC-32 by bytes for the twins; the table of 256 follows from the polynomial.
_CRC_STEPS = """crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b::BIGINT)) AS steps)"""


def _crc_sql(text: str) -> str:
    """DuckDB expression, beside ``crc``: the CRC-32 of a text's UTF-8 bytes."""
    return (f"xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, steps[1 + (xor(c, b) & 255)]), "
            "4294967295::BIGINT))")


@_query
def op12_importance(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    gain = importance.fit(docs, _table(spark, sf_dir, "benchmark"))
    return importance.resample(importance.weigh(docs, gain)).select(
        "doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
              r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
ORACLES["op12_importance"] = f"""WITH {_CRC_STEPS},
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS_SQL} AS words FROM documents),
dw AS (SELECT k, unnest(words) AS word FROM d),
bw AS (SELECT unnest({_WORDS_SQL}) AS word FROM benchmark),
bucket AS (SELECT word, {_crc_sql("word")} % 10000 AS b
  FROM (SELECT word FROM dw UNION SELECT word FROM bw), crc),
s AS (SELECT b, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
  FROM s FULL JOIN t USING (b)),
w AS (SELECT k, sum(gain)::BIGINT AS weight FROM dw JOIN bucket USING (word) JOIN g USING (b) GROUP BY k),
x AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)
      / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (k)),
r AS (SELECT doc_id, n_features, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM x WHERE n_features >= 20)
SELECT doc_id, x.n_features, weight, score,
  CASE WHEN place <= (SELECT count(*) FROM r) * 10 // 100 THEN place END::BIGINT AS rank
FROM x LEFT JOIN r USING (doc_id)
"""

SHARDS = 16


@_query
def op13_sharding(spark, sf_dir):
    docs = sharding.sizes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    placed = sharding.assign(docs, "doc_id", [1.0] * SHARDS, [1.0])
    return sharding.numbered(placed, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _bid_sql(shard: str) -> str:
    return f"-1.0 / ln((('0x' || substr(md5(doc_id || ':' || {shard}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


ORACLES["op13_sharding"] = f"""WITH {_CRC_STEPS},
d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    {_crc_sql("coalesce(text, '')")} AS text_crc32,
    list_transform(range(17), lambda k: {_bid_sql("k")}) AS bids FROM documents, crc),
p AS (SELECT doc_id, size, text_crc32, (list_position(bids[:16], list_max(bids[:16])) - 1)::INTEGER AS shard,
    (list_position(bids, list_max(bids)) - 1)::INTEGER AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM p
"""
