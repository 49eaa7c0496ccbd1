"""The corpus pipeline: stages from raw documents to packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm import packing, quality_rules, secret_scan, simhash, toxicity
from foldspark.llm.frames import Aside, filter_computed
from foldspark.session import cut, tune

# SQL expresses neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or a learned rule go."""
    rules = quality_rules.learn(docs, _labels(spark, sf_dir))
    own = Aside(docs)
    judged = quality_rules.judge(own.frame.withColumn("text", own.column("text")), rules)
    return own.restore(filter_computed(judged, F.col("kept")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of one half or more go."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    own = Aside(docs)
    return own.restore(own.frame.filter(toxicity.score(model, own.column("text")) < 0.5))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, by fingerprints of four-word shingles with
    at most four differing bits, the document of lowest id stays."""
    tune(spark)
    return simhash.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by marks; ``n_chars`` follows."""
    tune(spark)
    clean = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.length("text").cast(kind))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their ids, in packed sequences."""
    tune(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", simhash_stage),
          ("secrets", secrets_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each one's result is stored in
    the shared folder and read again by the next."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
