"""The corpus pipeline: toxicity, near copies, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in
the shared scratch folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import bpe, jaccard_join, mixing, pii, toxicity
from skyledger.llm.catalog import vocabulary
from skyledger.llm.common import prepare, table
from skyledger.session import scratch_path

#: Documents that score so high are rejected.
TOXIC_SCORE = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the limit; learned from the labels that aren't held out."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, out="__score").where(F.col("__score") < TOXIC_SCORE).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8."""
    prepare(spark)
    return jaccard_join.deduplicate(docs, width=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with surrogates for personal data and secrets."""
    prepare(spark)
    out = pii.replace(docs).drop("n_entities", "entity_types")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row for each document and pass."""
    prepare(spark)
    out = mixing.materialise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row, with digests of them and of the bytes they decode to."""
    prepare(spark)
    path, pattern = vocabulary()
    rows = bpe.decode(bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), path, pattern).drop("text"), path)
    return rows.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "ids_sha256",
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", reject_toxic), ("ngram_jaccard_join", drop_near_copies), ("pii", replace_personal_data),
          ("mixing", mix_sources), ("byte_bpe", encode_tokens)]

#: Not expressible: classifier, exact set join, keyed surrogates and token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
