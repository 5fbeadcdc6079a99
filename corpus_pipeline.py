"""The corpus pipeline: stages that each take the documents their predecessor kept.

Language ID, toxicity, near-dedup and decontamination return the columns of documents, without the rows they reject;
the last stage encodes what is left.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe_trie, decontaminate, language_id, near_copies, toxicity
from tidewell.llm.shared import small_batches, stored, work_dir


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a confidence of over a half.

    lang is what the models learn from, so it is no evidence; the host is source. Texts of no language are rejected whatever lang says,
    and a text without letters stays if its source's texts have a language. Each row is judged by itself: what the
    verdict hangs on besides all rows together is its text and source, so a digest of these stands for the row, not its
    id. Null texts and sources are no evidence, repeated rows go or stay together.
    """
    small_batches(spark)
    parts = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in ("text", "source")]
    key = F.sha2(F.concat(*parts).cast("binary"), 256)
    model = language_id.fit(docs)
    found = language_id.identify(docs.withColumn("row_key", key), model, work_dir(spark, "stage-language"), "row_key", F.col("text"), F.lit(None), F.col("source"))
    bad = found.where("lang = 'und'").select(F.col("row_key").alias("bad_key")).distinct()
    return docs.join(bad, key == bad["bad_key"], "left_anti")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut. Null and empty texts have the lowest score; equal texts go or stay together."""
    small_batches(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), work_dir(spark, "stage-toxicity")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id. Rows with a null id, and texts without words, all stay; rows
    of one id go or stay together."""
    small_batches(spark)
    return near_copies.dedup(docs, work_dir(spark, "stage-copies"))


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none; equal texts go or stay together."""
    small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to; of the documents' columns only doc_id is kept.
    A null text counts as empty and has no ids; each row gives one row."""
    small_batches(spark)
    return bpe_trie.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, spare=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("toxicity", civil),
    ("near_copies", distinct),
    ("decontaminate", unleaked),
    ("bpe", encoded),
]

#: SQL cannot train the classifiers or encode; tests/llm/test_pipeline.py holds the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}")
    return docs
