"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets as docs, after it has been written
as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import mixing, near_dedup, packing, quality_model, secret_scan
from tidewell.llm.scratch import Scratch, collected, free_heaps

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def rested(stage: Stage) -> Stage:
    """stage, on executors without the garbage of those before: their heaps and this stage's Python share the memory."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        free_heaps(spark)
        return stage(spark, docs, sf_dir)

    return run


@rested
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from all labels of sf_dir."""
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.accepted(docs, model)


@rested
def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, words=5, percent=80).select(docs.columns)


@rested
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the secrets in its text replaced; n_chars counts the new text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@rested
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, or up to three times."""
    return mixing.mixed_documents(docs).select(docs.columns)


@rested
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier, the inferred automata or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with collected():  # what the stage's operator has written goes with it
            before, docs = docs, scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return docs
