"""Corpus pipeline: ``documents`` through five operators, each stage written and reread.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm import langid, mixing, pii, simhash, spm
from logweave.llm.queries import PIECES
from logweave.session import scratch_path

SIMHASH_SHINGLE, SIMHASH_BITS = 4, 4
MIX_FRACTION = 0.8
DROPOUT, SEED = 0.1, 42


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that the network can tell go; a missing
    language is filled in.  The network learns from the labelled documents."""
    return langid.keep_identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    return simhash.drop_near_copies(docs, shingle=SIMHASH_SHINGLE, bits=SIMHASH_BITS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, is replaced by the name of its kind."""
    return pii.redact_docs(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the calibrated rates of sources, languages and topics; rates
    above 1 repeat documents."""
    return mixing.draw(docs, fraction=MIX_FRACTION)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode back to its text."""
    tokenizer = spm.Tokenizer.load(PIECES, alpha=DROPOUT, seed=SEED)
    return spm.tokenize(docs, tokenizer, keep=("lang", "source")).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", tokens),
]
#: A trained network, SimHash and piece merges have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each stage's rows are written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
