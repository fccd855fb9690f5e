"""From documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import bpe, grace_dedup, minhash, mixing, toxicity
from helixframe.llm.common import staged, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.stage(docs, table(spark, sf_dir, "labels"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return grace_dedup.stage(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.stage(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.stage(docs)


def _encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    # Smaller tables: executors have kept memory from the stages before.
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, with_ids=True, max_states=220_000, max_pieces=150_000)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("minhash_near_dedup", _near_dedup),
    ("mixing", _mixing),
    ("byte_bpe", _encoding),
]

#: The classifier is trained, near copies are found by hashing and ids come from merges: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of what the stages leave of the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = staged(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
