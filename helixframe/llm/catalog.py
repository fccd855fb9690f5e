"""The queries of the operators over the given tables, and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import (
    ball_tree, bpe, chat, grace_dedup, language, minhash, mixing, quality, suffix_dedup, toxicity, trie, url_filters, warc,
)
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    docs = lambda spark, sf: table(spark, sf, "documents")
    return {
        "op1_url_filters": lambda spark, sf: url_filters.report(table(spark, sf, "pages")),
        "op2_mixing": lambda spark, sf: mixing.report(docs(spark, sf)),
        "op3_byte_bpe": lambda spark, sf: bpe.round_trip(
            docs(spark, sf), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
        ),
        "op4_chat_formatting": lambda spark, sf: chat.rendered(table(spark, sf, "conversations")),
        "op5_suffix_dedup": lambda spark, sf: suffix_dedup.report(docs(spark, sf)),
        "op6_warc": lambda spark, sf: warc.report(table(spark, sf, "pages")),
        "op7_quality_rules": lambda spark, sf: quality.report(docs(spark, sf)),
        "op8_minhash": lambda spark, sf: minhash.near_classes(docs(spark, sf)),
        "op9_toxicity": lambda spark, sf: toxicity.report(docs(spark, sf), table(spark, sf, "labels")),
        "op10_exact_dedup": lambda spark, sf: grace_dedup.exact_groups(docs(spark, sf)),
        "op11_lexical_search": lambda spark, sf: ball_tree.search(docs(spark, sf), table(spark, sf, "benchmark")),
        "op12_language_id": lambda spark, sf: language.report(docs(spark, sf)),
        "op13_prefix_trie": lambda spark, sf: trie.report(table(spark, sf, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filters.oracle(),
        "op2_mixing": mixing.oracle(),
        "op4_chat_formatting": chat.oracle(),
        "op6_warc": warc.oracle(),
        "op7_quality_rules": quality.oracle(),
        "op10_exact_dedup": grace_dedup.oracle(),
        "op11_lexical_search": ball_tree.oracle(),
        "op13_prefix_trie": trie.oracle(),
    }
