"""Raw calls to one row per sample and called alternate allele."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ..constants import (
    ALT_ALLELE_COLUMNS,
    LONG_COLUMNS,
    SINGLE_ALT_GENOTYPES,
    TWO_ALT_GENOTYPES,
)
from ..functions.alleles import comma_item, drop_suffix, pipe_item, shared_suffix
from ..functions.numbers import lenient_long, parse_long


def single_alt_calls(raw: DataFrame) -> DataFrame:
    """Calls that yield allele 1 only."""
    return raw.where(F.col("call_GT").isin(*SINGLE_ALT_GENOTYPES))


def two_alt_calls(raw: DataFrame) -> DataFrame:
    """Calls that yield alleles 1 and 2."""
    return raw.where(F.col("call_GT").isin(*TWO_ALT_GENOTYPES))


def with_allele_positions(raw: DataFrame) -> DataFrame:
    """Repeat each call once per alternate allele its genotype names; other genotypes vanish."""
    called = raw.where(F.col("call_GT").isin(*SINGLE_ALT_GENOTYPES, *TWO_ALT_GENOTYPES))
    positions = F.when(
        F.col("call_GT").isin(*TWO_ALT_GENOTYPES), F.array(F.lit(1), F.lit(2))
    ).otherwise(F.array(F.lit(1)))
    return called.withColumn("allele_pos", F.explode(positions))


def _project(calls: DataFrame, pos: Column) -> DataFrame:
    """The 16 columns for the alternate at ``pos``."""
    picked = calls.withColumn("_alt", comma_item(F.col("alt"), pos))
    trimmed = picked.withColumn("_cut", shared_suffix(F.col("ref"), F.col("_alt")))
    computed = {
        "ref": drop_suffix(F.col("ref"), F.col("_cut")),
        "allele": drop_suffix(F.col("_alt"), F.col("_cut")),
        "allele_pos": pos,
        "raw_mq": parse_long(pipe_item(F.col("as_raw_mq"), pos + 1)),
        "qual": lenient_long(pipe_item(F.col("as_qualapprox"), pos)),
        "ref_ad": lenient_long(comma_item(F.col("call_AD"), 1)),
        "ad": lenient_long(comma_item(F.col("call_AD"), pos + 1)),
    }
    return trimmed.select(
        *(computed.get(c, F.col(c)).alias(c) for c in ALT_ALLELE_COLUMNS)
    )


def expand_alt_alleles(raw: DataFrame) -> DataFrame:
    """One scan, no shuffle: explode the called positions, then project the 16 columns.

    ``0/2`` and ``2`` count as allele 1, as the genotype lists say. ``location`` stays where it
    is when a suffix is dropped.
    """
    return _project(with_allele_positions(raw), F.col("allele_pos"))


def all_calls(batches: Sequence[DataFrame]) -> DataFrame:
    """Batches of expanded calls as one table; repeated rows stay."""
    return reduce(DataFrame.unionByName, batches)


def cast_long(df: DataFrame, columns: tuple[str, ...] = LONG_COLUMNS) -> DataFrame:
    """Cast the named columns to bigint: a fraction is dropped, other text becomes NULL."""
    return to_whole(df, {c: "bigint" for c in columns})


def to_whole(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast columns to whole number types; text is read leniently, numbers are cast as they are."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
    return df.withColumns(
        {c: (lenient_long(F.col(c)) if c in text else F.col(c)).cast(kind) for c, kind in kinds.items()}
    )


def columns_first(df: DataFrame, first: tuple[str, ...]) -> DataFrame:
    """Move the named columns to the front, the rest keeps its order."""
    return df.select(*first, *(c for c in df.columns if c not in first))
