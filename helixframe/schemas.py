"""Schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES = {
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "boolean": BooleanType(),
    "array<string>": ArrayType(StringType()),
    "array<bigint>": ArrayType(LongType()),
}


def _schema(columns: str) -> StructType:
    """A schema from ``name type`` pairs; needs no running session."""
    pairs = (c.split() for c in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW_VARIANTS = _schema(
    "location bigint, sample_id bigint, ref string, alt string, call_GT string, call_GQ bigint, "
    "as_raw_mq string, as_raw_mqranksum string, as_qualapprox string, "
    "as_raw_readposranksum string, as_sb_table string, call_AD string"
)

ALT_ALLELE = _schema(
    "location bigint, sample_id bigint, ref string, allele string, allele_pos int, "
    "call_GT string, call_GQ bigint, as_raw_mq string, raw_mq bigint, as_raw_mqranksum string, "
    "qual bigint, as_raw_readposranksum string, as_sb_table string, call_AD string, "
    "ref_ad bigint, ad bigint"
)

CONDENSED = _schema(
    "location bigint, ref string, allele string, sample_ids array<bigint>"
)

VAT = _schema(
    "vid string, contig string, position bigint, ref_allele string, alt_allele string, "
    "is_canonical_transcript boolean, gene_symbol string, clinvar_classification array<string>, "
    "consequence array<string>, gvs_all_sc bigint"
)

SAMPLE_INFO = _schema(
    "sample_id bigint, sample_name string, withdrawn string, is_control boolean"
)

WEIGHTS = _schema("location bigint, weight bigint")

# Metrics arrive as text because some of them do not parse; see sources.text.read_bucket_stats.
BUCKET_STATS_TEXT = _schema(
    "location_bin bigint, entries bigint, avg_qual string, stddev_qual string, "
    "avg_refad string, stddev_refad string, avg_ad string, stddev_ad string, "
    "avg_gq string, stddev_gq string"
)
STAT_METRICS = tuple(f.name for f in BUCKET_STATS_TEXT.fields[2:])

SPIKES = _schema("bin bigint, location bigint, allele string, percentage double")

BITMAPS = _schema("bin bigint, entries bigint, low_bits bigint, high_bits bigint")

GENOME = _schema("contig string, chunk_start bigint, bases string")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Select the schema's columns by name and cast them to its types."""
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields))
