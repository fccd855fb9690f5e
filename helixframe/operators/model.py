"""Model tables of the generator, derived from called alleles, and lookups in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BITMAP_WORD, STATS_BIN, WEIGHT_BIN
from ..functions.numbers import floor_to

METRICS = {"qual": "qual", "refad": "ref_ad", "ad": "ad", "gq": "call_GQ"}


def model_weights(alt_allele: DataFrame) -> DataFrame:
    """Rows per 100-base bin."""
    return alt_allele.groupBy(floor_to(F.col("location"), WEIGHT_BIN).alias("location")).agg(
        F.count("*").alias("weight")
    )


def model_stats(alt_allele: DataFrame) -> DataFrame:
    """Average and spread of the four metrics per 10,000-base bin; NULL where undefined."""
    measures = [F.count("*").alias("entries")]
    for name, column in METRICS.items():
        measures.append(F.avg(column).alias(f"avg_{name}"))
        measures.append(F.stddev_samp(column).alias(f"stddev_{name}"))
    return alt_allele.groupBy(
        floor_to(F.col("location"), STATS_BIN).alias("location_bin")
    ).agg(*measures)


def _offset_words() -> tuple[Column, Column]:
    """The bit of a row's offset in its bin, in the low or in the high word."""
    offset = (F.col("location") % WEIGHT_BIN).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), offset % BITMAP_WORD)
    nothing = F.lit(0).cast("bigint")
    low = F.when(offset < BITMAP_WORD, bit).otherwise(nothing)
    high = F.when(offset >= BITMAP_WORD, bit).otherwise(nothing)
    return low, high


def model_bitmaps(alt_allele: DataFrame) -> DataFrame:
    """Offsets seen in each 100-base bin, as two 50-bit words."""
    low, high = _offset_words()
    return alt_allele.groupBy(floor_to(F.col("location"), WEIGHT_BIN).alias("bin")).agg(
        F.count("*").alias("entries"),
        F.bit_or(low).alias("low_bits"),
        F.bit_or(high).alias("high_bits"),
    )


def model_spikes(alt_allele: DataFrame, min_share: float = 0.0) -> DataFrame:
    """The most frequent location and allele of each bin with its share of the bin's rows.

    Ties go to the lowest location, then the highest allele text. Rows are counted first, and
    the best of a bin is a plain maximum, so a hot bin needs no window.
    """
    counts = (
        alt_allele.withColumn("bin", floor_to(F.col("location"), WEIGHT_BIN))
        .groupBy("bin", "location", "allele")
        .agg(F.count("*").alias("_n"))
    )
    best = F.max(F.struct("_n", (-F.col("location")).alias("_neg"), "allele"))
    top = counts.groupBy("bin").agg(best.alias("_top"), F.sum("_n").alias("_all"))
    share = F.col("_top._n").cast("double") / F.col("_all").cast("double")
    return top.select(
        "bin",
        (-F.col("_top._neg")).alias("location"),
        F.col("_top.allele").alias("allele"),
        share.alias("percentage"),
    ).where(F.col("percentage") >= min_share)


def model_bins(alt_allele: DataFrame) -> DataFrame:
    """Weights, bitmaps and spikes of all bins in one pass.

    Rows are counted per location and allele first; everything a bin needs follows from those
    counts. ``bin_weights``, ``bin_bitmaps`` and ``bin_spikes`` show it as the separate tables.
    """
    return bins_of_counts(alt_allele.groupBy("location", "allele").agg(F.count("*").alias("_n")))


def bins_of_counts(counts: DataFrame) -> DataFrame:
    """``model_bins`` from the number ``_n`` of calls per location and allele."""
    low, high = _offset_words()
    best = F.max(F.struct("_n", (-F.col("location")).alias("_neg"), "allele"))
    bins = counts.groupBy(floor_to(F.col("location"), WEIGHT_BIN).alias("bin")).agg(
        F.sum("_n").alias("entries"),
        F.bit_or(low).alias("low_bits"),
        F.bit_or(high).alias("high_bits"),
        best.alias("_top"),
    )
    return bins.select(
        "bin", "entries", "low_bits", "high_bits",
        (-F.col("_top._neg")).alias("location"),
        F.col("_top.allele").alias("allele"),
        (F.col("_top._n").cast("double") / F.col("entries").cast("double")).alias("percentage"),
    )


def bin_weights(bins: DataFrame) -> DataFrame:
    """The weights of ``model_bins``."""
    return bins.select(F.col("bin").alias("location"), F.col("entries").alias("weight"))


def bin_bitmaps(bins: DataFrame) -> DataFrame:
    """The bitmaps of ``model_bins``."""
    return bins.select("bin", "entries", "low_bits", "high_bits")


def bin_spikes(bins: DataFrame, min_share: float = 0.0) -> DataFrame:
    """The spikes of ``model_bins``."""
    spikes = bins.select("bin", "location", "allele", "percentage")
    return spikes.where(F.col("percentage") >= min_share)


def spike_lookup(bins: DataFrame, spikes: DataFrame, key: str = "bucket") -> DataFrame:
    """Attach the dominant variant of the bin, if there is one."""
    side = spikes.select(
        F.col("bin").alias(key),
        F.col("location").alias("spike_location"),
        F.col("allele").alias("spike_allele"),
        F.col("percentage").alias("spike_share"),
    )
    return bins.join(side, [key], "left")


def bitmap_lookup(
    bins: DataFrame, bitmaps: DataFrame, key: str = "bucket", how: str = "inner"
) -> DataFrame:
    """Attach the known offsets of the bin; bins without any are left out unless ``how`` is left."""
    side = bitmaps.select(F.col("bin").alias(key), "low_bits", "high_bits")
    return bins.join(side, [key], how)


def bins_without_bitmap(bins: DataFrame, bitmaps: DataFrame, key: str = "bucket") -> DataFrame:
    """The rows that ``bitmap_lookup`` leaves out, to be counted or reported."""
    return bins.join(bitmaps.select(F.col("bin").alias(key)), [key], "left_anti")


def stats_lookup(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the metrics of the row's 10,000-base bin; rows of an unknown bin are left out."""
    side = stats.withColumnRenamed("location_bin", "_stats_bin").drop("entries")
    keyed = rows.withColumn("_stats_bin", floor_to(F.col("location"), STATS_BIN))
    return keyed.join(side, ["_stats_bin"]).drop("_stats_bin")


def reference_base_lookup(rows: DataFrame, genome: DataFrame, chunk: int = STATS_BIN) -> DataFrame:
    """Attach the genome base at each row's location from the located chunks.

    Chunks are joined as bytes: a base is then one offset away, where text would be counted
    through character by character for every row.
    """
    side = genome.select(
        F.col("location").alias("_chunk"), F.col("bases").cast("binary").alias("_bases")
    )
    keyed = rows.withColumn("_chunk", floor_to(F.col("location"), chunk))
    offset = (F.col("location") - F.col("_chunk") + 1).cast("int")
    base = F.substring(F.col("_bases"), offset, F.lit(1)).cast("string")
    return keyed.join(side, ["_chunk"]).withColumn("ref_base", base).drop("_chunk", "_bases")
