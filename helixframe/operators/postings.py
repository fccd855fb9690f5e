"""An inverted index from samples to the variants they carry.

A posting row holds the variants of one sample in one window of ``WINDOW`` bases: offsets from the
window's start (small numbers, which the file format packs) beside the alleles, in order. A window
bounds the row. The index is written in sample order, so a question about one sample reads its own
row groups and nothing of the calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import VARIANT_KEYS
from ..functions.numbers import int_div
from ..sources.tables import write_clustered

WINDOW = 16_384
POSTINGS = "sample_id bigint, window bigint, n int, offsets array<int>, refs array<string>, alleles array<string>"


def postings(alt_allele: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per sample and window; repeated calls of a variant are one posting.

    Rows without a sample or a location can't be asked for and are left out.
    """
    known = alt_allele.where(F.col("sample_id").isNotNull() & F.col("location").isNotNull())
    # Distinct postings first, combined map-side: a sample's copies of a call never meet in a list.
    distinct = known.select("sample_id", *VARIANT_KEYS).distinct()
    keyed = distinct.select(
        "sample_id",
        int_div(F.col("location"), window).alias("window"),
        F.struct((F.col("location") % window).cast("int").alias("offset"), "ref", "allele").alias("_p"),
    )
    rows = keyed.groupBy("sample_id", "window").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return rows.select(
        "sample_id", "window", F.size("_p").alias("n"),
        F.col("_p.offset").alias("offsets"), F.col("_p.ref").alias("refs"), F.col("_p.allele").alias("alleles"),
    )


def write_postings(alt_allele: DataFrame, path: str, window: int = WINDOW, mode: str = "errorifexists") -> None:
    """Write the index in order of sample and window (an action); ``append`` adds a batch of calls.

    A sample that comes again in a later batch has postings in both; readers unite them.
    """
    write_clustered(postings(alt_allele, window), path, by=("sample_id",), then_by=("window",), mode=mode)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POSTINGS).parquet(path)


def variants_of(index: DataFrame, sample_id: int, window: int = WINDOW) -> DataFrame:
    """Distinct variants of one sample; only its part of the index is read."""
    return _decoded(index.where(F.col("sample_id") == sample_id), window).select(*VARIANT_KEYS).distinct()


def variants_in_range(index: DataFrame, sample_id: int, low: int, high: int, window: int = WINDOW) -> DataFrame:
    """Variants of one sample with ``low < location < high``; both filters reach the scan."""
    near = index.where((F.col("window") >= low // window) & (F.col("window") <= high // window))
    found = variants_of(near, sample_id, window)
    return found.where((F.col("location") > low) & (F.col("location") < high))


def shared_variants(index: DataFrame, first: int, second: int, window: int = WINDOW) -> DataFrame:
    """Variants that two samples have in common."""
    both = index.where(F.col("sample_id").isin(first, second))
    rows = _decoded(both, window).groupBy(*VARIANT_KEYS).agg(F.countDistinct("sample_id").alias("_n"))
    return rows.where(F.col("_n") == len({first, second})).drop("_n")


def _decoded(index: DataFrame, window: int) -> DataFrame:
    posting = F.explode(F.arrays_zip("offsets", "refs", "alleles")).alias("_p")
    rows = index.select("sample_id", "window", posting)
    return rows.select(
        "sample_id",
        (F.col("window") * window + F.col("_p.offsets")).alias("location"),
        F.col("_p.refs").alias("ref"),
        F.col("_p.alleles").alias("allele"),
    )
