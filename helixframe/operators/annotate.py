"""Questions that join the annotation table with the calls."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import MIN_CALL_GQ, MIN_DEPTH, MODY_GENES, VARIANT_KEYS
from ..functions.coords import encode_location
from ..functions.text import is_pathogenic, joined, shares_term
from ..sources.buckets import BucketedTable, bucketed_join
from .joins import MAX_BROADCAST_BYTES, join_measured

VARIANT_COLUMNS = ("vid", "contig", "position", "ref_allele", "alt_allele", "gvs_all_sc")


def canonical(vat: DataFrame) -> DataFrame:
    """Rows of the canonical transcript; NULL does not count."""
    return vat.where(F.col("is_canonical_transcript"))


def pathogenic(vat: DataFrame) -> DataFrame:
    """Rows labelled pathogenic and not benign."""
    return vat.where(is_pathogenic(F.col("clinvar_classification")))


def in_genes(vat: DataFrame, genes: Iterable[str] = MODY_GENES) -> DataFrame:
    """Rows of the named genes."""
    return vat.where(F.col("gene_symbol").isin(*genes))


def with_consequence(vat: DataFrame, terms: Iterable[str]) -> DataFrame:
    """Rows that have at least one of the consequences."""
    return vat.where(shares_term(F.col("consequence"), terms))


def distinct_variants(vat: DataFrame, consequence_text: bool = False) -> DataFrame:
    """Distinct variants; optionally with their consequences as one text."""
    columns = [F.col(c) for c in VARIANT_COLUMNS]
    if consequence_text:
        columns.insert(-1, joined(F.col("consequence"), ", ").alias("consequence_str"))
    return vat.select(*columns).distinct()


def good_calls(
    alt_allele: DataFrame, min_gq: int = MIN_CALL_GQ, min_depth: int = MIN_DEPTH
) -> DataFrame:
    """Genotype quality at least ``min_gq`` and total depth above ``min_depth``."""
    deep = F.col("ref_ad") + F.col("ad") > min_depth
    return alt_allele.where((F.col("call_GQ") >= min_gq) & deep)


def active_samples(sample_info: DataFrame) -> DataFrame:
    """Samples that are not withdrawn and are known not to be controls."""
    known = F.col("is_control").eqNullSafe(F.lit(False))
    return sample_info.where(F.col("withdrawn").isNull() & known)


def located(variants: DataFrame) -> DataFrame:
    """Annotated variants with the keys of the calls; those without a location meet none."""
    return variants.withColumns(
        {
            "location": encode_location(F.col("contig"), F.col("position")),
            "ref": F.col("ref_allele"),
            "allele": F.col("alt_allele"),
        }
    ).where(F.col("location").isNotNull())


def carriers(
    variants: DataFrame,
    alt_allele: DataFrame,
    samples: DataFrame | None = None,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Calls of the variants, one row per match (an action on the small sides).

    The variants that a question selects are few as a rule; they and the sample table are
    measured before they are broadcast, so that the calls are not shuffled for this join.
    """
    calls = join_measured(alt_allele, located(variants), list(VARIANT_KEYS), max_bytes=max_bytes)
    if samples is None:
        return calls
    names = samples.select("sample_id", "sample_name")
    return join_measured(calls, names, ["sample_id"], max_bytes=max_bytes)


def pathogenic_carriers(
    vat: DataFrame,
    alt_allele: DataFrame,
    sample_info: DataFrame | None = None,
    genes: Iterable[str] = MODY_GENES,
) -> DataFrame:
    """Samples with a well-supported pathogenic variant in the genes: ids, or names if given."""
    variants = distinct_variants(in_genes(pathogenic(canonical(vat)), genes))
    samples = None if sample_info is None else active_samples(sample_info)
    found = carriers(variants, good_calls(alt_allele), samples)
    return found.select("sample_id" if samples is None else "sample_name").distinct()


def bucketed_pathogenic_carriers(
    spark: SparkSession, vat: BucketedTable, calls: BucketedTable, genes: Iterable[str] = MODY_GENES
) -> DataFrame:
    """The same samples from tables stored in buckets of the variant keys: nothing is shuffled below the join.

    ``vat`` holds ``located`` rows. Distinct variants are found bucket by bucket, since their columns
    include the keys.
    """
    chosen = in_genes(pathogenic(canonical(vat.rows(spark) if vat.has_hot(spark) else spark.table(vat.name))), genes)
    variants = chosen.select(*VARIANT_KEYS).distinct()
    return good_calls(bucketed_join(spark, variants, calls, vat)).select("sample_id").distinct()


def consequence_carriers(
    vat: DataFrame, alt_allele: DataFrame, gene: str, terms: Iterable[str]
) -> DataFrame:
    """Sample ids of the calls of one gene's variants with any of the consequences, repeats kept."""
    chosen = with_consequence(in_genes(canonical(vat), [gene]), terms)
    variants = distinct_variants(chosen, consequence_text=True)
    return carriers(variants, alt_allele).select("sample_id")


def gene_counts(vat: DataFrame) -> DataFrame:
    """Rows per gene; rows without a gene are a group too."""
    return vat.groupBy("gene_symbol").agg(F.count("*").alias("n"))


def classification_counts(vat: DataFrame) -> DataFrame:
    """Rows per classification list."""
    return vat.groupBy("clinvar_classification").agg(F.count("*").alias("n"))
