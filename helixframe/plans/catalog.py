"""Every operator as a named query over the stand-in tables of ``fixtures``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import ALLOWED_BASES, ALT_ALLELE_COLUMNS, MAX_GQ, VARIANT_KEYS
from ..functions import alleles, bits, coords, noise, numbers, text
from ..functions import sql as named
from ..operators import alias, annotate, bitmaps, cohort, expand, model, model_state, packed, postings, terms, weights
from ..operators.joins import join_measured
from ..operators.model import METRICS
from ..schemas import ALT_ALLELE, STAT_METRICS, VAT, WEIGHTS, conform
from ..session import parts_for, pin, scratch_path
from ..sources import blockgzip, buckets, fasta, quarantine, tables, zorder
from ..sources import text as text_files
from ..streaming import ingest
from . import fixtures as fx
from . import ml, questions, synth

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}

LOW, HIGH, WIDE_HIGH = 1_000_000_010_007, 1_000_000_010_200, 1_000_000_010_400
TERMS = ("stop_gained", "frameshift_variant")
NEW_SAMPLES = 2
SLICE = (0.25, 0.55)
# Small blocks, so that the tables here have several per variant.
BITMAP_BLOCK = 64
ALIAS_BLOCK = 1_000


def query(build: Query) -> Query:
    _QUERIES[build.__name__] = build
    return build


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def ids_as_text(df: DataFrame) -> DataFrame:
    """Sample lists have no order; show them sorted, as text."""
    return df.withColumn("sample_ids", F.array_join(F.array_sort("sample_ids"), ","))


def blocks_as_text(df: DataFrame) -> DataFrame:
    """Show carriers sorted, as text of id * 10^6 + calls."""
    packed = F.transform("carriers", lambda c: c["sample_id"] * 1_000_000 + c["calls"])
    return df.withColumn("carriers", F.array_join(F.array_sort(packed), ","))


def vat_as_text(df: DataFrame) -> DataFrame:
    """Show the two array columns as text."""
    return df.select(
        "vid", "contig", "position", "ref_allele", "alt_allele", "is_canonical_transcript",
        "gene_symbol", text.joined(F.col("clinvar_classification"), ";").alias("clinvar"),
        text.joined(F.col("consequence"), ";").alias("consequences"), "gvs_all_sc",
    )


def rounded_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in STAT_METRICS})


def fixed_noise() -> noise.Noise:
    return noise.modular_noise(synth.NOISE_TAGS)


def _name(label: str) -> str:
    return f"helixframe_{label}_{uuid.uuid4().hex}"


# -- sources and sinks ------------------------------------------------------------------------


@query
def scan_parquet_dir(spark, sf_dir):
    path = scratch_path(spark, "files")
    lines = tables.scan_dir(spark, f"{sf_dir}/lineitem.parquet")
    tables.write_dir(lines.repartition(parts_for(lines.count(), 5), "l_orderkey"), path)
    return tables.scan_dir(spark, path, lines.schema)


@query
def scan_table(spark, sf_dir):
    name = _name("scan")
    tables.write_table(fx.alt_allele(spark, sf_dir), name, scratch_path(spark, name))
    return tables.scan_table(spark, name)


@query
def scan_tsv(spark, sf_dir):
    path = scratch_path(spark, "tsv")
    text_files.write_sample_tsv(fx.alt_allele(spark, sf_dir), path)
    return text_files.read_tsv(spark, path)


@query
def scan_gzip_csv(spark, sf_dir):
    path = scratch_path(spark, "weights")
    text_files.write_model_csv(model.model_weights(fx.alt_allele(spark, sf_dir)), path)
    return text_files.read_weights(spark, path)


@query
def scan_block_gzip_csv(spark, sf_dir):
    """The weights from compressed files that several tasks read at once."""
    bins = model.model_weights(fx.alt_allele(spark, sf_dir))
    lines = bins.select(F.concat_ws(",", "location", "weight").alias("value"))
    files = blockgzip.write_block_gzip(lines.repartition(2), scratch_path(spark, "blocks"), header=",".join(WEIGHTS.names))
    return blockgzip.read_block_gzip_csv(files, WEIGHTS, range_bytes=2_000)


@query
def scan_bucket_stats(spark, sf_dir):
    path = scratch_path(spark, "stats")
    text_files.write_model_csv(model.model_stats(fx.alt_allele(spark, sf_dir)), path)
    return rounded_stats(text_files.read_bucket_stats(spark, path))


@query
def scan_spikes(spark, sf_dir):
    path = scratch_path(spark, "spikes")
    text_files.write_model_csv(model.model_spikes(fx.alt_allele(spark, sf_dir)), path)
    return text_files.read_spikes(spark, path)


@query
def scan_bitmaps(spark, sf_dir):
    path = scratch_path(spark, "bitmaps")
    text_files.write_model_csv(model.model_bitmaps(fx.alt_allele(spark, sf_dir)), path)
    return text_files.read_bitmaps(spark, path)


@query
def scan_fasta(spark, sf_dir):
    path = scratch_path(spark, "fasta")
    lines = F.regexp_replace("bases", "(.{60})", "$1\n")
    records = fx.fasta_records(spark, sf_dir)
    records.select(F.concat(F.lit(">"), "contig", F.lit(" made up\n"), lines)).write.text(path)
    return fasta.scan_fasta(spark, path, chunk=100)


@query
def write_table(spark, sf_dir):
    name = _name("made")
    tables.write_table(fx.alt_allele(spark, sf_dir), name, scratch_path(spark, name))
    return spark.table(name)


@query
def replace_table(spark, sf_dir):
    name, calls = _name("replaced"), fx.alt_allele(spark, sf_dir)
    path = scratch_path(spark, name)
    tables.replace_table(calls.select("location"), name, path)
    tables.replace_table(calls, name, path)
    return spark.table(name)


@query
def write_clustered(spark, sf_dir):
    path = scratch_path(spark, "clustered")
    tables.write_clustered(fx.alt_allele(spark, sf_dir), path, then_by=("ref", "allele"))
    return tables.scan_dir(spark, path, ALT_ALLELE)


def _z_ordered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "zordered")
    zorder.write_z_ordered(fx.alt_allele(spark, sf_dir), path, ("location", "sample_id"), files=16)
    return tables.scan_dir(spark, path, ALT_ALLELE)


@query
def write_z_ordered(spark, sf_dir):
    return _z_ordered_calls(spark, sf_dir)


@query
def z_ordered_sample(spark, sf_dir):
    """One sample's calls from a layout that serves ranges too."""
    return _z_ordered_calls(spark, sf_dir).where(F.col("sample_id") == 41)


@query
def z_ordered_range(spark, sf_dir):
    return cohort.in_range(_z_ordered_calls(spark, sf_dir), LOW, HIGH)


@query
def z_ordered_annotation(spark, sf_dir):
    """The gene filter on an annotation table laid out by gene and position."""
    source, target = scratch_path(spark, "loose"), scratch_path(spark, "zordered")
    tables.write_dir(fx.vat(spark, sf_dir), source)
    laid = zorder.compact_z_ordered(spark, source, target, ("gene_symbol", "position"), files=8)
    return vat_as_text(annotate.in_genes(laid))


@query
def compact_recluster(spark, sf_dir):
    source, target = scratch_path(spark, "loose"), scratch_path(spark, "compact")
    tables.write_dir(fx.alt_allele(spark, sf_dir), source)
    return tables.compact(spark, source, target, then_by=("ref", "allele"))


@query
def path_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "condensed")
    tables.write_dir(cohort.condense(fx.alt_allele(spark, sf_dir)), path)
    return ids_as_text(tables.scan_dir(spark, path))


@query
def file_manifest(spark, sf_dir):
    return tables.rows_per_table(spark, sf_dir)


@query
def write_sample_tsv(spark, sf_dir):
    path = scratch_path(spark, "samples")
    text_files.write_sample_tsv(fx.alt_allele(spark, sf_dir), path)
    return conform(text_files.read_tsv(spark, path), ALT_ALLELE)


# -- projections, filters, predicates ---------------------------------------------------------


@query
def reorder_columns(spark, sf_dir):
    first = ("clinvar_classification", "gene_symbol", "consequence")
    return vat_as_text(expand.columns_first(fx.vat(spark, sf_dir), first))


@query
def project_columns(spark, sf_dir):
    condensed = cohort.condense(fx.alt_allele(spark, sf_dir))
    return ids_as_text(condensed.select("location", "sample_ids"))


@query
def cast_columns(spark, sf_dir):
    as_text = fx.alt_allele(spark, sf_dir).select(*(F.col(c).cast("string") for c in ALT_ALLELE_COLUMNS))
    return expand.cast_long(as_text).select(
        "location", "sample_id", "ref", "allele", "allele_pos", "call_GQ", "qual", "ref_ad", "ad"
    )


@query
def filter_single_alt_gt(spark, sf_dir):
    return expand.single_alt_calls(fx.raw_variants(spark, sf_dir))


@query
def filter_two_alt_gt(spark, sf_dir):
    return expand.two_alt_calls(fx.raw_variants(spark, sf_dir))


@query
def range_count(spark, sf_dir):
    return cohort.count_in_range(fx.alt_allele(spark, sf_dir), LOW, HIGH)


@query
def range_count_condensed(spark, sf_dir):
    return cohort.count_in_range(cohort.condense(fx.alt_allele(spark, sf_dir)), LOW, HIGH)


@query
def range_select(spark, sf_dir):
    return cohort.in_range(fx.alt_allele(spark, sf_dir), LOW, HIGH)


@query
def range_select_wide(spark, sf_dir):
    path = scratch_path(spark, "clustered")
    tables.write_clustered(fx.alt_allele(spark, sf_dir), path)
    return cohort.in_range(tables.scan_dir(spark, path, ALT_ALLELE), LOW, WIDE_HIGH)


@query
def range_count_stored(spark, sf_dir):
    """The same count on a stored clustered table, where the filter skips row groups."""
    path = scratch_path(spark, "clustered")
    tables.write_clustered(fx.alt_allele(spark, sf_dir), path, then_by=("ref", "allele"))
    return cohort.count_in_range(tables.scan_dir(spark, path, ALT_ALLELE), LOW, HIGH)


@query
def range_count_stored_condensed(spark, sf_dir):
    path = scratch_path(spark, "condensed")
    tables.write_clustered(cohort.condense(fx.alt_allele(spark, sf_dir)), path, then_by=("ref", "allele"))
    return cohort.count_in_range(tables.scan_dir(spark, path), LOW, HIGH)


@query
def gene_filter_stored(spark, sf_dir):
    """The gene filter on an annotation table stored in gene order."""
    path = scratch_path(spark, "vat")
    tables.write_clustered(fx.vat(spark, sf_dir), path, by=("gene_symbol",), then_by=("position",))
    return vat_as_text(annotate.in_genes(tables.scan_dir(spark, path, VAT)))


@query
def range_select_condensed(spark, sf_dir):
    return ids_as_text(cohort.in_range(cohort.condense(fx.alt_allele(spark, sf_dir)), LOW, HIGH))


@query
def filter_sample(spark, sf_dir):
    return fx.alt_allele(spark, sf_dir).where(F.col("sample_id") == 41)


@query
def member_of_set(spark, sf_dir):
    return cohort.with_sample(merge_of_halves(spark, sf_dir), 1).drop("sample_ids")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, of which a part came as a second batch."""
    path, calls = scratch_path(spark, "postings"), fx.alt_allele(spark, sf_dir)
    late = F.col("location") % 5 == 0
    postings.write_postings(calls.where(~late), path)
    postings.write_postings(calls.where(late), path, mode="append")
    return postings.read_postings(spark, path)


@query
def member_of_set_indexed(spark, sf_dir):
    """Variants of one sample from the posting index alone."""
    return postings.variants_of(_postings(spark, sf_dir), 1)


@query
def postings_in_range(spark, sf_dir):
    return postings.variants_in_range(_postings(spark, sf_dir), 1, LOW, HIGH)


@query
def shared_variants(spark, sf_dir):
    return postings.shared_variants(_postings(spark, sf_dir), 1, 2)


@query
def posting_counts(spark, sf_dir):
    index = postings.postings(fx.alt_allele(spark, sf_dir))
    return index.groupBy("sample_id").agg(F.sum("n").alias("variants"), F.count("*").alias("windows"))


@query
def canonical_filter(spark, sf_dir):
    return vat_as_text(annotate.canonical(fx.vat(spark, sf_dir)))


@query
def clinvar_filter(spark, sf_dir):
    return vat_as_text(annotate.pathogenic(fx.vat(spark, sf_dir)))


@query
def gene_filter(spark, sf_dir):
    return vat_as_text(annotate.in_genes(fx.vat(spark, sf_dir)))


@query
def consequence_overlap(spark, sf_dir):
    return vat_as_text(annotate.with_consequence(fx.vat(spark, sf_dir), TERMS))


def _masked(spark: SparkSession, sf_dir: str, column: str) -> tuple[DataFrame, list[str]]:
    """The annotation table stored with masks of a list column, and the column's dictionary."""
    path, rows = scratch_path(spark, "masked"), fx.vat(spark, sf_dir)
    dictionary = terms.term_dictionary(rows, column)
    masked = terms.with_masks(rows, column, dictionary, "mask")
    tables.write_dir(masked, path)
    return tables.scan_dir(spark, path, masked.schema), dictionary


@query
def consequence_overlap_masked(spark, sf_dir):
    """The overlap as a test of one whole number per row."""
    rows, dictionary = _masked(spark, sf_dir, "consequence")
    return vat_as_text(rows.where(terms.has_any("mask", dictionary, TERMS)))


@query
def clinvar_filter_masked(spark, sf_dir):
    rows, dictionary = _masked(spark, sf_dir, "clinvar_classification")
    return vat_as_text(rows.where(terms.labelled_pathogenic("mask", dictionary)))


@query
def call_quality_filter(spark, sf_dir):
    return annotate.good_calls(fx.alt_allele(spark, sf_dir))


@query
def sample_status_filter(spark, sf_dir):
    return annotate.active_samples(fx.sample_info(spark, sf_dir))


@query
def empty_check(spark, sf_dir):
    empty = fx.alt_allele(spark, sf_dir).isEmpty()
    return spark.range(1).select(F.lit("alt_allele").alias("table_name"), F.lit(empty).alias("is_empty"))


# -- allele expansion -------------------------------------------------------------------------


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand.with_allele_positions(fx.raw_variants(spark, sf_dir))


def _alt() -> Column:
    return alleles.comma_item(F.col("alt"), F.col("allele_pos"))


@query
def minimize_alleles(spark, sf_dir):
    picked = _positions(spark, sf_dir).withColumn("alt_allele", _alt())
    trimmed = picked.withColumn("pair", alleles.minimize(F.col("ref"), F.col("alt_allele")))
    return trimmed.select(
        "location", "sample_id", "ref", "alt_allele",
        F.col("pair.ref").alias("min_ref"), F.col("pair.allele").alias("min_allele"),
    )


@query
def minimize_text(spark, sf_dir):
    pair = alleles.minimize_text(F.col("ref"), _alt()).alias("pair")
    return _positions(spark, sf_dir).select("location", "sample_id", pair)


@query
def expand_alt_alleles(spark, sf_dir):
    return fx.alt_allele(spark, sf_dir)


@query
def pick_alt(spark, sf_dir):
    return _positions(spark, sf_dir).select(
        "location", "sample_id", "alt", "allele_pos", _alt().alias("picked")
    )


@query
def pick_raw_mq(spark, sf_dir):
    item = numbers.parse_long(alleles.pipe_item(F.col("as_raw_mq"), F.col("allele_pos") + 1))
    return _positions(spark, sf_dir).select(
        "location", "sample_id", "as_raw_mq", "allele_pos", item.alias("raw_mq")
    )


@query
def pick_qual(spark, sf_dir):
    item = numbers.lenient_long(alleles.pipe_item(F.col("as_qualapprox"), F.col("allele_pos")))
    return _positions(spark, sf_dir).select(
        "location", "sample_id", "as_qualapprox", "allele_pos", item.alias("qual")
    )


@query
def pick_depths(spark, sf_dir):
    ref_ad = numbers.lenient_long(alleles.comma_item(F.col("call_AD"), 1)).alias("ref_ad")
    ad = numbers.lenient_long(alleles.comma_item(F.col("call_AD"), F.col("allele_pos") + 1)).alias("ad")
    return _positions(spark, sf_dir).select("location", "sample_id", "call_AD", ref_ad, ad)


@query
def pass_through(spark, sf_dir):
    return fx.alt_allele(spark, sf_dir).select(
        "location", "sample_id", "call_GT", "call_GQ", "as_raw_mq", "as_raw_mqranksum",
        "as_raw_readposranksum", "as_sb_table", "call_AD",
    )


@query
def calls_per_genotype(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    return calls.groupBy("allele_pos", "call_GT").agg(F.count("*").alias("n"))


# -- joins ------------------------------------------------------------------------------------


@query
def variant_allele_join(spark, sf_dir):
    return annotate.pathogenic_carriers(fx.vat(spark, sf_dir), fx.alt_allele(spark, sf_dir))


@query
def variant_allele_join_bucketed(spark, sf_dir):
    """The cohort question on stored tables that share buckets of the variant keys."""
    calls = pin(fx.alt_allele(spark, sf_dir))
    dealt = parts_for(calls.count(), 8)
    stored = (
        buckets.write_bucketed(annotate.located(fx.vat(spark, sf_dir)), _name("vat"), VARIANT_KEYS, dealt),
        buckets.write_bucketed(calls, _name("calls"), VARIANT_KEYS, dealt, stored=True),
    )
    return annotate.bucketed_pathogenic_carriers(spark, *stored)


@query
def bucketed_rows(spark, sf_dir):
    """Every call from a bucketed table, those of hot variants too."""
    calls = pin(fx.alt_allele(spark, sf_dir))
    dealt = parts_for(calls.count(), 64)
    return buckets.write_bucketed(calls, _name("calls"), VARIANT_KEYS, dealt, stored=True).rows(spark)


@query
def variant_sample_join(spark, sf_dir):
    return annotate.pathogenic_carriers(
        fx.vat(spark, sf_dir), fx.alt_allele(spark, sf_dir), fx.sample_info(spark, sf_dir)
    )


@query
def holdout_anti(spark, sf_dir):
    return cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)[0]


@query
def holdout_inner(spark, sf_dir):
    return cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)[1]


@query
def exists_subquery(spark, sf_dir):
    return annotate.consequence_carriers(
        fx.vat(spark, sf_dir), fx.alt_allele(spark, sf_dir), "BRCA1", TERMS
    )


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = pin(model.model_weights(fx.alt_allele(spark, sf_dir)))
    total = weights.total_weight(bins).scalar()
    drawn = fx.draws(spark, sf_dir).withColumn("u", synth.draw_weight(fixed_noise(), total))
    return weights.nearest_bucket(drawn, weights.cumulative_weight(bins), weights.cell_width(bins))


@query
def nearest_bucket(spark, sf_dir):
    return _picked(spark, sf_dir).select("sample_id", "draw_no", "u", "bucket", "cw", "weight")


def _bins(calls: DataFrame) -> DataFrame:
    return model.model_weights(calls).withColumnRenamed("location", "bucket")


@query
def spike_lookup(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    return model.spike_lookup(_bins(calls), model.model_spikes(calls, min_share=0.5))


@query
def bitmap_lookup(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    return model.bitmap_lookup(_bins(calls), model.model_bitmaps(calls))


@query
def bins_without_bitmap(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    upper_half = model.model_bitmaps(calls).where(F.col("high_bits") != 0)
    return model.bins_without_bitmap(_bins(calls), upper_half)


@query
def reference_base_lookup(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    rows = calls.select("location", "sample_id", "allele")
    return model.reference_base_lookup(rows, fx.genome(calls))


@query
def reference_base_lookup_packed(spark, sf_dir):
    """The same bases from a genome stored with two bits a base."""
    path, calls = scratch_path(spark, "packed"), fx.alt_allele(spark, sf_dir)
    tables.write_dir(packed.packed_genome(fx.genome(calls)), path)
    rows = calls.select("location", "sample_id", "allele")
    return packed.packed_base_lookup(rows, tables.scan_dir(spark, path))


@query
def stats_lookup(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    stats = text_files.fill_stats(model.model_stats(calls))
    return rounded_stats(model.stats_lookup(calls.select("location", "sample_id"), stats))


def _slice(calls: DataFrame) -> DataFrame:
    bins = pin(model.model_weights(calls))
    total = weights.total_weight(bins).scalar()
    return weights.weight_slice(weights.cumulative_weight(bins), *SLICE, total)


@query
def slice_semi(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    return weights.slice_semi(model.model_bitmaps(calls), "bin", _slice(calls))


# -- aggregations -----------------------------------------------------------------------------


@query
def condense(spark, sf_dir):
    return ids_as_text(cohort.condense(fx.alt_allele(spark, sf_dir)))


@query
def condense_one_call(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir).select("location", "ref", "allele", "sample_id").distinct()
    return ids_as_text(cohort.condense(calls, one_call_per_sample=True))


@query
def condense_blocks(spark, sf_dir):
    return blocks_as_text(cohort.condense_blocks(fx.alt_allele(spark, sf_dir), width=10))


@query
def condense_bitmap(spark, sf_dir):
    """Carriers as bitmaps, decoded to lists."""
    blocks = bitmaps.condense_bitmap(fx.alt_allele(spark, sf_dir), BITMAP_BLOCK)
    return ids_as_text(bitmaps.carrier_lists(blocks, BITMAP_BLOCK))


@query
def carrier_total(spark, sf_dir):
    return bitmaps.carrier_total(bitmaps.condense_bitmap(fx.alt_allele(spark, sf_dir)))


@query
def carrier_counts(spark, sf_dir):
    return cohort.carrier_counts(fx.alt_allele(spark, sf_dir))


@query
def count_rows(spark, sf_dir):
    return fx.alt_allele(spark, sf_dir).agg(F.count("*").alias("n"))


@query
def gene_counts(spark, sf_dir):
    return annotate.gene_counts(fx.vat(spark, sf_dir))


@query
def classification_counts(spark, sf_dir):
    counts = annotate.classification_counts(fx.vat(spark, sf_dir))
    label = F.coalesce(F.array_join("clinvar_classification", ";"), F.lit("none"))
    return counts.select(label.alias("classification"), "n")


@query
def distinct_variants(spark, sf_dir):
    return annotate.distinct_variants(fx.vat(spark, sf_dir))


@query
def distinct_variants_with_consequence(spark, sf_dir):
    chosen = annotate.in_genes(annotate.canonical(fx.vat(spark, sf_dir)), ["BRCA1"])
    return annotate.distinct_variants(annotate.with_consequence(chosen, TERMS), consequence_text=True)


@query
def distinct_samples(spark, sf_dir):
    return fx.alt_allele(spark, sf_dir).select("sample_id").distinct()


@query
def total_weight(spark, sf_dir):
    return weights.total_weight(model.model_weights(fx.alt_allele(spark, sf_dir)))


# -- merge, set operations, sort, limit -------------------------------------------------------


def merge_of_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    master, new = cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)
    return cohort.merge_condensed(cohort.condense(master), cohort.condense(new))


@query
def merge_upsert(spark, sf_dir):
    return ids_as_text(merge_of_halves(spark, sf_dir))


@query
def merge_small_batch(spark, sf_dir):
    master, new = cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)
    return ids_as_text(cohort.merge_small_batch(cohort.condense(master), cohort.condense(new)))


@query
def merge_blocks(spark, sf_dir):
    master, new = cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)
    blocks = (cohort.condense_blocks(half, width=10) for half in (master, new))
    return blocks_as_text(cohort.merge_blocks(*blocks))


def _bitmap_halves(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    halves = cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)
    return [bitmaps.condense_bitmap(half, BITMAP_BLOCK) for half in halves]


@query
def merge_bitmap(spark, sf_dir):
    merged = bitmaps.merge_bitmap(*_bitmap_halves(spark, sf_dir))
    return ids_as_text(bitmaps.carrier_lists(merged, BITMAP_BLOCK))


@query
def merge_bitmap_batch(spark, sf_dir):
    merged = bitmaps.merge_bitmap_batch(*_bitmap_halves(spark, sf_dir))
    return ids_as_text(bitmaps.carrier_lists(merged, BITMAP_BLOCK))


@query
def bitmap_with_sample(spark, sf_dir):
    merged = bitmaps.merge_bitmap(*_bitmap_halves(spark, sf_dir))
    return bitmaps.bitmap_with_sample(merged, 1, BITMAP_BLOCK)


@query
def union_all(spark, sf_dir):
    raw = fx.raw_variants(spark, sf_dir)
    return expand.all_calls([expand.expand_alt_alleles(raw.where(F.col("call_GQ") % 2 == i)) for i in (0, 1)])


@query
def union_positional(spark, sf_dir):
    calls = fx.alt_allele(spark, sf_dir)
    empty = spark.createDataFrame([], ALT_ALLELE)
    return empty.union(conform(calls, ALT_ALLELE))


@query
def sample_limit(spark, sf_dir):
    return cohort.holdout_ids(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)


@query
def first_row(spark, sf_dir):
    lowest = cohort.holdout_ids(fx.alt_allele(spark, sf_dir), NEW_SAMPLES).first()[0]
    return cohort.with_sample(merge_of_halves(spark, sf_dir), lowest).drop("sample_ids")


# -- running weights --------------------------------------------------------------------------


@query
def cumulative_weight(spark, sf_dir):
    return weights.cumulative_weight(model.model_weights(fx.alt_allele(spark, sf_dir)))


@query
def weight_slice(spark, sf_dir):
    return _slice(fx.alt_allele(spark, sf_dir))


# -- scalar functions -------------------------------------------------------------------------


@query
def encode_location(spark, sf_dir):
    at = coords.encode_location(F.col("contig"), F.col("position")).alias("location")
    return fx.vat(spark, sf_dir).select("contig", "position", at)


@query
def encode_location_mito(spark, sf_dir):
    at = coords.encode_location(F.col("contig"), F.col("position"), mito=True).alias("location")
    return fx.vat(spark, sf_dir).select("contig", "position", at)


@query
def decode_location(spark, sf_dir):
    spot = coords.decode_location(F.col("location"))
    return fx.raw_variants(spark, sf_dir).select(
        "location", spot["contig"].alias("contig"), spot["pos"].alias("pos")
    )


@query
def bitmap_offsets(spark, sf_dir):
    offsets = bits.set_offsets(F.col("low_bits"), F.col("high_bits"))
    return model.model_bitmaps(fx.alt_allele(spark, sf_dir)).select(
        "bin", F.array_join(offsets, ",").alias("offsets")
    )


@query
def bitmap_text(spark, sf_dir):
    return model.model_bitmaps(fx.alt_allele(spark, sf_dir)).select(
        "bin", bits.bit_text(F.col("low_bits"), F.col("high_bits")).alias("bits")
    )


def _lines(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    return fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns)


@query
def round_half_even(spark, sf_dir):
    return _lines(spark, sf_dir, numbers.half_even(F.col("l_quantity") / 2.0).alias("rounded"))


@query
def clamp_values(spark, sf_dir):
    value = F.col("l_quantity").cast("bigint") - 10
    return _lines(spark, sf_dir, numbers.clamp(value, 1, 30).alias("bounded"))


@query
def parse_or_default(spark, sf_dir):
    item = alleles.pipe_item(F.col("as_raw_mq"), 2)
    return fx.raw_variants(spark, sf_dir).select(
        "location", "sample_id", numbers.parse_double(item).alias("parsed")
    )


@query
def lenient_cast(spark, sf_dir):
    whole = numbers.lenient_long(F.col("l_quantity").cast("string")).alias("whole")
    return _lines(spark, sf_dir, whole, numbers.lenient_long(F.col("l_returnflag")).alias("unreadable"))


@query
def depth_pair(spark, sf_dir):
    pair = text.depth_pair(F.col("ref_ad"), F.col("ad")).alias("pair")
    return fx.alt_allele(spark, sf_dir).select("location", "sample_id", pair)


@query
def letter_case(spark, sf_dir):
    return fx.vat(spark, sf_dir).select(
        "vid", F.lower("ref_allele").alias("low"), F.upper("contig").alias("up")
    )


# -- SQL --------------------------------------------------------------------------------------


@query
def sql_functions(spark, sf_dir):
    named.register(spark)
    picked = _positions(spark, sf_dir).withColumn("picked", _alt())
    return picked.selectExpr(
        "location", "sample_id", "minimize(ref, picked) AS pair", "decode_location(location).pos AS pos"
    )


def _views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    names = {"calls": _name("calls"), "vat": _name("vat")}
    fx.alt_allele(spark, sf_dir).createOrReplaceTempView(names["calls"])
    fx.vat(spark, sf_dir).createOrReplaceTempView(names["vat"])
    return names


@query
def sql_range_count(spark, sf_dir):
    calls = _views(spark, sf_dir)["calls"]
    return questions.ask(spark, "count_in_range", calls=calls, low=LOW, high=HIGH)


@query
def sql_range_rows(spark, sf_dir):
    calls = _views(spark, sf_dir)["calls"]
    return questions.ask(spark, "rows_in_range", calls=calls, low=LOW, high=HIGH)


@query
def sql_gene_counts(spark, sf_dir):
    return questions.ask(spark, "gene_counts", vat=_views(spark, sf_dir)["vat"])


@query
def sql_cohort(spark, sf_dir):
    return questions.pathogenic_carriers(spark, **_views(spark, sf_dir))


def _question(spark: SparkSession, sf_dir: str, call: str) -> DataFrame:
    prefix = _name("q") + "_"
    named.register_questions(spark, **_views(spark, sf_dir), prefix=prefix)
    return spark.sql(f"SELECT * FROM {prefix}{call}")


@query
def table_function_range(spark, sf_dir):
    return _question(spark, sf_dir, f"calls_in_range({LOW}, {HIGH})")


@query
def table_function_gene(spark, sf_dir):
    return _question(spark, sf_dir, "variants_of_gene('BRCA1')")


@query
def table_function_cohort(spark, sf_dir):
    return _question(spark, sf_dir, "pathogenic_carriers(20, 20)")


# -- generator model and steps ----------------------------------------------------------------


@query
def model_weights(spark, sf_dir):
    return model.model_weights(fx.alt_allele(spark, sf_dir))


@query
def model_stats(spark, sf_dir):
    return rounded_stats(model.model_stats(fx.alt_allele(spark, sf_dir)))


@query
def model_bitmaps(spark, sf_dir):
    return model.model_bitmaps(fx.alt_allele(spark, sf_dir))


@query
def model_spikes(spark, sf_dir):
    return model.model_spikes(fx.alt_allele(spark, sf_dir))


@query
def model_bins(spark, sf_dir):
    return model.model_bins(fx.alt_allele(spark, sf_dir))


def _model_of_batches(spark: SparkSession, sf_dir: str) -> model_state.ModelState:
    """The state after three batches of samples, each merged into the stored one before."""
    path, calls = scratch_path(spark, "model"), fx.alt_allele(spark, sf_dir)
    for version in range(3):
        model_state.update_state(calls.where(F.col("sample_id") % 3 == version), path, version)
    return model_state.read_state(spark, path, 2)


@query
def model_bins_updated(spark, sf_dir):
    return model_state.state_bins(_model_of_batches(spark, sf_dir))


@query
def model_stats_updated(spark, sf_dir):
    return rounded_stats(model_state.state_stats(_model_of_batches(spark, sf_dir)))


@query
def gen_draws(spark, sf_dir):
    counts = fx.draws(spark, sf_dir).groupBy("sample_id").agg(F.count("*").alias("draws"))
    return synth.draws_of(counts).groupBy("sample_id").agg(
        F.count("*").alias("draws"), F.max("draw_no").alias("last_draw")
    )


@query
def gen_pick_bin(spark, sf_dir):
    return _picked(spark, sf_dir).select("sample_id", "draw_no", "bucket")


def _alias_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bins = pin(model.model_weights(fx.alt_allele(spark, sf_dir)))
    return tuple(pin(t) for t in alias.block_tables(bins, ALIAS_BLOCK))


@query
def alias_tables(spark, sf_dir):
    """Slots of all bins, by block."""
    return _alias_tables(spark, sf_dir)[1]


@query
def alias_shares(spark, sf_dir):
    """What a bin's slots hold together: its weight times the bins of its block."""
    slots = _alias_tables(spark, sf_dir)[1]
    own = slots.select("bin", F.col("threshold").alias("held"))
    others = slots.select(F.col("other").alias("bin"), (F.col("total") - F.col("threshold")).alias("held"))
    return own.unionByName(others).groupBy("bin").agg(F.sum("held").alias("held"))


@query
def gen_pick_bin_alias(spark, sf_dir):
    rule = fixed_noise()
    drawn = alias.alias_draw(
        fx.draws(spark, sf_dir), _alias_tables(spark, sf_dir),
        (rule("block_slot"), rule("block_item")), (rule("bin_slot"), rule("bin_item")),
    )
    return drawn.select("sample_id", "draw_no", "bucket")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = synth.build_model(fx.alt_allele(spark, sf_dir))
    chunks = fx.genome(built.stats, "location_bin")
    return synth.place_draws(fx.draws(spark, sf_dir), built, chunks, fixed_noise())


@query
def gen_spike(spark, sf_dir):
    return _placed(spark, sf_dir).select(
        "sample_id", "draw_no", "bucket", "spiked", "spike_location", "spike_allele"
    )


@query
def gen_offset(spark, sf_dir):
    return _placed(spark, sf_dir).select("sample_id", "draw_no", "bucket", "offset_any", "offset_known")


def _anywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws placed anywhere in their bin."""
    offset = noise.whole(fixed_noise()("offset_any"), 100)
    return _picked(spark, sf_dir).select(
        "sample_id", "draw_no", (F.col("bucket") + offset).alias("location")
    )


def _based(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = fx.genome(fx.alt_allele(spark, sf_dir))
    found = model.reference_base_lookup(_anywhere(spark, sf_dir), chunks)
    return found.select("sample_id", "draw_no", "location", F.lower("ref_base").alias("base"))


@query
def gen_snp(spark, sf_dir):
    roll = noise.whole(fixed_noise()("snp"), 6) + 1
    usable = _based(spark, sf_dir).where(F.col("base").isin(*ALLOWED_BASES))
    return usable.withColumn("allele", synth.substitute(F.col("base"), roll))


@query
def gen_valid_base(spark, sf_dir):
    allowed = F.col("base").isin(*ALLOWED_BASES).alias("allowed")
    return _based(spark, sf_dir).groupBy(allowed, "base").agg(F.count("*").alias("n"))


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = text_files.fill_stats(model.model_stats(fx.alt_allele(spark, sf_dir)))
    found = model.stats_lookup(_anywhere(spark, sf_dir), stats)
    names = {"qual": "qual", "refad": "ref_ad", "ad": "ad", "gq": "gq"}
    made = (synth.metric(fixed_noise(), m).alias(names[m]) for m in METRICS)
    return found.select("sample_id", "draw_no", *made)


@query
def gen_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query
def gen_clamp(spark, sf_dir):
    return _metrics(spark, sf_dir).select(
        "sample_id", "draw_no",
        numbers.clamp(F.col("qual"), 0).alias("qual"),
        numbers.clamp(F.col("ref_ad"), 1).alias("ref_ad"),
        numbers.clamp(F.col("ad"), 1).alias("ad"),
        numbers.clamp(F.col("gq"), 1, MAX_GQ).alias("gq"),
    )


def _generated(spark: SparkSession, sf_dir: str, rule: noise.Noise | None, **slice_ends) -> DataFrame:
    built = synth.build_model(fx.alt_allele(spark, sf_dir))
    chunks = fx.genome(built.stats, "location_bin")
    if slice_ends:
        built = synth.slice_model(built, **slice_ends)
    return synth.generate(fx.draws(spark, sf_dir), built, chunks, rule, seed=1, **slice_ends)


@query
def gen_row(spark, sf_dir):
    return _generated(spark, sf_dir, fixed_noise())


@query
def gen_row_updated_model(spark, sf_dir):
    """The generator on a model that three batches of samples have built up."""
    built = synth.model_of_state(_model_of_batches(spark, sf_dir))
    chunks = fx.genome(built.stats, "location_bin")
    rows = synth.generate(fx.draws(spark, sf_dir), built, chunks, fixed_noise())
    # Deviations of united batches differ in the last digits, which a metric at a half may show.
    return rows.select("location", "sample_id", "ref", "allele", "allele_pos", "call_GT")


@query
def gen_load(spark, sf_dir):
    path = scratch_path(spark, "generated")
    clustered_path = scratch_path(spark, "loaded")
    text_files.write_sample_tsv(_generated(spark, sf_dir, fixed_noise()), path)
    target = spark.createDataFrame([], ALT_ALLELE)
    tables.write_clustered(text_files.load_samples(spark, path, target), clustered_path)
    return tables.scan_dir(spark, clustered_path, ALT_ALLELE)


def _checked(spark: SparkSession, sf_dir: str) -> quarantine.Load:
    """A load of sample files some of whose lines are short, long or not numeric."""
    path = scratch_path(spark, "delivered")
    fx.delivered_files(spark, sf_dir).write.partitionBy("sample").text(path)
    return quarantine.checked_load(spark, path)


@query
def load_checked(spark, sf_dir):
    return _checked(spark, sf_dir).loaded


@query
def load_rejected(spark, sf_dir):
    """Rows per reason, from the quarantine table."""
    path = scratch_path(spark, "quarantine")
    quarantine.quarantine(_checked(spark, sf_dir), path)
    return quarantine.rejected_by_reason(spark.read.parquet(path))


@query
def load_account(spark, sf_dir):
    return quarantine.account(_checked(spark, sf_dir))


@query
def gen_slice(spark, sf_dir):
    return _generated(spark, sf_dir, fixed_noise(), start=SLICE[0], end=SLICE[1])


@query
def gen_random(spark, sf_dir):
    """What must hold of hashed random samples, per sample that has draws."""
    calls = fx.alt_allele(spark, sf_dir)
    first, second = (pin(_generated(spark, sf_dir, None)) for _ in range(2))
    bins = model.model_weights(calls).select(F.col("location").alias("_bin")).distinct()
    bounded = (
        F.col("call_GQ").between(1, MAX_GQ) & (F.col("qual") >= 0) & (F.col("ref_ad") >= 1) & (F.col("ad") >= 1)
    )
    row = F.xxhash64("location", "ref", "allele", "call_GQ", "qual", "call_AD").cast("decimal(20,0)")
    # Bins are few beside the calls: measured and broadcast as a rule, so the calls of a hot bin are not sorted by one task.
    narrow = first.select("sample_id", numbers.floor_to(F.col("location"), 100).alias("_bin"), bounded.alias("_bounded"), row.alias("_row"))
    placed = join_measured(narrow, bins.withColumn("_in", F.lit(True)), ["_bin"], "left")
    kept = placed.groupBy("sample_id").agg(
        F.every(F.coalesce("_in", F.lit(False))).alias("in_bins"), F.every("_bounded").alias("bounded"), F.sum("_row").alias("_one")
    )
    again = second.groupBy("sample_id").agg(F.sum(row).alias("_two"))
    samples = fx.draws(spark, sf_dir).select("sample_id").distinct()
    checked = samples.join(kept, "sample_id", "left").join(again, "sample_id", "left")
    return checked.select(
        "sample_id",
        F.coalesce("in_bins", F.lit(True)).alias("in_bins"),
        F.coalesce("bounded", F.lit(True)).alias("bounded"),
        F.col("_one").eqNullSafe(F.col("_two")).alias("same_again"),
    )


# -- learning and streaming -------------------------------------------------------------------


@query
def assemble_features(spark, sf_dir):
    made = ml.assemble_features(fx.raw_variants(spark, sf_dir))
    parts = vector_to_array("features")
    return made.select(
        "location", "sample_id", "ref_index", "alt_index", parts[1].alias("location_feature")
    )


@query
def fit_gbt(spark, sf_dir):
    featured = pin(ml.assemble_features(fx.raw_variants(spark, sf_dir)).select("features", "alt_index"))
    fitted = ml.fit_allele_gbt(featured, maxIter=3, maxDepth=3, seed=1)
    error = F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("alt_index"), 2)))
    return fitted.transform(featured).agg(
        F.count("*").alias("n"),
        F.countDistinct("alt_index").alias("labels"),
        (error < F.stddev_pop("alt_index")).alias("better_than_the_mean"),
    )


@query
def ingest_stream_repeats(spark, sf_dir):
    """Samples that are delivered a second time, in files of other names."""
    master, new = cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)
    arriving, store = scratch_path(spark, "arriving"), scratch_path(spark, "store")
    ingest.create_store(cohort.condense(master), store)
    for _ in range(2):
        tables.write_dir(new.repartitionByRange(2, "location"), arriving, mode="append")
        ingest.ingest_stream(spark, arriving, store, repeats_within="30 days").awaitTermination()
    return ids_as_text(ingest.read_store(spark, store))


@query
def ingest_stream(spark, sf_dir):
    master, new = cohort.holdout(fx.alt_allele(spark, sf_dir), NEW_SAMPLES)
    arriving, store = scratch_path(spark, "arriving"), scratch_path(spark, "store")
    ingest.create_store(cohort.condense(master), store)
    # Three files, so three batches; each touches only some of the blocks.
    tables.write_dir(new.repartitionByRange(3, "location"), arriving)
    ingest.ingest_stream(spark, arriving, store, files_per_batch=1).awaitTermination()
    merged = ingest.read_store(spark, store)
    return ids_as_text(merged.withColumn("sample_ids", F.array_distinct("sample_ids")))
