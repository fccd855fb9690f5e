"""Synthetic samples that follow the distribution of a real cohort."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..constants import (
    ALLOWED_BASES,
    ALT_ALLELE_COLUMNS,
    DEFAULT_DRAWS,
    DEFAULT_SAMPLES,
    FAKE_GENOTYPE,
    MAX_GQ,
    STATS_BIN,
    TRANSITIONS,
    TRANSVERSIONS_1,
    TRANSVERSIONS_2,
    WARMUP_ROWS,
    WEIGHT_BIN,
)
from ..functions.bits import set_offsets
from ..functions.noise import Noise, choose, hash_noise, normal, whole
from ..functions.numbers import clamp, floor_to, half_even, int_div
from ..functions.text import depth_pair
from ..operators.joins import MAX_BROADCAST_BYTES, join_measured, measured_bytes
from ..operators.model import (
    METRICS,
    bin_bitmaps,
    bin_spikes,
    bin_weights,
    bitmap_lookup,
    model_bins,
    model_stats,
)
from ..operators.model_state import ModelState, state_bins, state_stats
from ..operators.weights import (
    cell_width,
    cumulative_weight,
    nearest_bucket,
    overlapping_slice,
    slice_semi,
    total_weight,
)
from ..schemas import ALT_ALLELE, STAT_METRICS, conform
from ..session import pin
from ..sources.text import fill_stats

NOISE_TAGS = (
    "bin", "spike", "offset_any", "offset_known", "snp",
    "qual_radius", "qual_angle", "refad_radius", "refad_angle",
    "ad_radius", "ad_angle", "gq_radius", "gq_angle",
    "block_slot", "block_item", "bin_slot", "bin_item",
)


# Draw numbers in a block of the warm-up's counts, a multiple of 16.
WARMUP_BLOCK = 64


class Model(NamedTuple):
    """The four tables a generator run draws from."""

    weights: DataFrame
    stats: DataFrame
    bitmaps: DataFrame
    spikes: DataFrame


def build_model(alt_allele: DataFrame) -> Model:
    """Derive the tables from called alleles: the columns they need are pinned once for both."""
    calls = pin(alt_allele.select("location", "allele", *METRICS.values()))
    bins = pin(model_bins(calls))
    stats = pin(fill_stats(model_stats(calls)))
    return Model(bin_weights(bins), stats, bin_bitmaps(bins), bin_spikes(bins))


def model_of_state(state: ModelState) -> Model:
    """The tables from partial states that batches of samples have updated; no call is read."""
    bins = pin(state_bins(state))
    stats = pin(fill_stats(state_stats(state)))
    return Model(bin_weights(bins), stats, bin_bitmaps(bins), bin_spikes(bins))


def slice_model(model: Model, start: float, end: float) -> Model:
    """The part of a model that one share of the weight needs; ``weights`` stays whole."""
    total = total_weight(model.weights).scalar()
    kept = overlapping_slice(cumulative_weight(model.weights), start, end, total)
    return Model(
        model.weights,
        slice_semi(model.stats, "location_bin", kept),
        slice_semi(model.bitmaps, "bin", kept),
        slice_semi(model.spikes, "bin", kept),
    )


def draw_rows(
    spark: SparkSession, samples: int = DEFAULT_SAMPLES, draws: int = DEFAULT_DRAWS
) -> DataFrame:
    """One row per sample and attempt, both counted from 1."""
    ids = spark.range(samples * draws)
    return ids.select(
        (int_div(F.col("id"), draws) + 1).alias("sample_id"),
        (F.col("id") % draws + 1).alias("draw_no"),
    )


def draws_of(counts: DataFrame) -> DataFrame:
    """One row per sample and attempt, for a table of sample_id and its number of draws."""
    return counts.where("draws > 0").select(
        "sample_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("draws").cast("bigint"))).alias("draw_no")
    )


def draw_weight(noise: Noise, total: Column, start: float = 0.0, end: float = 1.0) -> Column:
    """A whole number in the start-to-end share of 1..total."""
    share = F.lit(start) + noise("bin") * F.lit(end - start)
    return F.least(F.floor(share * total) + 1, total)


def substitute(base: Column, roll: Column) -> Column:
    """The allele for a lower-case base and a roll of 1 to 6."""

    def through(table: dict[str, str]) -> Column:
        return F.translate(base, "".join(table.keys()), "".join(table.values()))

    return (
        F.when(roll <= 4, through(TRANSITIONS))
        .when(roll == 5, through(TRANSVERSIONS_1))
        .otherwise(through(TRANSVERSIONS_2))
    )


def bin_table(model: Model, genome: DataFrame, start: float = 0.0, end: float = 1.0) -> DataFrame:
    """All that a draw needs to know of its bin, so that a draw meets the model in one join.

    Running weight, known offsets, the bin's own bases, metrics of its block, and the dominant
    variant with its base and metrics. Work here grows with the genome, not with the draws.
    """
    cdf = cumulative_weight(model.weights)
    if (start, end) != (0.0, 1.0):
        cdf = overlapping_slice(cdf, start, end, total_weight(model.weights).scalar())
    metrics = model.stats.select("location_bin", F.struct(*STAT_METRICS).alias("metrics"))
    # Bytes, not text: cutting bytes out of a chunk does not count its characters first.
    chunks = genome.select(
        F.col("location").alias("location_bin"), F.col("bases").cast("binary").alias("_chunk")
    )

    def block_of(location: str) -> Column:
        return floor_to(F.col(location), STATS_BIN).alias("location_bin")

    def cut(location: str, width: int) -> Column:
        place = (F.col(location) - F.col("location_bin") + 1).cast("int")
        return F.substring(F.col("_chunk"), place, F.lit(width)).cast("string")

    spikes = (
        model.spikes.select("*", block_of("location"))
        .join(metrics, ["location_bin"], "left")
        .join(chunks, ["location_bin"], "left")
        .select(
            F.col("bin").alias("bucket"),
            F.col("location").alias("spike_location"),
            F.col("allele").alias("spike_allele"),
            F.col("percentage").alias("spike_share"),
            F.lower(cut("location", 1)).alias("spike_base"),
            F.col("metrics").alias("spike_metrics"),
        )
    )
    bins = cdf.withColumnRenamed("location", "bucket").join(spikes, ["bucket"], "left")
    bins = bitmap_lookup(bins, model.bitmaps, how="left")
    # Bits are turned into offsets here, once per bin; a draw only takes one element.
    known = set_offsets(F.coalesce("low_bits", F.lit(0)), F.coalesce("high_bits", F.lit(0)))
    return (
        bins.select("*", block_of("bucket"))
        .join(metrics, ["location_bin"], "left")
        .join(chunks, ["location_bin"], "left")
        .withColumns({"known": known, "bases": F.lower(cut("bucket", WEIGHT_BIN))})
        .drop("location_bin", "_chunk", "low_bits", "high_bits")
        .withColumnRenamed("bucket", "location")
    )


def place_draws(
    draws: DataFrame,
    model: Model,
    genome: DataFrame,
    noise: Noise,
    start: float = 0.0,
    end: float = 1.0,
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Weighted bin, spike decision and the two candidate offsets and bases of every draw.

    The bins are computed once and pinned (an action), and measured: below the bound they are
    broadcast, above it draws and bins are shuffled by lookup cell, over which draws spread
    evenly.
    """
    total = total_weight(model.weights).scalar()
    bins = pin(bin_table(model, genome, start, end))
    placed = nearest_bucket(
        draws.withColumn("u", draw_weight(noise, total, start, end)),
        bins,
        cell_width(model.weights),
        # A bin is listed once for every cell it touches. Widths are whole numbers, so there may be
        # up to 1.5 cells per bin: at most 2.5 rows for each.
        broadcast_bins=3 * measured_bytes(bins) <= max_bytes,
    )
    offsets = placed.withColumns(
        {
            "spiked": F.coalesce(noise("spike") < F.col("spike_share"), F.lit(False)),
            "offset_any": whole(noise("offset_any"), WEIGHT_BIN),
            "offset_known": choose(noise("offset_known"), F.col("known")),
        }
    )

    def base_at(offset: str) -> Column:
        return F.substring(F.col("bases"), F.col(offset) + 1, F.lit(1))

    based = offsets.withColumns(
        {"base_any": base_at("offset_any"), "base_known": base_at("offset_known")}
    )
    return based.drop("known", "bases", "u", "cw", "weight")


def warmup_ends(rows: DataFrame, warmup: int = WARMUP_ROWS) -> DataFrame:
    """Per sample, the draw that completes its first ``warmup`` accepted rows, if it has as many (actions).

    Accepted draws are counted per sample and block of draw numbers, with a counter of four bits for each
    number, 16 in a word. These combine before the shuffle, so a sample with a third of all draws sends few
    rows. The block in which the count reaches ``warmup`` tells the draw by its counters. Only where a
    number comes too often for its counter, and the counters don't add up, the block's rows are ranked.
    """
    by_spike = F.col("spiked") & F.col("spike_base").isNotNull()
    by_base = ~F.col("spiked") & F.col("base_any").isin(*ALLOWED_BASES)
    offset = F.pmod(F.col("draw_no"), F.lit(WARMUP_BLOCK))
    accepted = rows.where(by_spike | by_base).select(
        "sample_id", "draw_no", offset.cast("int").alias("_offset"), (F.col("draw_no") - offset).alias("_block")
    )
    words = {first: f"_word_{first}" for first in range(0, WARMUP_BLOCK, 16)}
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_offset") % 16 * 4)

    def counted(first: int) -> Column:
        here = int_div(F.col("_offset"), 16) == first // 16
        return F.try_sum(F.when(here, one).otherwise(F.lit(0).cast("bigint"))).alias(words[first])

    def listed(first: int) -> Column:
        """The word's numbers, each as often as it was counted."""

        def repeated(i: Column) -> Column:
            count = F.call_function("shiftrightunsigned", F.col(words[first]), i * 4).bitwiseAND(F.lit(15))
            return F.array_repeat(i + first, count.cast("int"))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), repeated))

    counts = accepted.groupBy("sample_id", "_block").agg(F.count("*").alias("_n"), *map(counted, words))
    upto = F.sum("_n").over(Window.partitionBy("sample_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    reached = counts.withColumn("_upto", upto).where((F.col("_upto") >= warmup) & (F.col("_upto") - F.col("_n") < warmup))
    told = reached.withColumns({"_wanted": F.lit(warmup) - F.col("_upto") + F.col("_n"), "_listed": F.concat(*map(listed, words))})
    whole_list = F.coalesce(F.size("_listed") == F.col("_n"), F.lit(False))
    nth = F.try_element_at("_listed", F.col("_wanted").cast("int"))
    found = pin(told.select("sample_id", "_block", "_wanted", whole_list.alias("_told"), (F.col("_block") + nth).alias("warmup_end")))
    ends = found.where("_told").select("sample_id", "warmup_end")
    unclear = found.where("NOT _told AND _block IS NOT NULL").select("sample_id", "_block", "_wanted")
    if unclear.isEmpty():
        return ends
    rank = F.row_number().over(Window.partitionBy("sample_id", "_block").orderBy("draw_no"))
    ranked = join_measured(accepted, unclear, ["sample_id", "_block"]).withColumn("_rank", rank)
    return ends.unionByName(ranked.where("_rank = _wanted").select("sample_id", F.col("draw_no").alias("warmup_end")))


def generate(
    draws: DataFrame,
    model: Model,
    genome: DataFrame,
    noise: Noise | None = None,
    seed: int = 0,
    start: float = 0.0,
    end: float = 1.0,
    warmup: int = WARMUP_ROWS,
) -> DataFrame:
    """Synthetic calls for draws of (sample_id, draw_no), in the columns of the expanded table.

    ``genome`` holds located chunks of 10,000 bases. The first ``warmup`` accepted rows of a
    sample fall anywhere in their bin, later ones on its known offsets. Draws whose block has no
    metrics, whose base is not g, a, t or c, or that find no known offset yield no row. Pinning
    the bins and the ends of the warm-up are actions; the calls themselves are lazy.
    """
    noise = noise or hash_noise(seed)
    rows = place_draws(draws, model, genome, noise, start, end).withColumn(
        "stats", F.when(F.col("spiked"), F.col("spike_metrics")).otherwise(F.col("metrics"))
    )
    rows = rows.where(F.col("stats").isNotNull()).drop("metrics", "spike_metrics")
    anywhere = F.lit(False)
    if warmup > 0:
        # One row per sample: measured and broadcast as a rule, so the rows are not shuffled by sample.
        rows = join_measured(rows, warmup_ends(rows, warmup), ["sample_id"], "left")
        anywhere = F.col("warmup_end").isNull() | (F.col("draw_no") <= F.col("warmup_end"))
    return _finish(rows, anywhere, noise)


def _finish(rows: DataFrame, anywhere: Column, noise: Noise) -> DataFrame:
    """Choose base, allele and metrics of every row and drop the draws that fail."""
    offset = F.when(anywhere, F.col("offset_any")).otherwise(F.col("offset_known"))
    base = F.when(anywhere, F.col("base_any")).otherwise(F.col("base_known"))
    chosen = rows.withColumns(
        {
            "location": F.when(F.col("spiked"), F.col("spike_location")).otherwise(
                F.col("bucket") + offset
            ),
            "base": F.when(F.col("spiked"), F.col("spike_base")).otherwise(base),
        }
    ).where(F.col("base").isNotNull() & (F.col("spiked") | F.col("base").isin(*ALLOWED_BASES)))
    roll = whole(noise("snp"), 6) + 1
    allele = F.when(F.col("spiked"), F.col("spike_allele")).otherwise(
        substitute(F.col("base"), roll)
    )
    called = chosen.withColumns(
        {
            "ref": F.upper("base"),
            "allele": F.upper(allele),
            "allele_pos": F.lit(1),
            "call_GT": F.lit(FAKE_GENOTYPE),
            "call_GQ": clamp(metric(noise, "gq", "stats."), 1, MAX_GQ),
            "qual": clamp(metric(noise, "qual", "stats."), 0),
            "ref_ad": clamp(metric(noise, "refad", "stats."), 1),
            "ad": clamp(metric(noise, "ad", "stats."), 1),
        }
    ).withColumn("call_AD", depth_pair(F.col("ref_ad"), F.col("ad")))
    missing = [c for c in ALT_ALLELE_COLUMNS if c not in called.columns]
    return conform(called.withColumns({c: F.lit(None) for c in missing}), ALT_ALLELE)


def metric(noise: Noise, name: str, prefix: str = "") -> Column:
    """A whole number around the average of the block."""
    average, spread = F.col(f"{prefix}avg_{name}"), F.col(f"{prefix}stddev_{name}")
    return half_even(average + normal(noise, name) * spread)
