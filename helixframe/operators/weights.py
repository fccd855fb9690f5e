"""Running weights over the genome and the weighted draw of a bin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import CONTIG_FACTOR, STATS_BIN
from ..functions.numbers import floor_to, int_div

# Width of the blocks that running sums are split into, in bases.
BLOCK_BASES = 1_000_000


def total_weight(weights: DataFrame) -> DataFrame:
    """One row with the sum of all weights."""
    return weights.agg(F.sum("weight").alias("total_weight"))


def cumulative_weight(weights: DataFrame) -> DataFrame:
    """Add ``cw``, the running sum of weight in location order; zero weights are left out.

    Three levels, so that no window is wider than a block, a contig's blocks or the list of
    contigs: sum per block of a million bases, running sum of the blocks within a contig and of
    the contigs, then the running sum inside each block shifted by its offset. Sums stay whole
    numbers.
    """
    location = F.col("location")
    bins = weights.where(F.col("weight") != 0).withColumns(
        {
            "_contig": int_div(location, CONTIG_FACTOR),
            "_block": int_div(location, BLOCK_BASES),
        }
    )
    blocks = bins.groupBy("_contig", "_block").agg(F.sum("weight").alias("_sum"))
    contigs = blocks.groupBy("_contig").agg(F.sum("_sum").alias("_contig_sum"))

    def before(value: str, window) -> Column:
        past = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(past), F.lit(0))

    contig_offsets = contigs.select(
        "_contig", before("_contig_sum", Window.orderBy("_contig")).alias("_contig_offset")
    )
    within_contig = Window.partitionBy("_contig").orderBy("_block")
    block_offsets = (
        blocks.withColumn("_block_offset", before("_sum", within_contig))
        .join(contig_offsets, ["_contig"])
        .select("_contig", "_block", (F.col("_block_offset") + F.col("_contig_offset")).alias("_offset"))
    )
    within_block = Window.partitionBy("_contig", "_block").orderBy("location").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = bins.withColumn("_inner", F.sum("weight").over(within_block))
    return running.join(block_offsets, ["_contig", "_block"]).select(
        "location", "weight", (F.col("_inner") + F.col("_offset")).alias("cw")
    )


def weight_slice(cdf: DataFrame, start: float, end: float, total: Column | int) -> DataFrame:
    """Bins whose running share of the total lies in ``[start, end]``."""
    total = total if isinstance(total, Column) else F.lit(total)
    share = F.col("cw").cast("double") / total.cast("double")
    return cdf.where(share.between(start, end))


def overlapping_slice(cdf: DataFrame, start: float, end: float, total: Column | int) -> DataFrame:
    """Bins that a draw from the ``[start, end)`` share of 1..total can land in.

    A bin that straddles an end belongs to both neighbouring slices; each draw lands in one.
    """
    total = (total if isinstance(total, Column) else F.lit(total)).cast("double")
    above = F.col("cw").cast("double") > F.lit(start) * total
    below = (F.col("cw") - F.col("weight")).cast("double") <= F.lit(end) * total
    return cdf.where(above & below)


def slice_semi(table: DataFrame, key: str, sliced: DataFrame) -> DataFrame:
    """Rows whose 10,000-base block holds a bin of the slice."""
    kept = sliced.select(floor_to(F.col("location"), STATS_BIN).alias("_stats_bin")).distinct()
    keyed = table.withColumn("_stats_bin", floor_to(F.col(key), STATS_BIN))
    return keyed.join(kept, ["_stats_bin"], "left_semi").drop("_stats_bin")


def cell_width(weights: DataFrame) -> Column:
    """Width of a lookup cell, as a scalar subquery: about one bin per cell."""
    bins = weights.where(F.col("weight") != 0)
    width = F.greatest(int_div(F.sum("weight"), F.greatest(F.count("*"), F.lit(1))), F.lit(1))
    return bins.agg(width.alias("width")).scalar()


def nearest_bucket(
    draws: DataFrame, cdf: DataFrame, width: Column, draw: str = "u", broadcast_bins: bool = False
) -> DataFrame:
    """Attach to each draw the bin with the smallest running weight at or above it.

    ``u`` counts from 1. A bin covers ``(cw - weight, cw]`` and is listed in every cell it
    touches, so the lookup is an equality join on the cell that yields one row per draw. Draws
    spread evenly over cells whatever the weights are: a bin with a third of all weight owns a
    third of the cells. Draws that no bin covers are left out. Set ``broadcast_bins`` for bins
    of a measured size only.
    """
    low, high = F.col("cw") - F.col("weight"), F.col("cw")
    cells = F.sequence(int_div(low, F.col("_width")), int_div(high - 1, F.col("_width")))
    listed = (
        cdf.withColumn("_width", width)
        .withColumn("_cell", F.explode(cells))
        .drop("_width")
        .withColumnRenamed("location", "bucket")
    )
    placed = draws.withColumn("_cell", int_div(F.col(draw) - 1, width))
    covers = (F.col(f"d.{draw}") > F.col("b.cw") - F.col("b.weight")) & (F.col(f"d.{draw}") <= F.col("b.cw"))
    # Bins are the few rows of a cell: hashed there, the draws need no sort.
    listed = F.broadcast(listed) if broadcast_bins else listed.hint("shuffle_hash")
    joined = placed.alias("d").join(
        listed.alias("b"), (F.col("d._cell") == F.col("b._cell")) & covers
    )
    return joined.select(
        *(F.col(f"d.{c}") for c in draws.columns),
        *(F.col(f"b.{c}") for c in listed.columns if c != "_cell"),
    )
