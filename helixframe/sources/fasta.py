"""A reference genome in FASTA text as fixed-width chunks of bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..constants import STATS_BIN
from ..functions.coords import encode_location
from ..functions.numbers import int_div


def scan_fasta(
    spark: SparkSession, path: str, chunk: int = STATS_BIN, position_base: int = 1
) -> DataFrame:
    """FASTA files as rows of contig, chunk start and bases.

    A chunk holds the positions from its start to start + chunk - 1; the first base of a contig
    has position ``position_base`` and the place before it in the first chunk is filled with N.

    Files are read line by line and in splits, never a contig as a whole. What a line needs to
    know from before it, its contig and how many bases precede it, is summed per split first and
    carried over the few splits of a file, then resolved inside each split.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_line"),
            F.regexp_replace("value", r"\s+$", "").alias("_text"),
        )
        .where(F.length("_text") > 0)
    )
    is_header = F.col("_text").startswith(">")
    # Header text up to the first blank is the contig name.
    marked = lines.withColumns(
        {
            "_contig": F.when(is_header, F.regexp_extract("_text", r"^>\s*(\S*)", 1)),
            "_bases": F.when(~is_header, F.length("_text")).otherwise(F.lit(0)).cast("bigint"),
        }
    )
    in_split = Window.partitionBy("_file", "_split").orderBy("_line")
    so_far = in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    resolved = marked.withColumns(
        {
            "_own": F.last("_contig", ignorenulls=True).over(so_far),
            "_total": F.sum("_bases").over(so_far),
        }
    ).withColumn(
        # Running bases of the split at its latest header.
        "_at_header",
        F.max(F.when(F.col("_contig").isNotNull(), F.col("_total"))).over(so_far),
    )

    # Per split: its last header, and the bases after it (all bases where it has no header).
    splits = resolved.groupBy("_file", "_split").agg(
        F.max_by("_own", "_line").alias("_last"),
        (F.sum("_bases") - F.coalesce(F.max("_at_header"), F.lit(0))).alias("_tail"),
    )
    over_file = Window.partitionBy("_file").orderBy("_split")
    earlier = over_file.rowsBetween(Window.unboundedPreceding, -1)
    # Splits that continue the contig of one header form a group; their tails add up.
    in_group = Window.partitionBy("_file", "_group").orderBy("_split")
    carried = (
        splits.withColumn("_group", F.count("_last").over(over_file))
        .withColumn("_open", F.sum("_tail").over(in_group))
        .select(
            "_file",
            "_split",
            F.last("_last", ignorenulls=True).over(earlier).alias("_from_before"),
            F.coalesce(F.lag("_open").over(over_file), F.lit(0)).alias("_bases_before"),
        )
    )
    placed = (
        resolved.where(F.col("_contig").isNull())
        .join(carried, ["_file", "_split"])
        .select(
            F.coalesce("_own", "_from_before").alias("contig"),
            F.when(F.col("_own").isNotNull(), F.col("_total") - F.col("_at_header"))
            .otherwise(F.col("_total") + F.col("_bases_before"))
            .alias("_end"),
            F.col("_bases"),
            F.col("_text"),
        )
        .withColumn("_from", F.col("_end") - F.col("_bases") + position_base)
    )
    return _chunked(placed.where(F.col("contig").isNotNull()), chunk, position_base)


def _chunked(placed: DataFrame, chunk: int, position_base: int) -> DataFrame:
    """Cut lines at chunk borders and join the pieces of a chunk; a chunk has at most ``chunk`` pieces."""
    last = F.col("_from") + F.col("_bases") - 1
    pieces = placed.withColumn(
        "_chunk", F.explode(F.sequence(int_div(F.col("_from"), chunk), int_div(last, chunk)))
    )
    start = F.col("_chunk") * chunk
    skip = F.greatest(start - F.col("_from"), F.lit(0))
    piece = F.substring(
        F.col("_text"),
        (skip + 1).cast("int"),
        (F.least(last, start + chunk - 1) - F.greatest(F.col("_from"), start) + 1).cast("int"),
    )
    at = F.greatest(F.col("_from"), start).alias("at")
    grouped = pieces.groupBy("contig", start.alias("chunk_start")).agg(
        F.array_sort(F.collect_list(F.struct(at, piece.alias("text")))).alias("_pieces")
    )
    bases = F.array_join(F.transform("_pieces", lambda p: p["text"]), "")
    pad = F.when(F.col("chunk_start") == 0, "N" * position_base).otherwise("")
    return grouped.select("contig", "chunk_start", F.concat(pad, bases).alias("bases"))


def located(genome: DataFrame) -> DataFrame:
    """Chunks of numbered contigs with their start as a location."""
    at = encode_location(F.col("contig"), F.col("chunk_start"), mito=True)
    return genome.withColumn("location", at).where(F.col("location").isNotNull())
