"""Layout by several columns at once: rows in Z-order of the ranges that their values fall into.

A column's values are ranked by range bounds that hold about the same number of rows each, taken
from a bounded sample; the bits of the ranks are interleaved to one key, and files are ranges of the
key. A file is then a small box of every column, and a filter on any of them skips most files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import parts_for, scratch_path

#: Bits of a column's rank; 2^bits ranges.
BITS = 6
SAMPLE_ROWS = 20_000


def range_bounds(df: DataFrame, columns: Sequence[str], bits: int = BITS, rows: int | None = None) -> dict[str, list]:
    """Values that part each column into about equal ranges (an action).

    Only the layout follows from the sample, at most about ``SAMPLE_ROWS`` rows come to the driver.
    """
    total = df.count() if rows is None else rows
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    drawn = df.select(*columns)
    drawn = (drawn.sample(share, seed=1) if share < 1 else drawn).limit(2 * SAMPLE_ROWS).collect()
    bounds = {}
    for i, column in enumerate(columns):
        values = sorted(r[i] for r in drawn if r[i] is not None)
        cuts = [values[len(values) * k // 2**bits] for k in range(1, 2**bits)] if values else []
        # A value that fills several ranges is one bound, and a range of its own.
        bounds[column] = list(dict.fromkeys(cuts))
    return bounds


def rank_of(column: Column, bounds: list) -> Column:
    """How many bounds a value reaches, by bisection in generated code; NULL is 0."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column >= F.lit(bounds[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(bounds))


def z_key(ranks: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of the ranks in turn, highest first."""
    if len(ranks) * bits > 62:
        raise ValueError("too many bits for one key")
    key = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i, rank in enumerate(ranks):
            own = F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("bigint")
            key = key + F.call_function("shiftleft", own, F.lit(bit * len(ranks) + len(ranks) - 1 - i))
    return key


def z_ordered(df: DataFrame, by: Sequence[str], files: int, bits: int = BITS, bounds: dict[str, list] | None = None) -> DataFrame:
    """Range-partition by the Z-order key and sort inside (actions unless bounds are given).

    With many rows there are more than ``files`` files, so that no task's share grows with the table. The values and the source partition take part in the ranges, so that a hot box, or copies of one
    row, are spread over several files.
    """
    if bounds is None:
        rows = df.count()
        bounds, files = range_bounds(df, by, bits, rows), parts_for(rows, files)
    ranks = {f"_rank{i}": rank_of(F.col(c), bounds[c]) for i, c in enumerate(by)}
    keyed = df.withColumns(ranks).withColumn("_z", z_key([F.col(r) for r in ranks], bits)).drop(*ranks)
    spread = keyed.withColumn("_source", F.spark_partition_id())
    ranged = spread.repartitionByRange(files, "_z", *by, "_source")
    return ranged.sortWithinPartitions("_z", *by).drop("_z", "_source")


def write_z_ordered(
    df: DataFrame, path: str, by: Sequence[str], files: int, bits: int = BITS, staged: bool = False, mode: str = "errorifexists"
) -> None:
    """Write a folder in Z-order.

    The input is read twice besides the write, for its bounds and for the range sampling; unless it
    is a stored table (``staged``), it is written once to the shared folder first.
    """
    spark = df.sparkSession
    if not staged:
        stage = scratch_path(spark, "unordered")
        df.write.parquet(stage)
        df = spark.read.schema(df.schema).parquet(stage)
    z_ordered(df, by, files, bits).write.mode(mode).parquet(path)


def compact_z_ordered(spark: SparkSession, source: str, target: str, by: Sequence[str], files: int, bits: int = BITS) -> DataFrame:
    """Rewrite a folder in Z-order and read that; both must hold the same number of rows."""
    rows = spark.read.parquet(source)
    write_z_ordered(rows, target, by, files, bits, staged=True)
    written = spark.read.schema(rows.schema).parquet(target)
    before, after = rows.count(), written.count()
    if before != after:
        raise RuntimeError(f"{target} holds {after} rows, {source} {before}")
    return written


def box_of_files(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Least and greatest value of the columns in every file: what a filter can skip by."""
    rows = spark.read.parquet(path).select("_metadata.file_name", *columns)
    ends = [f(c).alias(f"{label}_{c}") for c in columns for f, label in ((F.min, "min"), (F.max, "max"))]
    return rows.groupBy("file_name").agg(F.count("*").alias("n"), *ends)
