"""Tables stored in buckets of a join's keys, so that the join needs no shuffle.

Both tables are dealt into the same number of buckets by the same keys and sorted by them, a file per
bucket. A key with far more rows than a bucket should hold would make one task of the join; such
keys are stored in a table of their own. There are at most as many of them as their share allows
(``HOT_SHARE`` of a bucket each), so the other side's rows of these keys are few and are broadcast after
they are measured.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.joins import join_measured
from ..session import pin, scratch_path

#: A key with more rows than so many mean buckets is hot.
HOT_SHARE = 4


@dataclass
class BucketedTable:
    """Names of the bucketed table and of the hot keys' table, and how they are dealt."""

    name: str
    hot_name: str
    keys: tuple[str, ...]
    buckets: int

    def has_hot(self, spark: SparkSession) -> bool:
        return not spark.table(self.hot_name).isEmpty()

    def rows(self, spark: SparkSession) -> DataFrame:
        """The whole table, hot keys included, which is no longer in buckets."""
        return spark.table(self.name).unionByName(spark.table(self.hot_name))


def _null_safe(keys: Sequence[str]) -> tuple[list, object]:
    names = [f"_hot_{k}" for k in keys]
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return names, same


def write_bucketed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    buckets: int,
    path: str | None = None,
    hot_share: float = HOT_SHARE,
    stored: bool = False,
) -> BucketedTable:
    """Create a bucketed catalog table, sorted by the keys inside its buckets (actions).

    The input is counted by key before it is dealt out; unless it is a stored table (``stored``), it is
    pinned so that it is not computed twice.
    """
    spark, rows, keys = df.sparkSession, df if stored else pin(df), tuple(keys)
    target = path or scratch_path(spark, name)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    bound = max(1, int(rows.count() * hot_share / buckets))
    # Fewer than buckets / hot_share keys can be above the bound.
    hot = pin(counts.where(F.col("_n") > bound).select(*keys))
    names, same = _null_safe(keys)
    listed = F.broadcast(hot.toDF(*names))
    even, odd = (rows.join(listed, same, how) for how in ("left_anti", "left_semi"))
    # Dealt like the buckets are, a task has whole buckets and each becomes one file.
    dealt = even.repartition(buckets, *(F.col(k) for k in keys))
    writer = dealt.write.bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", f"{target}/even").format("parquet").saveAsTable(name)
    hot_name = f"{name}_hot"
    odd.write.option("path", f"{target}/hot").format("parquet").saveAsTable(hot_name)
    return BucketedTable(name, hot_name, keys, buckets)


def bucketed_join(spark: SparkSession, small: DataFrame, large: BucketedTable, stored: BucketedTable | None = None) -> DataFrame:
    """Join rows with a bucketed table on its keys.

    ``small`` may be what filters and projections leave of ``stored``, a table with the same buckets:
    neither side is then shuffled. Rows of hot keys take a join of their own, in which the side of the
    question is measured, and broadcast when it is small.
    """
    if stored is not None and (stored.keys, stored.buckets) != (large.keys, large.buckets):
        raise ValueError("both tables need the same keys and number of buckets")
    keys = list(large.keys)
    even = spark.table(large.name).join(small.hint("merge"), keys)
    odd = spark.table(large.hot_name)
    hot_keys = odd.select(*keys).distinct()
    wanted = small.join(F.broadcast(hot_keys), keys, "left_semi")
    return even.unionByName(join_measured(odd, wanted, keys).select(*even.columns))
