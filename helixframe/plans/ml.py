"""A small regression over the raw calls."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.joins import join_measured
from ..session import pin


def alphabetical_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct texts of a column, numbered from 0 in alphabetical order; any number of them.

    Texts are range-partitioned and numbered inside their partition, and a partition is shifted
    by the sizes of those before it, so no list of texts is held anywhere.
    """
    texts = df.select(column).where(F.col(column).isNotNull()).distinct()
    placed = pin(texts.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column))
    numbered = placed.withColumn("_at", inside).join(shifts, "_part")
    return numbered.select(column, (F.col("_shift") + F.col("_at") - 1).cast("double").alias(name))


def assemble_features(raw: DataFrame) -> DataFrame:
    """Add ref_index, alt_index and features (actions to number the texts); rows without ref or alt go."""
    indexed = raw
    for column in ("ref", "alt"):
        indexed = join_measured(indexed, alphabetical_index(raw, column, f"{column}_index"), [column])
    return VectorAssembler(inputCols=["ref_index", "location"], outputCol="features").transform(indexed)


def fit_allele_gbt(featured: DataFrame, **params) -> GBTRegressionModel:
    """Fit a gradient-boosted regression of the alternate's index on ref and location (an action)."""
    return GBTRegressor(featuresCol="features", labelCol="alt_index", **params).fit(featured.select("features", "alt_index"))
