"""The generator's model as partial states that can be merged, so that a batch of samples updates it.

Two states carry everything. ``allele_state`` counts calls per location and allele: weights, bitmaps
and spikes follow from the counts. ``metric_state`` holds count, mean and sum of squared deviations of
each metric per 10,000-base bin; two of them unite exactly as if their rows had been seen together.
Merging reads the states only, never the calls behind them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import STATS_BIN
from ..functions.numbers import floor_to
from ..session import pin
from .model import METRICS, bins_of_counts

_STATE_COLUMNS = [f"{part}_{m}" for m in METRICS for part in ("n", "mean", "m2")]


class ModelState(NamedTuple):
    """Counts per location and allele, and moments per bin."""

    alleles: DataFrame
    metrics: DataFrame


def allele_state(alt_allele: DataFrame) -> DataFrame:
    """Calls per location and allele."""
    return alt_allele.groupBy("location", "allele").agg(F.count("*").alias("n"))


def metric_state(alt_allele: DataFrame) -> DataFrame:
    """Entries of each bin, and count, mean and squared deviations of each metric's known values."""
    parts = []
    for name, column in METRICS.items():
        n = F.count(column)
        parts += [
            n.alias(f"n_{name}"),
            F.coalesce(F.avg(column), F.lit(0.0)).alias(f"mean_{name}"),
            F.coalesce(F.var_pop(column) * n, F.lit(0.0)).alias(f"m2_{name}"),
        ]
    bin_ = floor_to(F.col("location"), STATS_BIN).alias("location_bin")
    return alt_allele.groupBy(bin_).agg(F.count("*").alias("entries"), *parts)


def state_of(alt_allele: DataFrame) -> ModelState:
    return ModelState(allele_state(alt_allele), metric_state(alt_allele))


def merge_alleles(master: DataFrame, new: DataFrame) -> DataFrame:
    columns = ["location", "allele", "n"]
    united = master.select(*columns).unionByName(new.select(*columns))
    return united.groupBy("location", "allele").agg(F.sum("n").alias("n"))


def _united(metric: str) -> list[Column]:
    """Count, mean and squared deviations of two sets of values together."""
    side = lambda part, s: F.coalesce(f"{s}.{part}_{metric}", F.lit(0).cast("bigint") if part == "n" else F.lit(0.0))
    na, nb = side("n", "a"), side("n", "b")
    n, apart = na + nb, side("mean", "b") - side("mean", "a")
    share = F.when(n > 0, nb / n).otherwise(0.0)
    return [
        n.alias(f"n_{metric}"),
        (side("mean", "a") + apart * share).alias(f"mean_{metric}"),
        (side("m2", "a") + side("m2", "b") + apart * apart * na * share).alias(f"m2_{metric}"),
    ]


def merge_metrics(master: DataFrame, new: DataFrame) -> DataFrame:
    """Bins of both sides; a bin that both have gets the moments of all its values."""
    a, b = master.alias("a"), new.alias("b")
    joined = a.join(b, F.col("a.location_bin").eqNullSafe(F.col("b.location_bin")), "full_outer")
    entries = F.coalesce("a.entries", F.lit(0)) + F.coalesce("b.entries", F.lit(0))
    parts = [column for m in METRICS for column in _united(m)]
    return joined.select(F.coalesce("a.location_bin", "b.location_bin").alias("location_bin"), entries.alias("entries"), *parts)


def merge_states(master: ModelState, new: ModelState) -> ModelState:
    return ModelState(merge_alleles(master.alleles, new.alleles), merge_metrics(master.metrics, new.metrics))


def state_bins(state: ModelState) -> DataFrame:
    """Weights, bitmaps and spikes of all bins, as ``model.model_bins`` gives them."""
    return bins_of_counts(state.alleles.withColumnRenamed("n", "_n"))


def state_stats(state: ModelState) -> DataFrame:
    """Average and sample deviation of each metric, as ``model.model_stats`` gives them."""
    columns = []
    for m in METRICS:
        n, mean, m2 = (F.col(f"{part}_{m}") for part in ("n", "mean", "m2"))
        columns += [
            F.when(n > 0, mean).alias(f"avg_{m}"),
            F.when(n > 1, F.sqrt(m2 / (n - 1))).alias(f"stddev_{m}"),
        ]
    return state.metrics.select("location_bin", "entries", *columns)


def _folder(path: str, version: int) -> str:
    return f"{path}/v={version:08d}"


def write_state(state: ModelState, path: str, version: int) -> None:
    """Write one version of a state (an action); an unfinished one is overwritten by the next try."""
    for name, table in zip(ModelState._fields, state):
        table.write.mode("overwrite").parquet(f"{_folder(path, version)}/{name}")


def read_state(spark: SparkSession, path: str, version: int) -> ModelState:
    return ModelState(*(spark.read.parquet(f"{_folder(path, version)}/{name}") for name in ModelState._fields))


def update_state(batch: DataFrame, path: str, version: int) -> None:
    """Write the version that follows from the one before and a batch of new samples' calls (actions).

    The batch alone is read from its calls; a batch that is run again writes the same version.
    """
    spark = batch.sparkSession
    calls = pin(batch.select("location", "allele", *METRICS.values()))
    new = state_of(calls)
    write_state(new if version == 0 else merge_states(read_state(spark, path, version - 1), new), path, version)
