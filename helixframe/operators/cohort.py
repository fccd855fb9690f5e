"""One row per distinct variant with the samples that carry it, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import VARIANT_KEYS
from ..functions.numbers import int_div
from ..session import pin
from .joins import MAX_BROADCAST_BYTES, measured_bytes

BLOCK_WIDTH = 1_000_000


def in_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """Rows with ``low < location < high``; the comparison reaches the parquet scan."""
    return df.where((F.col("location") > low) & (F.col("location") < high))


def count_in_range(df: DataFrame, low: int, high: int) -> DataFrame:
    """One row with the number of rows in the open range."""
    return in_range(df, low, high).agg(F.count("*").alias("n"))


def carrier_counts(alt_allele: DataFrame) -> DataFrame:
    """Calls per variant and sample; map-side combine makes this safe for any hot variant."""
    return alt_allele.groupBy(*VARIANT_KEYS, "sample_id").agg(F.count("*").alias("calls"))


def condense(alt_allele: DataFrame, one_call_per_sample: bool = False) -> DataFrame:
    """One row per variant with the list of its sample ids; repeats stay, NULL ids are left out.

    Calls are counted per variant and sample first, so the list of a variant is gathered from at
    most one entry per sample however many calls it has. A table known to hold one call per
    sample and variant can skip that exchange with ``one_call_per_sample``.
    """
    if one_call_per_sample:
        return alt_allele.groupBy(*VARIANT_KEYS).agg(
            F.collect_list("sample_id").alias("sample_ids")
        )
    entry = F.when(F.col("sample_id").isNotNull(), F.struct("sample_id", F.col("calls").cast("int").alias("calls")))
    gathered = carrier_counts(alt_allele).groupBy(*VARIANT_KEYS).agg(
        F.collect_list(entry).alias("entries")
    )
    repeated = F.flatten(
        F.transform("entries", lambda e: F.array_repeat(e["sample_id"], e["calls"]))
    )
    return gathered.select(*VARIANT_KEYS, repeated.alias("sample_ids"))


def condense_blocks(alt_allele: DataFrame, width: int = BLOCK_WIDTH) -> DataFrame:
    """The condensed table for cohorts whose lists are too long for one row.

    One row per variant and block of ``width`` sample ids. Each holds at most ``width`` entries
    of sample id and number of calls, whatever the size of the cohort.
    """
    counts = carrier_counts(alt_allele).where(F.col("sample_id").isNotNull())
    block = int_div(F.col("sample_id"), width).alias("sample_block")
    return counts.groupBy(*VARIANT_KEYS, block).agg(
        F.collect_list(F.struct("sample_id", "calls")).alias("carriers")
    )


def with_sample(condensed: DataFrame, sample_id: int) -> DataFrame:
    """Variants whose sample list holds the id."""
    return condensed.where(F.array_contains("sample_ids", F.lit(sample_id).cast("bigint")))


def holdout_ids(alt_allele: DataFrame, n: int) -> DataFrame:
    """The ``n`` lowest sample ids. The order makes every evaluation give the same ids."""
    return alt_allele.select("sample_id").distinct().orderBy("sample_id").limit(n)


def holdout(alt_allele: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Split off ``n`` samples: the rest, and the rows of those samples (an action on the ids).

    The ids are pinned once so that both halves agree. They are at most ``n`` rows, which is
    what allows the broadcast.
    """
    ids = pin(holdout_ids(alt_allele, n))
    side = F.broadcast(ids) if n * 16 <= MAX_BROADCAST_BYTES else ids
    master = alt_allele.join(side, ["sample_id"], "left_anti")
    new = alt_allele.join(side, ["sample_id"], "left_semi")
    return master, new


def _same_variant(other: dict[str, str]):
    """Null-safe equality of the variant keys: calls may have no allele."""
    conditions = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
    return conditions[0] & conditions[1] & conditions[2]


def _theirs(df: DataFrame, *columns) -> tuple[DataFrame, dict[str, str]]:
    """A side with its keys renamed, and how."""
    names = {k: f"_{k}" for k in VARIANT_KEYS}
    return df.select(*(F.col(k).alias(n) for k, n in names.items()), *columns), names


def merge_condensed(master: DataFrame, new: DataFrame) -> DataFrame:
    """Merge condensed new samples: lists of a known variant are united, others are added."""
    ours = master.select(*VARIANT_KEYS, F.col("sample_ids").alias("_old"))
    theirs, names = _theirs(new, F.col("sample_ids").alias("_new"))
    joined = ours.join(theirs, _same_variant(names), "full_outer")
    return joined.select(*(F.coalesce(k, n).alias(k) for k, n in names.items()), _united().alias("sample_ids"))


def small_batch_parts(
    master: DataFrame, new: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame] | None:
    """The two halves of a merge that does not shuffle the master (an action on the batch).

    First the master's rows, in place and with their lists united, then the batch rows that met
    no master row. None when the batch is above the bound and must not be broadcast.
    """
    batch = pin(new.select(*VARIANT_KEYS, F.col("sample_ids").alias("_new")))
    if measured_bytes(batch) > max_bytes:
        return None
    keys = list(VARIANT_KEYS)
    ours = master.select(*VARIANT_KEYS, F.col("sample_ids").alias("_old"))
    theirs, names = _theirs(batch, "_new")
    updated = ours.join(F.broadcast(theirs), _same_variant(names), "left").select(
        *VARIANT_KEYS, _united().alias("sample_ids")
    )
    # Master keys are distinct, NULL alleles included, so no more keys match than were measured.
    wanted, names = _theirs(batch)
    matched, names = _theirs(master.select(*keys).join(F.broadcast(wanted), _same_variant(names), "left_semi"))
    added = batch.join(F.broadcast(matched), _same_variant(names), "left_anti").select(
        *VARIANT_KEYS, F.col("_new").alias("sample_ids")
    )
    return updated, added


def merge_small_batch(
    master: DataFrame, new: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES
) -> DataFrame:
    """``merge_condensed`` for a batch that is small as a rule (an action on the batch).

    A larger batch takes the full outer join.
    """
    parts = small_batch_parts(master, new, max_bytes)
    return merge_condensed(master, new) if parts is None else parts[0].unionByName(parts[1])


def merge_blocks(master: DataFrame, new: DataFrame) -> DataFrame:
    """Merge tables of ``condense_blocks`` with one block width; calls of a sample add up.

    Entries are summed per sample, so the result is what condensing both inputs together gives,
    whatever the width, and no row outgrows a block.
    """
    keys = [*VARIANT_KEYS, "sample_block"]
    entries = master.select(*keys, "carriers").unionByName(new.select(*keys, "carriers"))
    single = entries.select(*keys, F.explode("carriers").alias("_c")).select(*keys, "_c.sample_id", "_c.calls")
    counts = single.groupBy(*keys, "sample_id").agg(F.sum("calls").alias("calls"))
    return counts.groupBy(*keys).agg(F.collect_list(F.struct("sample_id", "calls")).alias("carriers"))


def _united():
    return (
        F.when(F.col("_new").isNull(), F.col("_old"))
        .when(F.col("_old").isNull(), F.col("_new"))
        .otherwise(F.array_union("_old", "_new"))
    )
