"""New samples merged into the condensed table as they arrive.

A store keeps the carriers of variants as bitmap blocks, by blocks of a million bases: no row grows
with the cohort, and whole lists are made only for readers that ask. A commit lists for every block
the batch that wrote it last; a batch reads and rewrites only the blocks that it has calls in, in a new
folder, and then commits a new list. Every older commit stays readable until its folders are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import int_div
from ..operators.bitmaps import BITMAP_BLOCKS, carrier_lists, condense_bitmap, merge_bitmap_batch
from ..schemas import ALT_ALLELE
from ..session import pin

# A genome has about 3,000 blocks, so a list of them fits anywhere.
BLOCK_BASES = 1_000_000
NO_LOCATION = -1
_COMMIT = "commit bigint, block bigint, number bigint"


def _path(store: str, number: int, block: int) -> str:
    return f"{store}/data/v={number:08d}/block={block}"


def _with_block(bitmaps: DataFrame) -> DataFrame:
    block = F.coalesce(int_div(F.col("location"), BLOCK_BASES), F.lit(NO_LOCATION))
    return bitmaps.withColumn("block", block.cast("bigint"))


def _write_blocks(bitmaps: DataFrame, store: str, number: int) -> list[int]:
    """Write the blocks of a batch, sorted inside their files (an action); their numbers.

    Rebalancing brings a block's rows together and lets adaptive execution split a large block.
    """
    target = f"{store}/data/v={number:08d}"
    rows = _with_block(bitmaps).hint("rebalance", "block").sortWithinPartitions("block", "location", "ref", "allele")
    rows.write.mode("overwrite").partitionBy("block").parquet(target)
    written = bitmaps.sparkSession.read.schema("location bigint, block bigint").parquet(target)
    return [r.block for r in written.select("block").distinct().collect()]


def _commit(spark: SparkSession, store: str, number: int, blocks: dict[int, int]) -> None:
    """Note which batch wrote which block last, after the files are written."""
    rows = [(number, block, wrote) for block, wrote in sorted(blocks.items())] or [(number, None, None)]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/{number:08d}")


def _commits(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_COMMIT).option("recursiveFileLookup", "true").parquet(f"{store}/commits")


def _newest(spark: SparkSession, store: str, upto: int | None) -> int:
    """The number of the latest commit, or of the latest up to a number, by the names of its files (an action)."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{store}/commits").select("path")
    number = F.regexp_extract("path", r"/commits/(\d+)/[^/]+$", 1).try_cast("bigint")
    found = names.select(number.alias("number"))
    if upto is not None:
        found = found.where(F.col("number") <= upto)
    latest = found.agg(F.max("number")).first()[0]
    if latest is None:
        raise ValueError(f"no complete commit in {store}")
    return latest


def _blocks(spark: SparkSession, store: str, upto: int | None) -> dict[int, int]:
    """The list of the latest commit, or of the latest up to a number; no other commit is opened."""
    latest = spark.read.schema(_COMMIT).parquet(f"{store}/commits/{_newest(spark, store, upto):08d}")
    return {r.block: r.number for r in latest.where("block IS NOT NULL").collect()}


def _read_blocks(spark: SparkSession, store: str, blocks: dict[int, int]) -> DataFrame:
    if not blocks:
        return spark.createDataFrame([], BITMAP_BLOCKS)
    return spark.read.schema(BITMAP_BLOCKS).parquet(*(_path(store, n, b) for b, n in sorted(blocks.items())))


def create_store(carriers: DataFrame, store: str) -> None:
    """Write bitmap blocks, or a condensed table with whole lists, as the first commit of a store."""
    if "words" not in carriers.columns:
        single = carriers.select("location", "ref", "allele", F.explode("sample_ids").alias("sample_id"))
        carriers = condense_bitmap(single)
    blocks = _write_blocks(carriers, store, 0)
    _commit(carriers.sparkSession, store, 0, dict.fromkeys(blocks, 0))


def read_bitmaps(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The latest complete state, or the latest up to a number, as bitmap blocks (an action on the latest commit)."""
    return _read_blocks(spark, store, _blocks(spark, store, upto))


def read_store(spark: SparkSession, store: str, upto: int | None = None) -> DataFrame:
    """The same state as a condensed table; its lists are gathered here, and hold each sample once."""
    return carrier_lists(read_bitmaps(spark, store, upto))


def merge_batch(batch: DataFrame, store: str, number: int) -> None:
    """Merge a batch of calls into the state before and commit the result.

    A batch that is run again reads the same earlier state and overwrites its own folder and
    commit, so a replay changes nothing.
    """
    spark = batch.sparkSession
    listed = _blocks(spark, store, number - 1)
    bitmaps = pin(condense_bitmap(batch))
    touched = {r.block for r in _with_block(bitmaps).select("block").distinct().collect()}
    if touched:
        master = _read_blocks(spark, store, {b: n for b, n in listed.items() if b in touched})
        _write_blocks(merge_bitmap_batch(master, bitmaps), store, number)
    _commit(spark, store, number, listed | dict.fromkeys(touched, number))


def removable_paths(spark: SparkSession, store: str, oldest_kept: int) -> list[str]:
    """Block folders that no commit from ``oldest_kept`` on needs, for the store's owner to remove."""
    named = _commits(spark, store).where("block IS NOT NULL")
    needed = named.where(F.col("commit") >= oldest_kept).select("block", "number").distinct()
    old = named.select("block", "number").distinct().join(needed, ["block", "number"], "left_anti")
    return sorted(_path(store, r.number, r.block) for r in old.collect())


def ingest_stream(
    spark: SparkSession,
    source: str,
    store: str,
    files_per_batch: int | None = None,
    repeats_within: str | None = None,
) -> StreamingQuery:
    """Merge every new parquet file of expanded calls into the store, then stop.

    Start it again to take up what has arrived since. Progress is kept in the store itself, so
    that batch numbers and commits always belong together. A store follows one source.

    ``repeats_within``, such as ``30 days``: a call that was delivered before in that time, by a file of
    any name, is left out by keyed state, so that a repeated delivery rewrites nothing. The time is that
    of the files' last change; the state holds the calls of that time and is part of the progress, so
    a store is always fed with or always without it.
    """
    reader = spark.readStream.schema(ALT_ALLELE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    columns = ["location", "sample_id", "ref", "allele"]
    calls = reader.parquet(source).select(*columns, F.col("_metadata.file_modification_time").alias("_arrived"))
    if repeats_within:
        calls = calls.withWatermark("_arrived", repeats_within).dropDuplicatesWithinWatermark(columns)
    return (
        calls.select(*columns)
        .writeStream.foreachBatch(lambda batch, i: merge_batch(batch, store, i + 1))
        .option("checkpointLocation", f"{store}/progress")
        .trigger(availableNow=True)
        .start()
    )
