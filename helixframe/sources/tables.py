"""Parquet folders and catalog tables, clustered layouts and their compaction."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

CLUSTER_BY = ("location",)


def scan_dir(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """All files of a folder as one table; a schema saves the look into file footers."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table."""
    return spark.read.table(name)


def write_dir(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Write a folder. The format is an argument so that a lake format can be configured."""
    df.write.format(fmt).mode(mode).save(path)


def write_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet") -> None:
    """Create a catalog table; it must not exist."""
    _table_writer(df, path, fmt).mode("errorifexists").saveAsTable(name)


def replace_table(df: DataFrame, name: str, path: str | None = None, fmt: str = "parquet") -> None:
    """Create a catalog table in place of one that may exist.

    The rows are written to a new folder first, below ``path`` or the shared folder, and the name
    is pointed there when they are complete: a write that fails leaves the old table as it was.
    With the same columns the name never goes away. With other columns the old table steps aside
    under another name while the new one is created, and comes back if that fails; it is dropped
    when the name is taken. The old folder is left to its owner.
    """
    spark = df.sparkSession
    target = f"{path}/{uuid.uuid4().hex}" if path else scratch_path(spark, name)
    write_dir(df, target, fmt)
    _repoint(spark, name, target, fmt)


def _quoted(name: str) -> str:
    return ".".join(f"`{part.strip('`').replace('`', '``')}`" for part in name.split("."))


def _repoint(spark: SparkSession, name: str, target: str, fmt: str) -> None:
    written = spark.read.format(fmt).load(target)
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=target, source=fmt, schema=written.schema)
        return
    if spark.table(name).schema == written.schema:
        place = target.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {_quoted(name)} SET LOCATION '{place}'")
        spark.catalog.refreshTable(name)
        return
    aside = f"{name}_{uuid.uuid4().hex}"
    spark.sql(f"ALTER TABLE {_quoted(name)} RENAME TO {_quoted(aside)}")
    try:
        spark.catalog.createTable(name, path=target, source=fmt, schema=written.schema)
    except Exception:
        spark.sql(f"ALTER TABLE {_quoted(aside)} RENAME TO {_quoted(name)}")
        raise
    spark.sql(f"DROP TABLE {_quoted(aside)}")


def _table_writer(df: DataFrame, path: str | None, fmt: str):
    writer = df.write.format(fmt)
    return writer.option("path", path) if path else writer


def clustered(
    df: DataFrame,
    by: Sequence[str] = CLUSTER_BY,
    then_by: Sequence[str] = (),
    files: int | None = None,
) -> DataFrame:
    """Range-partition by the cluster keys and sort inside the partitions.

    Each file then covers a narrow range of the first key, and its row groups narrow ranges of
    it, which lets a range filter skip the rest. Without ``files`` adaptive execution merges
    small partitions. The sorting keys and the source partition take part in the ranges, so rows
    that share one key, or are copies of each other, are spread over many tasks.
    """
    keys = [*by, *then_by]
    spread = df.withColumn("_source", F.spark_partition_id())
    if files is None:
        ranged = spread.repartitionByRange(*keys, "_source")
    else:
        ranged = spread.repartitionByRange(files, *keys, "_source")
    return ranged.sortWithinPartitions(*keys).drop("_source")


def write_clustered(
    df: DataFrame,
    path: str,
    by: Sequence[str] = CLUSTER_BY,
    then_by: Sequence[str] = (),
    files: int | None = None,
    mode: str = "errorifexists",
    max_rows_per_file: int = 0,
) -> None:
    """Write a parquet folder clustered by the keys."""
    writer = clustered(df, by, then_by, files).write.mode(mode)
    if max_rows_per_file:
        writer = writer.option("maxRecordsPerFile", max_rows_per_file)
    writer.parquet(path)


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    by: Sequence[str] = CLUSTER_BY,
    then_by: Sequence[str] = (),
    files: int | None = None,
    name: str | None = None,
) -> DataFrame:
    """Rewrite a folder into a new one with fewer, clustered files, and read that.

    The new folder must hold as many rows as the old one; then the catalog table ``name``, if
    given, is pointed there, so that its readers go on with the new files. The source stays as
    it is, for readers that are still at it.
    """
    write_clustered(spark.read.parquet(source), target, by, then_by, files)
    before, after = spark.read.parquet(source).count(), spark.read.parquet(target).count()
    if before != after:
        raise RuntimeError(f"{target} holds {after} rows, {source} {before}")
    if name is None:
        return spark.read.parquet(target)
    _repoint(spark, name, target, "parquet")
    return spark.table(name)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, name, size and time of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modification_time"),
    )


def rows_per_table(spark: SparkSession, path: str, suffix: str = ".parquet") -> DataFrame:
    """Name and row count of every parquet table, a file or a folder, in a folder."""
    below = F.regexp_extract("path", r"/([^/]+)" + suffix.replace(".", r"\.") + r"(/[^/]+)?$", 1)
    names = file_manifest(spark, path).select(below.alias("name")).where("name <> ''").distinct()
    counts = [
        spark.read.parquet(f"{path}/{r.name}{suffix}").agg(F.count("*").alias("n")).select(F.lit(r.name).alias("name"), "n")
        for r in names.collect()
    ]
    return reduce(DataFrame.unionByName, counts)
