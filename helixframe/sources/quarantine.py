"""Loading samples with an account of every row: what fits is loaded, what does not is kept with the reason.

The reader is permissive: a line with too few or too many fields arrives as its text, in a column of
its own. Fields are then checked as they are going to be loaded. Both halves come from one parse that is
written first, so that loaded and rejected rows add up to the rows read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..constants import ALT_ALLELE_COLUMNS
from ..functions.numbers import lenient_long
from ..operators.expand import to_whole
from ..schemas import ALT_ALLELE, conform
from ..session import scratch_path
from .text import TSV_OPTIONS, read_with_header, reader_of

#: Columns that every call needs.
REQUIRED = ("location", "sample_id")
#: Columns that are loaded as whole numbers.
WHOLE = tuple(f.name for f in ALT_ALLELE.fields if isinstance(f.dataType, (LongType, IntegerType)))
_LINE = "_line"


class Load(NamedTuple):
    """Rows that were loaded, and rows that were not with their reasons."""

    loaded: DataFrame
    rejected: DataFrame


def read_permissive(spark: SparkSession, path: str, columns: Sequence[str] = ALT_ALLELE_COLUMNS) -> DataFrame:
    """Tab-separated files with a header: the columns as text, the file, and the whole line where its fields don't match the header."""
    # The parser fails on a line that begins with a blank field when it trims, so blanks are trimmed here.
    options = {k: v for k, v in TSV_OPTIONS.items() if k != "ignoreTrailingWhiteSpace"}
    # Without column pruning every line is split whole, whatever columns are asked for.
    checks = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _LINE, "columnPruning": "false", "enforceSchema": "false"}

    def read(header: list[str]) -> DataFrame:
        schema = StructType([StructField(c, StringType()) for c in [*header, _LINE]])
        return reader_of(spark, options | checks).schema(schema).csv(path)

    rows = read_with_header(spark, path, options, columns, read)
    trimmed = [F.nullif(F.rtrim(c), F.lit("")).alias(c) for c in columns]
    return rows.select(*trimmed, _LINE, F.col("_metadata.file_path").alias("_file"))


def reasons(required: Sequence[str] = REQUIRED, whole: Sequence[str] = WHOLE) -> Column:
    """Why a row cannot be loaded; empty if it can.

    A number may have a fraction, which the loader drops; a missing one is no error unless the
    column is required.
    """
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    found = [F.when(blank(c), F.lit(f"{c}: missing")) for c in required]
    found += [F.when(~blank(c) & lenient_long(F.col(c)).isNull(), F.lit(f"{c}: not a number")) for c in whole]
    checks = F.filter(F.array(*found), lambda r: r.isNotNull())
    return F.when(F.col(_LINE).isNotNull(), F.array(F.lit("line: number of fields"))).otherwise(checks)


def checked_load(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = ALT_ALLELE_COLUMNS,
    required: Sequence[str] = REQUIRED,
    whole: Sequence[str] = WHOLE,
) -> Load:
    """Read samples once and part them (an action): expanded calls, and rejected rows with file, reasons and content.

    The content of a line with the wrong number of fields is its text, of any other row its fields.
    """
    parsed = read_permissive(spark, path, columns).withColumn("_reasons", reasons(required, whole))
    stage = scratch_path(spark, "parsed")
    parsed.write.parquet(stage)
    rows = spark.read.schema(parsed.schema).parquet(stage)
    kinds = {f.name: f.dataType.simpleString() for f in ALT_ALLELE.fields}
    good = rows.where(F.size("_reasons") == 0).select(*columns)
    loaded = conform(to_whole(good, {c: kinds[c] for c in whole}), ALT_ALLELE)
    record = F.coalesce(F.col(_LINE), F.to_json(F.struct(*columns)))
    bad = rows.where(F.size("_reasons") > 0)
    return Load(loaded, bad.select(F.col("_file").alias("file"), F.col("_reasons").alias("reasons"), record.alias("record")))


def quarantine(load: Load, path: str) -> None:
    """Add the rejected rows to the quarantine table (an action), in a folder for each first reason."""
    keyed = load.rejected.withColumn("reason", F.regexp_replace(F.element_at("reasons", 1), "[^a-zA-Z0-9]+", "_"))
    keyed.write.mode("append").partitionBy("reason").parquet(path)


def rejected_by_reason(rejected: DataFrame) -> DataFrame:
    """Rows per reason; a row with several counts for each."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def rejected_files(load: Load) -> DataFrame:
    """Rejected rows per file, for those who deliver them."""
    return load.rejected.groupBy("file").agg(F.count("*").alias("rejected"))


def account(load: Load) -> DataFrame:
    """Loaded and rejected rows, and what was read."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rows"), "n") for name, df in zip(Load._fields, load)]
    both = counts[0].unionByName(counts[1])
    return both.unionByName(both.agg(F.sum("n").alias("n")).select(F.lit("read").alias("rows"), "n"))
