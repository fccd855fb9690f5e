"""Tab-separated samples and the gzip CSV tables of the generator model."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..constants import ALT_ALLELE_COLUMNS
from ..functions.numbers import parse_double
from ..operators.expand import to_whole
from ..schemas import ALT_ALLELE, BITMAPS, BUCKET_STATS_TEXT, SPIKES, STAT_METRICS, WEIGHTS, conform

TSV_OPTIONS = {
    "header": "true",
    "sep": "\t",
    "multiLine": "false",
    "quote": '"',
    "escape": '"',
    "ignoreTrailingWhiteSpace": "true",
}


def read_tsv(
    spark: SparkSession, path: str, columns: tuple[str, ...] = ALT_ALLELE_COLUMNS
) -> DataFrame:
    """Tab-separated files with a header, in one folder or one per sample; every column is text.

    Columns are found by their names in the header, whatever their order. A column that is
    missing, or a file whose header differs from the first one's, is an error.
    """
    return _by_header(spark, path, TSV_OPTIONS, StructType([StructField(c, StringType()) for c in columns]))


def _by_header(spark: SparkSession, path: str, options: dict[str, str], wanted: StructType) -> DataFrame:
    kinds = {f.name: f.dataType for f in wanted.fields}

    def read(header: list[str]) -> DataFrame:
        found = StructType([StructField(c, kinds.get(c, StringType())) for c in header])
        # Without enforceSchema every file's header is held against the schema.
        return reader_of(spark, options).option("enforceSchema", "false").schema(found).csv(path)

    return read_with_header(spark, path, options, wanted.names, read).select(*wanted.names)


def reader_of(spark: SparkSession, options: dict[str, str]) -> DataFrameReader:
    return spark.read.option("recursiveFileLookup", "true").options(**options)


def read_with_header(
    spark: SparkSession, path: str, options: dict[str, str], wanted: Sequence[str], read: Callable[[list[str]], DataFrame]
) -> DataFrame:
    """``read`` by the header of the files, which must have the wanted columns (an action).

    A look at the header of a folder lists its files twice, and reading once more; with a folder per sample that
    takes longer than the rows. So files are listed as the wanted columns, one of them is looked at, and only
    another header than that is read by a list of its own.
    """
    likely, header, first = read(list(wanted)), None, None
    # A file with another number of columns fails here.
    with suppress(PySparkException, Py4JJavaError):
        first = likely.select("_metadata.file_path").first()
    # File paths come as URIs, which a path with other characters is not.
    if first is not None and not set(first[0]) & set("%*?[]{}\\"):
        header = reader_of(spark, options).csv(first[0]).columns
    header = reader_of(spark, options).csv(path).columns if header is None else header
    if missing := [c for c in wanted if c not in header]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return likely if header == list(wanted) else read(header)


def write_sample_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of tab-separated files per sample; the id also stays in the files.

    The rebalance hint brings the rows of a sample together, and lets adaptive execution split a
    sample that is far larger than the others into several files.
    """
    keyed = df.withColumn("sample", F.col("sample_id")).hint("rebalance", "sample")
    options = {k: TSV_OPTIONS[k] for k in ("header", "sep", "quote", "escape")}
    keyed.write.mode(mode).partitionBy("sample").options(**options).csv(path)


def read_model_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Comma-separated files with a header, read by name. Gzip files must be named ``.csv.gz``."""
    return _by_header(spark, path, {"header": "true"}, schema)


def write_model_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The same files, gzip-compressed."""
    df.write.mode(mode).option("header", "true").option("compression", "gzip").csv(path)


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Rows per 100-base bin."""
    return read_model_csv(spark, path, WEIGHTS)


def read_bucket_stats(spark: SparkSession, path: str) -> DataFrame:
    """Metrics per 10,000-base bin; a metric that does not parse becomes 5."""
    return fill_stats(read_model_csv(spark, path, BUCKET_STATS_TEXT))


def fill_stats(stats: DataFrame) -> DataFrame:
    """Put 5 in place of every missing metric."""
    return stats.withColumns({c: parse_double(F.col(c).cast("string")) for c in STAT_METRICS})


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    """Dominant variants; rows without a location are skipped."""
    return read_model_csv(spark, path, SPIKES).where(F.col("location").isNotNull())


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """Known offsets; an empty word is zero."""
    return read_model_csv(spark, path, BITMAPS).fillna(0, ["low_bits", "high_bits"])


def load_samples(spark: SparkSession, path: str, target: DataFrame) -> DataFrame:
    """Read generated samples for an empty table of calls (an action on the target).

    The result has the columns and types of the expanded table. Numbers are read leniently: a
    fraction is dropped, and text that is no number becomes NULL.
    """
    if not target.isEmpty():
        raise ValueError("the target table holds rows already; truncate it first")
    whole = {f.name: f.dataType.simpleString() for f in ALT_ALLELE.fields if isinstance(f.dataType, (LongType, IntegerType))}
    samples = conform(to_whole(read_tsv(spark, path), whole), ALT_ALLELE)
    return conform(target, ALT_ALLELE).unionByName(samples)
