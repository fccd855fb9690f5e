"""Questions for users who name tables instead of DataFrames: parameterised SQL, and the operators by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..constants import MODY_GENES
from ..operators import annotate

QUESTIONS = {
    "count_in_range": "SELECT count(*) AS n FROM IDENTIFIER(:calls) WHERE location > :low AND location < :high",
    "rows_in_range": "SELECT * FROM IDENTIFIER(:calls) WHERE location > :low AND location < :high",
    "count_rows": "SELECT count(*) AS n FROM IDENTIFIER(:calls)",
    "gene_counts": "SELECT gene_symbol, count(*) AS n FROM IDENTIFIER(:vat) GROUP BY gene_symbol",
}


def ask(spark: SparkSession, question: str, **args) -> DataFrame:
    """Run a question; table names are arguments too."""
    return spark.sql(QUESTIONS[question], args=args)


def pathogenic_carriers(
    spark: SparkSession, calls: str, vat: str, samples: str | None = None, genes: Iterable[str] = MODY_GENES
) -> DataFrame:
    """``annotate.pathogenic_carriers`` over named tables; the gene filter reaches their scan."""
    info = spark.table(samples) if samples else None
    return annotate.pathogenic_carriers(spark.table(vat), spark.table(calls), info, genes)
