"""What the operators share: words, tables, staging in the shared folder, joins against small lists."""

from __future__ import annotations

import contextlib
import ctypes
import io
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.joins import join_measured
from ..session import scratch_path

#: White space is these six characters only; everything else belongs to words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: later uses neither recompute nor lose it."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have, made from these by underscores in front."""
    taken = {c.lower() for c in df.columns}
    return [next(n for i in range(len(taken) + 1) if (n := "_" * i + name).lower() not in taken) for name in names]


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in the list, null ones included; the list is broadcast only when measured small."""
    return join_measured(docs, ids.select("doc_id").distinct(), ["doc_id"], "left_anti")


_SHIPPED: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    # Rows hold whole texts: bound the batches by bytes, unless the user has.
    if spark.conf.get(_BATCH) in ("64MB", "64m", "67108864", "67108864b"):
        spark.conf.set(_BATCH, BATCH_BYTES)
    _SHIPPED.add(context.applicationId)


def _forget_others(own: str) -> None:
    """Python workers live on from task to task: drop what other modules have cached in this one."""
    for name, module in list(sys.modules.items()):
        if name.startswith(__package__) and name != own and hasattr(module, "forget"):
            module.forget()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def by_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    _ship(df.sparkSession)
    own = function.__module__

    def run(batches):
        _forget_others(own)
        yield from function(batches)

    return df.mapInArrow(run, schema)
