"""Exact dedup by Grace hashing.

Records go to buckets by the leading bits of their hash (Spark's shuffle is the first partitioning
into spill files). A task reads its bucket into an open-addressing table that compares complete
contents. When the distinct contents outgrow the memory bound, the table and the rest of the bucket
are dealt into sub-files by the next byte of the hash, and each is treated the same way, until
every one fits. Copies never add to a table's content, and each map task collapses its own copies
in such a table before the shuffle, so a text that a third of all rows share arrives as one record
per map task. The sub-files live in the task's own temporary folder and go with the task; a lost
executor's bucket is read again from the shuffle.

Defined results: null counts as empty; texts are compared after each run of white space became one
space (nothing is trimmed). The smallest doc_id stays; null ids come after all others. Rows that
repeat both doc_id and text are all reported as the kept document; ``stage`` keeps one of them.
Other columns are not read.
"""

from __future__ import annotations

import marshal
import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.joins import join_measured
from ..session import pin
from .common import SPACE, by_batches, fresh, text_of, without_ids

#: Bytes of distinct content that one table may hold.
TABLE_BYTES = 48 << 20
FANOUT = 16
_SCHEMA = "digest binary, content binary, keep_id bigint, group_size bigint"
_ARROW = pa.schema([("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
Record = tuple[bytes, bytes, int | None, int]


class OpenTable:
    """Linear probing over slot numbers; a hit needs the complete content to be equal."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.records: list[list] = []
        self.bytes = 0

    def add(self, digest: bytes, content: bytes, keep_id: int | None, n: int) -> None:
        at = self._find(digest, content)
        if (i := self.slots[at]) >= 0:
            record = self.records[i]
            if record[2] is None or (keep_id is not None and keep_id < record[2]):
                record[2] = keep_id
            record[3] += n
            return
        self.slots[at] = len(self.records)
        self.records.append([digest, content, keep_id, n])
        self.bytes += len(content) + 200
        if 2 * len(self.records) > len(self.slots):
            self._grow()

    def _find(self, digest: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[-8:], "little") & mask
        while (i := self.slots[at]) >= 0 and self.records[i][1] != content:
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for i, record in enumerate(self.records):
            at = int.from_bytes(record[0][-8:], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = i


def _stored(path: str) -> Iterator[Record]:
    with open(path, "rb") as file:
        while True:
            try:
                yield marshal.load(file)
            except EOFError:
                return


def grace(records: Iterable[Record], folder: str, bound: int, level: int = 0) -> Iterator[OpenTable]:
    """Tables that together hold the distinct contents of the records, each within the bound.

    Digest bytes of the deepest level are all equal, so what is left there is one content.
    """
    table, files = OpenTable(), None
    for record in records:
        if files is None:
            table.add(*record)
            if table.bytes > bound and len(table.records) > 1 and level < len(record[0]):
                paths = [os.path.join(folder, f"{level}-{i}") for i in range(FANOUT)]
                files = [open(p, "wb") for p in paths]
                for held in table.records:
                    marshal.dump(tuple(held), files[held[0][level] % FANOUT])
                table.clear()
        else:
            marshal.dump(record, files[record[0][level] % FANOUT])
    if files is None:
        yield table
        return
    for file in files:
        file.close()
    for path in paths:
        yield from grace(_stored(path), folder, bound, level + 1)
        os.remove(path)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Record]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _emit(table: OpenTable, content: bool) -> Iterator[pa.RecordBatch]:
    """Batches of a table's records; without the content once it has been compared."""
    for at in range(0, len(table.records), 512):
        part = table.records[at : at + 512]
        columns = [list(c) for c in zip(*part)]
        if not content:
            columns[1] = [b""] * len(part)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)


def _collapse(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = OpenTable()
        for record in _rows(batches):
            table.add(*record)
            if table.bytes > bound:
                yield from _emit(table, True)
                table.clear()
        yield from _emit(table, True)

    return run


def _resolve(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            for table in grace(_rows(batches), folder, bound):
                table.records = [r for r in table.records if r[3] > 1]
                yield from _emit(table, False)

    return run


def normalised(docs: DataFrame) -> DataFrame:
    content = F.regexp_replace(text_of(), F.lit(SPACE + "+"), F.lit(" "))
    return docs.select("doc_id", content.alias("_content"))


def copy_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """digest, keep_id and group_size of every content that occurs more than once."""
    records = normalised(docs).select(
        F.unhex(F.sha2("_content", 256)).alias("digest"),
        F.col("_content").cast("binary").alias("content"),
        F.col("doc_id").cast("long").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
    )
    dealt = by_batches(records, _collapse(table_bytes // 4), _SCHEMA).repartition("digest")
    return by_batches(dealt, _resolve(table_bytes), _SCHEMA).drop("content")


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = normalised(docs).select("doc_id", F.sha2("_content", 256).alias("text_sha256"))
    groups = copy_groups(docs, table_bytes).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")
    joined = join_measured(hashed, groups, ["text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def stage(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row of each equal text."""
    groups = pin(exact_groups(docs).select("doc_id", "kept"))
    repeated = pin(groups.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"))
    if repeated.isEmpty():
        return without_ids(docs, groups.where(~F.col("kept")))
    # Ids are not unique or null: the id alone does not name a row, so these rows are told apart by text.
    id_, key_, sha_, n_ = fresh(docs, "_id", "_key", "_sha", "_n")
    same = F.col("doc_id").eqNullSafe(F.col(id_))
    listed = repeated.withColumnRenamed("doc_id", id_)
    alone = without_ids(docs.join(listed, same, "left_anti"), groups.where(~F.col("kept")))
    shared = docs.join(listed, same, "left_semi")
    key = F.sha2(F.regexp_replace(text_of(), F.lit(SPACE + "+"), F.lit(" ")), 256)
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_)).distinct()
    first = F.row_number().over(Window.partitionBy("doc_id", key_).orderBy("text"))
    chosen = (
        shared.withColumn(key_, key)
        .join(kept, same & (F.col(key_) == F.col(sha_)), "left_semi")
        .withColumn(n_, first)
        .where(F.col(n_) == 1)
    )
    return alone.unionByName(chosen.select(*docs.columns))


def oracle() -> str:
    return r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)"""
