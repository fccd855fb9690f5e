"""Block-gzip text, read in splits: one compressed file is many tasks.

Such a file is a row of gzip members of at most 64 KB, each of which tells its size in its header. A
task is given a range of bytes; it finds the first member that begins there by its header and by the
header that must follow, and reads on from member to member. A line belongs to the range in which its
first byte's member begins: every range but the first leaves out the rest of a line, and reads one line
beyond its end. Files that are gzip but not in blocks are read by one task as a stream.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import pin
from ..workers import over_batches

RANGE_BYTES = 64 << 20
#: Text in one member; a member is at most 64 KB, also where text does not compress.
BLOCK_BYTES = 65_280
BATCH_BYTES = 4 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
_MOST = 1 << 16
#: The empty member that ends a file.
_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def member_size(data: bytes, at: int = 0) -> int | None:
    """Bytes of the member whose header stands here; None if it is no such header."""
    if data[at : at + 4] != _MAGIC or len(data) < at + 12:
        return None
    place, extra = at + 12, struct.unpack_from("<H", data, at + 10)[0]
    stop = place + extra
    while place + 4 <= min(stop, len(data)):
        length = struct.unpack_from("<H", data, place + 2)[0]
        if data[place : place + 2] == b"BC" and length == 2 and place + 6 <= len(data):
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + length
    return None


def member(text: bytes) -> bytes:
    """A member that holds the text, at most ``BLOCK_BYTES`` of it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(text) + packer.flush()
    if len(body) > _MOST - 26:
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = packer.compress(text) + packer.flush()
    head = _MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def _first_member(file, size: int, start: int, end: int) -> int | None:
    """Where the first member of a range begins."""
    at = start
    while at < end:
        file.seek(at)
        data = file.read(4 * _MOST)
        found = data.find(_MAGIC)
        while 0 <= found and at + found < end:
            length = member_size(data, found)
            if length is not None:
                after = at + found + length
                file.seek(after)
                if after == size or (after < size and member_size(file.read(64)) is not None):
                    return at + found
            found = data.find(_MAGIC, found + 1)
        if at + len(data) >= size:
            return None
        at += len(data) - 64  # a header may stand across the border
    return None


def _members(file, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """Offset and text of the members from here to the end of the file."""
    while at < size:
        file.seek(at)
        data = file.read(_MOST)
        length = member_size(data)
        if length is None:
            raise ValueError(f"no member at byte {at}")
        yield at, zlib.decompress(data[:length], 31)
        at += length


def _streamed(file) -> Iterator[tuple[int, bytes]]:
    """The text of plain gzip, which may have several members too."""
    unpacker = zlib.decompressobj(31)
    while data := file.read(1 << 20):
        while data:
            yield 0, unpacker.decompress(data)
            data = unpacker.unused_data
            if data:
                unpacker = zlib.decompressobj(31)
    if not unpacker.eof:
        raise ValueError("the file ends inside a member")


def lines_of_range(file, size: int, start: int, end: int) -> Iterator[bytes]:
    """The lines that belong to a range of a file's bytes."""
    file.seek(0)
    if member_size(file.read(64)) is None:
        if start:
            return
        file.seek(0)
        texts, end = _streamed(file), 1
    else:
        first = 0 if start == 0 else _first_member(file, size, start, end)
        if first is None:
            return
        texts = _members(file, size, first)
    # The end of a line that belongs to the range before.
    foreign, open_ = start > 0, b""
    for at, text in texts:
        if foreign:
            cut = text.find(b"\n")
            if at >= end:
                return
            if cut < 0:
                continue
            foreign, text = False, text[cut + 1 :]
        if at >= end:
            cut = text.find(b"\n")
            if cut >= 0:
                yield open_ + text[:cut]
                return
            open_ += text
            continue
        *whole, open_ = (open_ + text).split(b"\n")
        yield from whole
    if open_ and not foreign:
        yield open_


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file", "first", "value"]
    for batch in batches:
        for uri, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            system, path = _opened(uri)
            values, held, first = [], 0, start == 0

            def made(first: bool) -> pa.RecordBatch:
                firsts = [first and i == 0 for i in range(len(values))]
                columns = [pa.array([uri] * len(values)), pa.array(firsts), pa.array([v.decode("utf-8", "replace") for v in values])]
                return pa.record_batch(columns, names=names)

            with system.open_input_file(path) as file:
                for line in lines_of_range(file, size, start, end):
                    values.append(line.removesuffix(b"\r"))
                    held += len(line) + 8
                    if held >= BATCH_BYTES:
                        yield made(first)
                        values, held, first = [], 0, False
            if values:
                yield made(first)


def files_in(spark: SparkSession, path: str) -> DataFrame:
    """URI and size of the files below a folder; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def read_block_gzip(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, first (whether it is the file's first line) and value of every line (an action on the list of files)."""
    last = F.floor((F.col("bytes") - 1) / range_bytes)
    ranges = files.where("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_n"))
    start = F.col("_n") * range_bytes
    bounds = pin(ranges.select("file", "bytes", start.alias("start"), F.least(start + range_bytes, F.col("bytes")).alias("end")))
    spread = bounds.repartition(max(bounds.count(), 1))
    return over_batches(spread, _read, "file string, first boolean, value string")


def read_block_gzip_csv(files: DataFrame, schema: StructType, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Comma-separated block-gzip files whose first line names the columns; each must have the schema's columns in order."""
    lines = read_block_gzip(files, range_bytes)
    header = ",".join(schema.names)
    wrong = F.raise_error(F.concat(F.lit("unexpected header in "), F.col("file"), F.lit(": "), F.col("value")))
    checked = lines.where(F.when(F.col("first") & (F.col("value") != header), wrong.cast("boolean")).otherwise(~F.col("first")))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return checked.where(F.length("value") > 0).select(F.from_csv("value", ddl).alias("_row")).select("_row.*")


def write_block_gzip(lines: DataFrame, path: str, header: str | None = None) -> DataFrame:
    """Write the column ``value`` as block-gzip files, one for each task (an action); URI and size of the finished ones.

    Files are named for the attempt that wrote them: what a lost attempt has left is in no list.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{path}/{uuid.uuid4().hex}.gz"
        system, place = _opened(uri)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        size, held = 0, (header + "\n").encode() if header is not None else b""
        with system.open_output_stream(place, compression=None) as out:
            for batch in batches:
                held += b"".join(v.encode() + b"\n" for v in batch.column(0).to_pylist() if v is not None)
                whole = len(held) // BLOCK_BYTES * BLOCK_BYTES
                for at in range(0, whole, BLOCK_BYTES):
                    out.write(block := member(held[at : at + BLOCK_BYTES]))
                    size += len(block)
                held = held[whole:]
            for block in ([member(held)] if held else []) + [_END]:
                out.write(block)
                size += len(block)
        yield pa.record_batch([pa.array([uri]), pa.array([size], pa.int64())], names=["file", "bytes"])

    return pin(over_batches(lines.select(F.col("value").cast("string")), write, "file string, bytes bigint"))
