"""WARC archives with a two-level capture index.

Tasks write their pages as gzip members, one per record, into archive files of the shared folder;
equal payloads become revisits of the one with the smallest page_id. Every record is a capture: a
key (the URL with its host reversed), the page_id, and where the record lies. Captures are
range-sorted by key and written as compressed blocks of lines; each index file ends in a directory
of its blocks' first keys, and one row per index file, with its first key, makes the level above.
A lookup bisects the files, reads one file's directory, bisects that, reads one block by its range
and bisects its lines; records are then read by range, neighbours in one request.

File names are unique to the task attempt that wrote them, and only files named by rows of a
finished job are used, so a repeated or lost attempt leaves nothing behind that counts. Files are
opened through the file system that the shared folder's URI names.

Defined results: null html is an empty payload; payloads below ``MIN_REVISIT`` bytes are always
responses. A null URL has the key ``-``. Rows without page_id get an id of their own kind and can
be revisits, but nothing refers to them. Repeated rows are written and read repeatedly; where they
share the smallest page_id they are all responses. Columns other than page_id, url and html are not
read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_measured
from ..session import pin, scratch_path
from .common import by_batches

MIN_REVISIT = 100
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 512
READ_BYTES = 4 << 20
LEVEL = 4
DATE = "2024-01-01T00:00:00Z"
_NO_ID = 1 << 127
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"
_READ = "page_id bigint, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def url_key(url: str | None) -> str:
    """Reversed host, then path and query; characters that would break a line are escaped."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
        key = ",".join(reversed(host.split("."))) + (f":{parts.port}" if parts.port else "") + ")" + (parts.path or "/")
        key += f"?{parts.query}" if parts.query else ""
    except ValueError:  # no URL by its syntax
        key = ")" + url
    return _escaped(key)


def _escaped(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=_NO_ID if page_id is None else page_id % (1 << 64))}>"


def _page_of(record_id: str) -> int | None:
    n = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    if n == _NO_ID:
        return None
    return n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response, or a revisit without its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Target-URI: {_escaped(url or '-')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; a damaged one is an error."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    length = int(fields["Content-Length"])
    if version != "WARC/1.1" or rest[length:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:length].partition(b"\r\n\r\n")[2]


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    system, path = _opened(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            yield _batch(rows, _CAPTURE)
        if out is not None:
            out.close()

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page into archives below the folder; the captures (an action)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    ).withColumn("_digest", F.sha2("html", 256))
    known = rows.where(F.octet_length("html") >= MIN_REVISIT).select("page_id", "_digest")
    several = known.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL")
    # Digests of payloads that occur once are not in the list, nor are short ones.
    joined = join_measured(rows, several.drop("_n"), ["_digest"], "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")) & (F.octet_length("html") >= MIN_REVISIT), F.col("_first"))
    return pin(by_batches(joined.select("page_id", "url", "html", refers.alias("refers_to")), _write_archives(folder), _CAPTURE))


def _line_key(line: str) -> tuple[str, int]:
    key, page_id = line.split("\t", 2)[:2]
    return key, int(page_id)


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at, lines, directory = None, "", 0, [], []

        def flush() -> None:
            nonlocal at
            packed = zlib.compress("\n".join(lines).encode(), LEVEL)
            out.write(packed)
            directory.append((*_line_key(lines[0]), at, len(packed)))
            at += len(packed)
            lines.clear()

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.index"
                    system, path = _opened(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)
                lines.append(f"{key}\t{-1 << 63 if page_id is None else page_id}\t{file}\t{offset}\t{length}")
                if len(lines) == BLOCK_LINES:
                    flush()
        if out is not None:
            if lines:
                flush()
            packed = zlib.compress(json.dumps(directory).encode(), LEVEL)
            out.write(packed)
            out.close()
            yield _batch([(*directory[0][:2], name, at, len(packed))], _CAPTURE)

    return run


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index of the captures; one row per index file: its first key and id, and where its directory lies (an action)."""
    order = [F.col("key"), F.col("page_id").asc_nulls_first()]
    files = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return pin(by_batches(files, _write_index(folder), _CAPTURE))


class Index:
    """Lookups in one task; the last directory and block are kept, so sorted keys read each once."""

    def __init__(self, files: list[tuple]) -> None:
        self.files = sorted((key, -1 << 63 if i is None else i, *rest) for key, i, *rest in files)
        self.firsts = [f[:2] for f in self.files]
        self.held: dict[tuple, object] = {}

    def _range(self, kind: str, name: str, offset: int, length: int):
        held = self.held.get(kind)
        if held is None or held[0] != (name, offset):
            system, path = _opened(name)
            with system.open_input_file(path) as file:
                data = zlib.decompress(file.read_at(length, offset)).decode()
            value = json.loads(data) if kind == "directory" else data.split("\n")
            keys = [tuple(e[:2]) for e in value] if kind == "directory" else [_line_key(x) for x in value]
            held = self.held[kind] = ((name, offset), value, keys)
        return held[1], held[2]

    def find(self, key: str, page_id: int | None) -> list[tuple[str, int, int]]:
        """Where the records of a key and id lie. Equal entries may go on into later blocks and files."""
        wanted, out = (key, -1 << 63 if page_id is None else page_id), []
        for f in range(max(bisect.bisect_left(self.firsts, wanted) - 1, 0), len(self.files)):
            if self.firsts[f] > wanted:
                break
            name, offset, length = self.files[f][2:]
            blocks, starts = self._range("directory", name, offset, length)
            for b in range(max(bisect.bisect_left(starts, wanted) - 1, 0), len(blocks)):
                if starts[b] > wanted:
                    break
                lines, keys = self._range("block", name, *blocks[b][2:])
                at = bisect.bisect_left(keys, wanted)
                while at < len(keys) and keys[at] == wanted:
                    file, start, size = lines[at].split("\t")[2:]
                    out.append((file, int(start), int(size)))
                    at += 1
        return out


def locate(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Captures of (url, page_id) rows, found through the index.

    The upper level has one row per index file, as many as the index has partitions; it goes to
    the tasks whole.
    """
    files = [tuple(r) for r in index.collect()]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [url_key(u) for u in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(keys, pa.string()), batch.column(1)], names=["key", "page_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(files)
        for batch in batches:
            found = []
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found += [(key, page_id, *place) for place in own.find(key, page_id)]
            yield _batch(found, _CAPTURE)

    wanted = queries.select("url", F.col("page_id").cast("long").alias("page_id"))
    keys = pin(by_batches(wanted, keyed, "key string, page_id bigint").distinct())
    ordered = keys.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return by_batches(ordered, run, _CAPTURE)


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = list(zip(*(batch.column(i).to_pylist() for i in range(1, 5))))
        rows, at = [], 0
        while at < len(places):
            # Records that follow each other in a file are read together.
            name, start, end, until = places[at][1], places[at][2], places[at][2], at
            while (
                until < len(places) and places[until][1] == name and places[until][2] == end
                and (until == at or end - start < READ_BYTES)
            ):
                end += places[until][3]
                until += 1
            system, path = _opened(name)
            with system.open_input_file(path) as file:
                data = file.read_at(end - start, start)
            for page_id, _, offset, length in places[at:until]:
                fields, payload = parsed(data[offset - start : offset - start + length])
                if _page_of(fields["WARC-Record-ID"]) != page_id:
                    raise ValueError(f"the index names another record than page {page_id}")
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if fields["WARC-Type"] == "revisit":
                    rows.append((page_id, "revisit", _page_of(fields["WARC-Refers-To"]), None, digest))
                    continue
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"the payload of page {page_id} does not match its digest")
                rows.append((page_id, "response", None, len(payload), digest))
            at = until
        yield _batch(rows, _READ)


def read_records(captures: DataFrame) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes (of responses) and payload_digest, read from the archives."""
    ordered = pin(captures).repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return by_batches(ordered, _read_records, _READ)


def report(pages: DataFrame) -> DataFrame:
    """Write the pages, index them, look every page up and read its record; revisits resolved."""
    folder = scratch_path(pages.sparkSession, "warc")
    index = write_index(write_archives(pages, folder), folder)
    read = pin(read_records(locate(pages, index)))
    responses = read.where("record_type = 'response'").select(
        F.col("page_id").alias("_id"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")
    ).where("_id IS NOT NULL").distinct()
    revisits = read.where("record_type = 'revisit'")
    same = (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest"))
    resolved = revisits.join(responses, same, "left").withColumn("payload_bytes", F.col("_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(*columns).unionByName(resolved.select(*columns))


def oracle() -> str:
    return f"""
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> first THEN first END AS refers_to FROM f"""
