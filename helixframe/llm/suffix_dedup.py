"""Removal of repeated strings by prefix-free parsing.

Triggers are windows of 49 bytes whose rolling hash is divisible by ``PERIOD``; a phrase goes from
one trigger to the end of the next, so phrases overlap by 49 bytes, no phrase's proper suffix of 50
bytes or more begins another's end, and every string of 50 bytes lies in exactly one phrase. The
parse is the list of phrase occurrences, the dictionary the distinct phrases. The order of corpus
suffixes by their first 50 bytes therefore follows from the two parts:

* parse: occurrences are sorted by phrase and document. Where a phrase stands in a smaller
  document, all strings of the occurrence repeat;
* dictionary: suffixes of the remaining occurrences are sorted by their first 50 bytes and document.
  Where the same 50 bytes stand in a smaller document, the string repeats.

Only suffixes that can have an equal are sorted. Each is filed under the least hashed 28-byte gram
of its 50 bytes (its anchor); an anchor met in one place only leaves its suffixes unsorted. Anchors are
taken after the parse is sorted, from phrases that don't repeat, so a phrase that many documents have
does not make its own anchors shared. Sorting is by a 64-bit fingerprint of the 50 bytes, since order
beyond equality is not asked for; the bytes of equal fingerprints are compared.

All sorts happen in buckets. A map task collapses what repeats within it: it sends one occurrence
of each phrase, anchor and piece of text, that of its smallest document, and decides the others
itself, so what a third of all documents share arrives once per task. Pieces with suffixes go to the
bucket of the bytes that all their suffixes have in common, at least 43 of the 50, so a hot anchor is
split by what surrounds it. Buckets grow in number with the input, so the records that a task has for
one become few, with hardly two of a row: they name a row by its number in what the task sends. The
names themselves go once to the row's home bucket, where what the sorts find of it arrives too.

Strings count as equal when their bytes do: phrases by 128 bits, the rest by a comparison.

Defined results: null counts as empty; texts under 50 bytes keep everything, and an empty table has
no rows. Rows with a null doc_id come after all others. Rows that share a doc_id (or have none) don't
repeat each other; each is known by its id, 128 bits of its text and its file in a copy of the texts
that is written first, so that what one loses is not taken from another. Of rows in several files that
share both id and text, the first file's alone has its anchors and suffixes sorted, and its home gives the
others what was found. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import by_batches, staged, text_of
from .minhash import mix

LENGTH = 50
OVERLAP = LENGTH - 1
PERIOD = 256
ANCHOR = 28
#: Suffixes whose anchor stands at one of as many neighbouring offsets share a piece.
GROUP = 8
#: Text that a task parses before it sends, and that a bucket stands for.
FLUSH_BYTES = 12 << 20
BUCKET_BYTES = 16 << 20
PIECES = 150_000
#: A longer text is parsed in parts; each start belongs to one.
PART_BYTES = 4 << 20
_BASE = 0x5851F42D4C957F2D
_WINDOWS = LENGTH - ANCHOR + 1
#: Rows are known by document, file and text, a text by the halves of its MD5; equal rows of a file are one.
_ROW = [("doc", "<i8"), ("file", "<u4"), ("tag", "<u8"), ("twin", "<u8")]
#: a, b: start and number of starts that repeat; or the top of an anchor's hash, and 0.
ENTRY = np.dtype([*_ROW, ("a", "<u4"), ("b", "<u4")])
NAME = np.dtype(_ROW)
#: An anchor's row where the task that sends it knows that it is shared.
_TOLD = (1 << 32) - 1
#: What tasks send of phrases, anchors and pieces, and what the sorts find: columns in order; documents and chunks as steps.
_PHRASE_COLUMNS = ("<u8", "<u8", "<u8", "<u4", "<u4", "<u4")
_ANCHOR_COLUMNS = ("<u4", "<u4")
_PIECE_COLUMNS = ("u1", "<u8", "<u4", "<u4")
_FOUND_COLUMNS = ("<u8", "<u4", "<u4", "<u4")
_ROWS = "kind int, bucket int, data binary"
_NOTES = ["_doc", "_mark", "digest", "spans", "anchors", "copy"]
#: All starts of a text.
_WHOLE_TEXT = struct.pack("<2I", 0, (1 << 32) - 1)
ENTRIES, PHRASES, ANCHORS, TEXTS = range(4)
#: What goes to homes under ENTRIES, by its first byte: whole entries, names of a chunk's rows, entries by chunk and number.
_WHOLE, _NAMES, _FOUND = b"w", b"n", b"f"


def _row(kind: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return _packed_row(kind, bucket, len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True))


def _packed_row(kind: int, bucket: int, packed: bytes) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())],
        names=["kind", "bucket", "data"],
    )


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of one value."""
    cuts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]).tolist() if len(values) else []
    return zip(cuts, [*cuts[1:], len(values)])


def _columns(chunk: int, kinds: tuple, columns: tuple) -> bytes:
    """Numbers by column and place value, which compresses better."""
    out = [np.array([len(columns[0]), chunk], "<u8").tobytes()]
    for kind, values in zip(kinds, columns):
        out.append(np.ascontiguousarray(values, kind).view(np.uint8).reshape(len(values), -1).T.tobytes())
    return b"".join(out)


def _read_columns(blob: bytes, kinds: tuple) -> tuple[int, list[np.ndarray], int]:
    """The chunk, the columns, and where they end."""
    n, chunk = np.frombuffer(blob, "<u8", 2).tolist()
    out, at = [], 16
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel())
        at += size * n
    return chunk, out, at


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values.astype("<u8"), prepend=np.uint64(0))


def _sent_home(chunks: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
    """What a bucket found, for the homes of the rows."""
    home, nth = rows % np.uint32(n), rows // np.uint32(n)
    order = np.lexsort((a, nth, chunks, home))
    chunks, home, nth, a, b = (x[order] for x in (chunks, home, nth, a, b))
    for low, high in _runs(home):
        columns = (_steps(chunks[low:high]), *(x[low:high] for x in (nth, a, b)))
        yield _row(ENTRIES, int(home[low]), _FOUND + _columns(0, _FOUND_COLUMNS, columns))


def _entries(parts: list[np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    """Entries for their rows' buckets: an id that many rows share, or lack, is spread by their texts."""
    found = np.concatenate([*parts, np.zeros(0, ENTRY)])
    found = found[np.lexsort((found["a"], found["file"], found["twin"], found["tag"], found["doc"]))]
    homes = _homes(found, n)
    order = np.argsort(homes, kind="stable")
    homes, found = homes[order], found[order]
    for a, b in _runs(homes):
        yield _row(ENTRIES, int(homes[a]), _WHOLE + found[a:b].tobytes())


def _homes(rows: np.ndarray, n: int) -> np.ndarray:
    return _bucket(rows["doc"].astype(np.uint64) ^ rows["tag"], n)


def _chunks() -> Iterator[int]:
    """Numbers for what a task sends at a time; a task that is run again gives the same."""
    context = TaskContext.get()
    return itertools.count((context.partitionId() if context else 0) << 32)


def _numbered(rows: np.ndarray, first: np.ndarray, chunk: int, n: int) -> tuple[np.ndarray, list[pa.RecordBatch]]:
    """Numbers of a chunk's first rows, whose remainder by ``n`` is the home, and the names that belong to them."""
    home, numbers, names = _homes(rows, n), np.zeros(len(rows), np.uint32), []
    order = np.flatnonzero(first)
    order = order[np.argsort(home[order], kind="stable")]
    for a, b in _runs(home[order]):
        some = order[a:b]
        numbers[some] = home[some] + n * np.arange(b - a)
        part = np.zeros(b - a, NAME)
        for name, _ in _ROW:
            part[name] = rows[name][some]
        names.append(_row(ENTRIES, int(home[some[0]]), _NAMES + chunk.to_bytes(8, "little") + part.tobytes()))
    return numbers, names


def _as_entries(rows: np.ndarray, owner: np.ndarray, a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    out = np.zeros(len(owner), ENTRY)
    for name, _ in _ROW:
        out[name] = rows[name][owner]
    out["a"], out["b"] = a, b
    return out


def _digest(text: bytes) -> bytes:
    return hashlib.md5(text, usedforsecurity=False).digest()


def _bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(n)).astype(np.int32)


class Text:
    """Some texts in one buffer, and the hashes of their grams."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts])
        self.begins = self.ends - [len(t) for t in texts]
        raw = np.frombuffer(self.data, np.uint8)
        self.powers = {1: raw.astype(np.uint64) + np.uint64(1)}
        k = 1
        while 2 * k <= 32:
            half = self.powers[k]
            self.powers[2 * k] = half[: max(len(half) - k, 0)] * np.uint64(pow(_BASE, k, 1 << 64)) + half[k:]
            k *= 2

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n bytes at each position."""
        out, at = None, 0
        for k in (32, 16, 8, 4, 2, 1):
            if n - at >= k:
                part = self.powers[k][at:]
                size = max(len(self.data) - at - k + 1, 0)
                out = part if out is None else out[:size] * np.uint64(pow(_BASE, k, 1 << 64)) + part[:size]
                at += k
        return mix(out)

    def starts(self) -> np.ndarray:
        """Whether a string of 50 bytes starts at a position and ends in the same text."""
        ok = np.ones(max(len(self.data) - OVERLAP, 0), bool)
        for begin, end in zip(self.begins.tolist(), self.ends.tolist()):
            ok[max(end - OVERLAP, begin) : end] = False
        return ok

    def anchors(self, grams: np.ndarray) -> np.ndarray:
        """Where each string's anchor is: the least gram, the leftmost of equal ones."""
        low = np.uint64((1 << 24) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= _WINDOWS:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if rest := _WINDOWS - span:
            least = np.minimum(least[:-rest], least[rest:])
        return (least & low).astype(np.int64)

    def phrases(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of every phrase that holds a string of 50 bytes."""
        hashed = self.grams(OVERLAP)
        triggers = np.flatnonzero(hashed % np.uint64(PERIOD) == 0)
        owner = np.searchsorted(self.ends, triggers, "right")
        inside = (triggers > self.begins[owner]) & (triggers + OVERLAP <= self.ends[owner])
        long = np.flatnonzero(self.ends - self.begins >= LENGTH)
        begins = np.concatenate([self.begins[long], triggers[inside]])
        owner = np.concatenate([long, owner[inside]])
        order = np.argsort(begins, kind="stable")
        begins, owner = begins[order], owner[order]
        ends = self.ends[owner]
        same = owner[1:] == owner[:-1]
        ends[:-1][same] = begins[1:][same] + OVERLAP
        holds = ends - begins >= LENGTH
        return begins[holds], ends[holds], owner[holds]


def _parts(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[list[tuple]]:
    """Rows in groups of about a MB; a long text as several rows with the offset of each part."""
    group, size = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            doc, file, text, *rest = (c[i].as_py() for c in batch.columns)
            text = text.encode()
            digest = _digest(text)
            for at in range(0, max(len(text) - OVERLAP, 1), PART_BYTES):
                part = text[at : at + PART_BYTES + OVERLAP]
                group.append((doc, file, part, at, digest, *rest))
                size += len(part)
                if size >= limit:
                    yield group
                    group, size = [], 0
    if group:
        yield group


class _Rows:
    """What a task has read of texts since it last sent: a record for each part of a row."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []

    def add(self, group: list[tuple]) -> None:
        self.parts += [(g[0], g[1], *struct.unpack("<2Q", g[4]), g[3]) for g in group]

    def arrays(self) -> np.ndarray:
        return np.array(self.parts, np.dtype([*_ROW, ("at", "<u8")]))


def _first_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first of equal rows of a file; of these, those in the smallest document that has their text; a number for each text."""
    order = np.lexsort((rows["at"], rows["file"], rows["doc"], rows["twin"], rows["tag"]))
    sorted_ = rows[order]
    new_text = np.ones(len(rows), bool)
    new_text[1:] = (sorted_["tag"][1:] != sorted_["tag"][:-1]) | (sorted_["twin"][1:] != sorted_["twin"][:-1])
    new_row = new_text.copy()
    for field in ("doc", "file", "at"):
        new_row[1:] |= sorted_[field][1:] != sorted_[field][:-1]
    least = sorted_["doc"][np.maximum.accumulate(np.where(new_text, np.arange(len(rows)), 0))]
    first, chief, text = np.zeros(len(rows), bool), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
    first[order] = new_row
    chief[order] = new_row & (sorted_["doc"] == least)
    text[order] = np.cumsum(new_text)
    return first, chief, text


def _unrepeated(texts: Text, group: list[tuple]) -> np.ndarray:
    """Starts that no repeated phrase is known to cover."""
    ok = texts.starts()
    for (_, _, part, at, _, *notes), begin in zip(group, texts.begins.tolist()):
        for a, b in np.frombuffer(notes[0] if notes and notes[0] else b"", "<u4").reshape(-1, 2).tolist():
            low, high = max(a - at, 0), min(a + b - at, len(part))
            if low < high:
                ok[begin + low : begin + high] = False
    return ok


def _parse(n: int, kinds: tuple = (PHRASES, ANCHORS)):
    """Phrase occurrences and anchors of a task's texts, for ``n`` buckets; anchors of starts that are not known to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, places, anchors, owners, rows, read, chunks = [], [], [], [], _Rows(), 0, _chunks()
        for group in _parts(batches):
            texts, before = Text([g[2] for g in group]), len(rows.parts)
            rows.add(group)
            if len(texts.data) >= LENGTH and PHRASES in kinds:
                begins, ends, owner = texts.phrases()
                digests = b"".join(
                    hashlib.blake2b(texts.data[a:b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())
                )
                a = begins - texts.begins[owner] + np.array([g[3] for g in group], np.int64)[owner]
                phrases.append((*np.frombuffer(digests, "<u8").reshape(-1, 2).T, a, ends - begins - OVERLAP))
                places.append(owner + before)
            if len(texts.data) >= LENGTH and ANCHORS in kinds:
                grams, ok = texts.grams(ANCHOR), _unrepeated(texts, group)
                least = texts.anchors(grams)
                new = ok.copy()
                new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
                at = np.flatnonzero(new)
                anchors.append(grams[least[at]])
                owners.append(np.searchsorted(texts.ends, at, "right") + before)
            read += len(texts.data)
            if read >= FLUSH_BYTES:
                yield from _send_parse(phrases, places, anchors, owners, rows, next(chunks), n)
                phrases, places, anchors, owners, rows, read = [], [], [], [], _Rows(), 0
        if rows.parts:
            yield from _send_parse(phrases, places, anchors, owners, rows, next(chunks), n)

    return run


def _repeated_phrases(p: np.ndarray, q: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which occurrences are not in their phrase's smallest document."""
    order = np.lexsort((doc, q, p))
    p, q, sorted_ = p[order], q[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    first = sorted_[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[order] = sorted_ > first
    return again


def _send_parse(phrases, places, anchors, owners, read: _Rows, chunk: int, n: int) -> Iterator[pa.RecordBatch]:
    rows = read.arrays()
    first, chief, text = _first_rows(rows)
    numbers, names = _numbered(rows, first, chunk, n)
    yield from names
    told = []
    if phrases:
        place = np.concatenate(places)
        kept = first[place]
        place = place[kept]
        p, q, a, b = (np.concatenate(c)[kept] for c in zip(*phrases))
        doc = rows["doc"][place]
        again = _repeated_phrases(p, q, doc)
        told.append(_as_entries(rows, place[again], a[again], b[again]))
        order = np.flatnonzero(~again)
        buckets = _bucket(p, n)
        order = order[np.lexsort((a[order], place[order], doc[order], buckets[order]))]
        for low, high in _runs(buckets[order]):
            some = order[low:high]
            columns = (p[some], q[some], _steps(doc[some]), numbers[place[some]], a[some], b[some])
            yield _row(PHRASES, int(buckets[some[0]]), _columns(chunk, _PHRASE_COLUMNS, columns))
    # Of equal texts only the smallest document's anchors matter: the phrases of the others repeat.
    hashes = np.concatenate([*anchors, np.zeros(0, np.uint64)])
    who = np.concatenate([*owners, np.zeros(0, np.int64)])
    hashes, who = hashes[chief[who]], who[chief[who]]
    order = np.lexsort((who, hashes))
    hashes, who = hashes[order], who[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (who[1:] != who[:-1])
    hashes, who = hashes[once], who[once]
    new = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    shared = np.repeat(_several(text[who], at), np.diff(np.r_[at, len(hashes)]))
    tops = (hashes >> np.uint64(32)).astype(np.uint32)
    told.append(_as_entries(rows, who[shared], tops[shared], 0))
    yield from _entries(told, n)
    # A record per anchor: the top of its hash, in order, and the row, or none where it is known to be shared.
    # A text that several rows of a document have (in other files, or in parts) is told for each.
    sent = np.flatnonzero(new | ~shared)
    buckets = ((hashes[sent] & np.uint64((1 << 24) - 1)) * np.uint64(n) >> np.uint64(24)).astype(np.int32)
    order = np.argsort(buckets, kind="stable")
    sent, buckets = sent[order], buckets[order]
    number = np.where(shared, np.uint32(_TOLD), numbers[who])
    for low, high in _runs(buckets):
        some = sent[low:high]
        columns = (np.diff(tops[some], prepend=np.uint32(0)), number[some])
        yield _row(ANCHORS, int(buckets[low]), _columns(chunk, _ANCHOR_COLUMNS, columns))


def _several(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the groups that begin at these places hold several values."""
    if not len(at):
        return np.zeros(0, bool)
    return np.minimum.reduceat(values, at) != np.maximum.reduceat(values, at)


def _read(blobs: list[bytes], kinds: tuple, steps: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The chunk of each record of a bucket, and the columns; one of them came as steps."""
    chunks, parts = [], []
    for blob in blobs:
        chunk, columns, _ = _read_columns(blob, kinds)
        columns[steps] = np.cumsum(columns[steps], dtype=columns[steps].dtype)
        chunks.append(np.full(len(columns[0]), chunk, np.uint64))
        parts.append(columns)
    return np.concatenate(chunks), [np.concatenate(c) for c in zip(*parts)]


def _solved_phrases(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Chunk, row, start and number of starts of the occurrences that repeat."""
    chunks, (p, q, doc, rows, a, b) = _read(blobs, _PHRASE_COLUMNS, 2)
    again = _repeated_phrases(p, q, doc.view(np.int64))
    return chunks[again], rows[again], a[again], b[again]


def _shared_anchors(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Chunk and row of those whose anchor another has too, and the anchor."""
    chunks, (tops, rows) = _read(blobs, _ANCHOR_COLUMNS, 0)
    order = np.argsort(tops, kind="stable")
    tops, rows, chunks = tops[order], rows[order], chunks[order]
    told = rows == _TOLD
    at = np.flatnonzero(np.r_[True, tops[1:] != tops[:-1]])
    counts = np.diff(np.r_[at, len(tops)])
    wanted = np.repeat((counts > 1) | np.logical_or.reduceat(told, at), counts) & ~told
    tops = tops[wanted]
    return chunks[wanted], rows[wanted], tops, np.zeros(len(tops), np.uint32)


def _suffixes(n: int):
    """Pieces of text with suffixes that may have an equal, each under the bytes its suffixes share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        extra: list[tuple[bytes, list]] = []
        repeated: list[tuple] = []
        met: set[tuple] = set()
        rows, chunks = _Rows(), _chunks()
        for group in _parts(batches):
            # Equal rows of a file are one.
            once = dict.fromkeys(k for k in ((g[0], g[1], g[4], g[3]) for g in group) if k not in met)
            group = [g for g in group if once.pop((g[0], g[1], g[4], g[3]), 0) is None]
            met.update((g[0], g[1], g[4], g[3]) for g in group)
            texts, before = Text([g[2] for g in group]), len(rows.parts)
            if len(texts.data) < LENGTH:
                continue
            rows.add(group)
            ok, grams = _unrepeated(texts, group), texts.grams(ANCHOR)
            places = texts.anchors(grams)
            offset = places - np.arange(len(places))
            unit = np.where(ok, places * 4 + offset // GROUP, -1)
            cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            ends = np.r_[cuts[1:], len(unit)]
            cuts, ends = cuts[unit[cuts] >= 0], ends[unit[cuts] >= 0]
            tops = (grams[places[cuts]] >> np.uint64(32)).astype(np.uint32)
            bounds = np.searchsorted(cuts, np.r_[texts.begins, len(texts.data)])
            for row, ((doc, _, _, at, _, _, wanted), begin, low, high) in enumerate(
                zip(group, texts.begins.tolist(), bounds[:-1], bounds[1:]), before
            ):
                known = np.frombuffer(wanted or b"", "<u4")
                if not len(known) or low == high:
                    continue
                near = np.minimum(np.searchsorted(known, tops[low:high]), len(known) - 1)
                chosen = np.flatnonzero(known[near] == tops[low:high]) + low
                for a, b, place in zip(cuts[chosen].tolist(), ends[chosen].tolist(), places[cuts[chosen]].tolist()):
                    piece, start = texts.data[a : b + OVERLAP], a - begin + at
                    nearest = (place - a) // GROUP * GROUP
                    farthest = min(nearest + GROUP, _WINDOWS) - 1
                    core = zlib.crc32(texts.data[place - nearest : place - farthest + LENGTH])
                    owner = held.get(piece)
                    if owner is None:
                        held[piece] = [doc, row, core, start]
                    elif owner[1] == row:
                        owner.append(start)
                    elif owner[0] < doc:
                        repeated.append((row, start, b - a))
                    elif owner[0] > doc:
                        repeated += [(owner[1], s, b - a) for s in owner[3:]]
                        held[piece] = [doc, row, core, start]
                    else:  # another text under the same id, or another part
                        extra.append((piece, [doc, row, core, start]))
            if len(held) + len(extra) + len(repeated) // 2 >= PIECES:
                yield from _send_pieces(held, extra, repeated, rows, next(chunks), n)
                held, extra, repeated, met, rows = {}, [], [], set(), _Rows()
        if rows.parts:
            yield from _send_pieces(held, extra, repeated, rows, next(chunks), n)

    return run


def _send_pieces(held: dict[bytes, list], extra: list, repeated: list[tuple], read: _Rows, chunk: int, n: int) -> Iterator[pa.RecordBatch]:
    rows = read.arrays()
    numbers, names = _numbered(rows, np.ones(len(rows), bool), chunk, n)
    yield from names
    if repeated:
        yield from _entries([_as_entries(rows, *map(np.array, zip(*repeated)))], n)
    dealt: dict[int, list] = {}
    for piece, owner in [*held.items(), *extra]:
        for start in owner[3:]:
            dealt.setdefault(owner[2] % n, []).append((owner[0], owner[1], start, piece))
    for bucket, found in dealt.items():
        docs, owners, starts, pieces = zip(*sorted(found))
        columns = ([len(p) for p in pieces], _steps(np.array(docs, np.int64)), numbers[list(owners)], starts)
        yield _row(TEXTS, bucket, _columns(chunk, _PIECE_COLUMNS, columns) + b"".join(pieces))


def _repeated_suffixes(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Sort the suffixes of a bucket by their 50 bytes and document; chunk, row, start and number of those that repeat."""
    text = [blob[_read_columns(blob, _PIECE_COLUMNS)[2] :] for blob in blobs]
    chunks, (lengths, docs, rows, begins) = _read(blobs, _PIECE_COLUMNS, 1)
    lengths, data = lengths.astype(np.int64), b"".join(text)
    counts = lengths - OVERLAP
    piece = np.repeat(np.arange(len(lengths)), counts)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = (np.cumsum(lengths) - lengths)[piece] + nth
    again = _later(data, place, _fingerprints(data, lengths), docs.view(np.int64)[piece])
    # Neighbouring suffixes of a piece make one entry.
    begin = again.copy()
    begin[1:] &= ~again[:-1] | (piece[1:] != piece[:-1])
    end = again.copy()
    end[:-1] &= ~again[1:] | (piece[1:] != piece[:-1])
    at, until = np.flatnonzero(begin), np.flatnonzero(end)
    own = piece[at]
    return chunks[own], rows[own], (begins[own] + nth[at]).astype(np.uint32), (until - at + 1).astype(np.uint32)


def _later(data: bytes, place: np.ndarray, prints: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which 50-byte strings stand in a smaller document too.

    They are sorted by fingerprint and document; the bytes of equal fingerprints are compared, and where
    they differ the strings of that fingerprint are told apart one by one.
    """
    order = np.lexsort((owner, prints))
    new = np.ones(len(order), bool)
    new[1:] = prints[order][1:] != prints[order][:-1]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.zeros(len(order), bool)
    again[order] = owner[order] > owner[head]
    raw, offsets = np.frombuffer(data, np.uint8), np.arange(LENGTH)
    mixed: set[int] = set()
    followers = np.flatnonzero(~new)
    for at in range(0, len(followers), 1 << 16):
        some = followers[at : at + (1 << 16)]
        differ = (raw[place[order[some]][:, None] + offsets] != raw[place[head[some]][:, None] + offsets]).any(axis=1)
        mixed.update(prints[order[some[differ]]].tolist())
    for print_ in mixed:
        members = np.flatnonzero(prints == np.uint64(print_)).tolist()
        least: dict[bytes, int] = {}
        for i in members:
            string = data[place[i] : place[i] + LENGTH]
            least[string] = min(least.get(string, int(owner[i])), int(owner[i]))
        for i in members:
            again[i] = owner[i] > least[data[place[i] : place[i] + LENGTH]]
    return again


def _fingerprints(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """Hashes of the 50 bytes at every start of every piece, about a MB of text at a time."""
    out, at, done = [np.zeros(0, np.uint64)], 0, 0
    ends = np.cumsum(lengths)
    while done < len(lengths):
        until = max(int(np.searchsorted(ends, at + (1 << 20), "right")), done + 1)
        some = lengths[done:until]
        counts = some - OVERLAP
        starts = np.arange(int(counts.sum())) + np.repeat((np.cumsum(some) - some) - (np.cumsum(counts) - counts), counts)
        out.append(Text([data[at : int(ends[until - 1])]]).grams(LENGTH)[starts])
        at, done = int(ends[until - 1]), until
    return np.concatenate(out)


def _sort_buckets(n: int):
    """One bucket after the other: what repeats of phrases, anchors and pieces goes to the homes of the rows; names and entries pass."""
    solve = {PHRASES: _solved_phrases, ANCHORS: _shared_anchors, TEXTS: _repeated_suffixes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        for batch in batches:
            for kind, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == ENTRIES:
                    yield _packed_row(kind, bucket, data)
                    continue
                if held and (kind, bucket) != last:
                    yield from _sent_home(*solve[last[0]](held), n)
                    held = []
                last = (kind, bucket)
                held.append(_unpacked(data))
        if held:
            yield from _sent_home(*solve[last[0]](held), n)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry row per text with its repeated starts and its shared anchors."""
    held: list[bytes] = []
    last = None
    for batch in batches:
        for _, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
            if held and bucket != last:
                yield from _by_document(*_named(held))
                held = []
            last = bucket
            held.append(_unpacked(data))
    if held:
        yield from _by_document(*_named(held))


def _named(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a home, those that came whole and what the sorts found of the rows that its names number; the names."""
    kinds: dict[bytes, list[bytes]] = {_WHOLE: [], _NAMES: [], _FOUND: []}
    for blob in blobs:
        kinds[blob[:1]].append(blob[1:])
    parts = [np.frombuffer(b"".join(kinds[_WHOLE]), ENTRY)]
    names = sorted((int.from_bytes(b[:8], "little"), b[8:]) for b in kinds[_NAMES])
    begins = np.cumsum([0, *(len(b) // NAME.itemsize for _, b in names)])
    known, rows = np.array([chunk for chunk, _ in names], np.uint64), np.frombuffer(b"".join(b for _, b in names), NAME)
    for blob in kinds[_FOUND]:
        _, (steps, nth, a, b), _ = _read_columns(blob, _FOUND_COLUMNS)
        parts.append(_as_entries(rows, begins[np.searchsorted(known, np.cumsum(steps, dtype="<u8"))] + nth, a, b))
    return np.concatenate(parts), rows


def _by_document(found: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each file that has a text under an id, with all that was found of that text; those after the first file's are copies."""
    # Names go last in a text's entries, as starts past all others.
    listed = _as_entries(names, np.arange(len(names)), 0, _TOLD)
    found = np.concatenate([found, listed])
    found = found[np.lexsort((found["a"], found["b"] == _TOLD, found["twin"], found["tag"], found["doc"]))]
    apart = np.zeros(max(len(found) - 1, 0), bool)
    for name in ("doc", "tag", "twin"):
        apart |= found[name][1:] != found[name][:-1]
    cuts = np.flatnonzero(np.r_[True, apart]) if len(found) else np.zeros(0, np.int64)
    ends = np.r_[cuts[1:], len(found)]
    # Of most texts there is one name and nothing else.
    several = ends - cuts > 1
    rows = []
    for a, b in zip(cuts[several].tolist(), ends[several].tolist()):
        part = found[a:b]
        files, part = np.unique(part["file"]).tolist(), part[part["b"] != _TOLD]
        if not len(part) and len(files) == 1:
            continue
        spans, anchors = part[part["b"] > 0], part[part["b"] == 0]
        doc, digest = int(found["doc"][a]), struct.pack("<2Q", int(found["tag"][a]), int(found["twin"][a]))
        notes = (_merged(spans), np.unique(anchors["a"]).tobytes())
        rows += [(doc, file, digest, *notes, file != files[0]) for file in files]
        if len(rows) >= 4096:
            yield _gathered(rows)
            rows = []
    if rows:
        yield _gathered(rows)


def _merged(spans: np.ndarray) -> bytes:
    """Starts and lengths of the union of spans that are ordered by start."""
    if not len(spans):
        return b""
    begins, ends = spans["a"].astype(np.int64), spans["a"].astype(np.int64) + spans["b"]
    reach = np.maximum.accumulate(ends)
    new = np.r_[True, begins[1:] > reach[:-1]]
    starts, stops = begins[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(reach) - 1]]
    return np.stack([starts, stops - starts], axis=1).astype("<u4").tobytes()


def _gathered(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=_NOTES)


def _solved(sent: DataFrame, n: int) -> DataFrame:
    """What tasks sent, sorted in its buckets and gathered by document."""
    dealt = sent.repartition(n, "kind", "bucket").sortWithinPartitions("kind", "bucket")
    entries = by_batches(dealt, _sort_buckets(n), _ROWS)
    home = entries.repartition(n, "bucket").sortWithinPartitions("bucket")
    return by_batches(home, _gather, "_doc bigint, _mark bigint, digest binary, spans binary, anchors binary, copy boolean")


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            doc, text, *spans = (c[i].as_py() for c in batch.columns)
            data = text.encode()
            starts = np.concatenate([np.frombuffer(s or b"", "<u4").reshape(-1, 2) for s in spans]).astype(np.int64)
            merged = np.sort(np.array(list(map(tuple, starts.tolist())), [("a", "<i8"), ("b", "<i8")]), order="a")
            # A repeated start covers the 50 bytes from it on.
            merged["b"] += OVERLAP
            cover = np.frombuffer(_merged(merged), "<u4").reshape(-1, 2).tolist()
            kept, at = [], 0
            for a, n in cover:
                kept.append(data[at:a])
                at = a + n
            kept.append(data[at:])
            left = b"".join(kept)
            out.append((doc, len(data), len(data) - len(left), len(cover), left))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = list(zip(*out)) or [()] * 5
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _noted(found: DataFrame, label: str) -> str:
    """Write what is known of the rows in a folder for each of their files; the path."""
    path = scratch_path(found.sparkSession, label)
    # A file's notes are one task's: they are as large as the file at most.
    found.repartition("_mark").write.partitionBy("_mark").parquet(path)
    return path


def _notes(path: str, number: int) -> dict[tuple[int, bytes], tuple[bytes, bytes, bool]]:
    """Spans and anchors, and whether it is a copy, of the rows of one file, by document and digest of the text."""
    system, place = fs.FileSystem.from_uri(path)
    folder = f"{place}/_mark={number}"
    if system.get_file_info(folder).type == fs.FileType.NotFound:
        return {}
    table = dataset.dataset(folder, filesystem=system, format="parquet").to_table()
    doc, digest, *notes = (table[c].to_pylist() for c in ("_doc", "digest", "spans", "anchors", "copy"))
    return dict(zip(zip(doc, digest), zip(*notes)))


def _beside(paths: list[str], take, step):
    """A step over rows with what the notes at the paths say of them; rows come file by file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[pa.RecordBatch]:
            known, notes = None, []
            for batch in batches:
                found = []
                for doc, number, text in zip(*(batch.column(c).to_pylist() for c in ("_doc", "_mark", "text"))):
                    if number != known:
                        known, notes = number, [_notes(p, number) for p in paths]
                    key = (doc, _digest(text.encode()))
                    found.append([n.get(key, (None, None, None)) for n in notes])
                yield take(batch, found)

        yield from step(told())

    return run


def _closed(spans: bytes | None, anchors: bytes | None, copy: bool | None) -> bytes | None:
    """The starts not to be sorted: those that repeat; in a copy all."""
    return _WHOLE_TEXT if copy else spans


def _with_phrases(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    """The rows with their repeated phrases."""
    columns = [batch.column(c) for c in ("_doc", "_mark", "text")]
    return pa.record_batch([*columns, pa.array([_closed(*f[0]) for f in found], pa.binary())], names=["_doc", "_mark", "text", "spans"])


def _with_anchors(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    """The rows that have shared anchors, with their repeated phrases."""
    chosen = [i for i, (_, (_, anchors, _)) in enumerate(found) if anchors]
    notes = [pa.array([_closed(*found[i][0]) for i in chosen], pa.binary()), pa.array([found[i][1][1] for i in chosen], pa.binary())]
    columns = [batch.column(c).take(pa.array(chosen, pa.int64())) for c in ("_doc", "_mark", "text")]
    return pa.record_batch([*columns, *notes], names=["_doc", "_mark", "text", "spans", "anchors"])


def _with_spans(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
    notes = [pa.array([f[k][0] for f in found], pa.binary()) for k in (0, 1)]
    return pa.record_batch([batch.column("doc_id"), batch.column("text"), *notes], names=["doc_id", "text", "spans", "more"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept``, the bytes that remain, of every row (actions).

    Texts are written once, which gives each a file that stays, and are not moved again: what the
    sorts find is noted by file, and tasks that read a file's texts read its notes beside them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    written = staged(rows, "texts", compression="zstd")
    number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    rows = written.select("doc_id", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_doc"), number.alias("_mark"), "text")
    total = written.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BUCKET_BYTES + 1
    texts = rows.select("_doc", "_mark", "text")
    first = _noted(_solved(by_batches(texts, _parse(n, (PHRASES,)), _ROWS), n), "first")
    anchors = by_batches(texts, _beside([first], _with_phrases, _parse(n, (ANCHORS,))), _ROWS)
    second = _noted(_solved(anchors, n), "second")
    pieces = by_batches(texts, _beside([first, second], _with_anchors, _suffixes(n)), _ROWS)
    third = _noted(_solved(pieces, n), "third")
    cut = _beside([first, third], _with_spans, _remove)
    return by_batches(rows, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def report(docs: DataFrame) -> DataFrame:
    return without_repeats(docs).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
