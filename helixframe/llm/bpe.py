"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

A token sequence is the BPE encoding of its bytes exactly when every two neighbours are the
encoding of their own bytes. So the last token of each prefix is determined by the tokens that
prefixes a few bytes shorter end with, and a left-to-right machine can carry them along: a state
holds, for every position from which a vocabulary token may still reach beyond the present byte,
the bytes since then, the token that ends there and the tokens not yet sent. Tokens are sent once
all those positions agree on them, that is after a lookahead bounded by the longest token. States
and transitions are built from the merge ranks when a text first needs them; beyond a bound they are
dropped and built again.

Decoding joins the tokens' bytes. The streaming decoder runs the UTF-8 state machine over tokens
(next state per state and token, tabulated), hands out whole characters and holds back the bytes of
an unfinished one.

Defined results: a null or empty text has no tokens. Special tokens' strings are ordinary text.
Repeated rows are encoded each for itself. Bytes that are no UTF-8 decode to U+FFFD in text; the
decoded bytes are always exact. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import by_batches, text_of

#: What a worker keeps, about 0.5 kB for each state and 0.3 kB for each piece; results do not depend on it.
MAX_STATES = 400_000
MAX_PIECES = 400_000
CHUNK = 1 << 16


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Tokens of one pre-split piece, byte by byte."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        # The tokens' trie: child by node and byte, the rank that ends at a node, whether it goes on.
        self.child: dict[int, int] = {}
        self.rank_at, self.goes_on = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                self.goes_on[node] = True
                node = self.child.setdefault(key, len(self.rank_at))
                if node == len(self.rank_at):
                    self.rank_at.append(-1)
                    self.goes_on.append(False)
            self.rank_at[node] = rank
        #: Whether merges make a token from its own bytes, and whether they leave two as they are.
        self.reachable: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.made_of: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        # A state is packed: node, last token + 1, number of unsent tokens and those, for each position;
        # the present position comes first. Small objects, since there are many states.
        start = struct.pack("<3I", 0, 0, 0)
        self.states = [start]
        self.numbers = {start: 0}
        #: By state and byte: the next state and the number of what is sent.
        self.moves: dict[int, int] = {}
        self.sends: list[tuple[int, ...]] = [()]
        self.send_numbers: dict[tuple[int, ...], int] = {(): 0}

    def _restarted(self, state: int) -> int:
        """Empty tables, but for the state given."""
        packed = self.states[state >> 8]
        self.reset()
        number = self.numbers.setdefault(packed, len(self.states))
        if number == len(self.states):
            self.states.append(packed)
        return number << 8

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Lowest rank first, leftmost first: what the merges themselves say about a short text."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _may_follow(self, last: int, rank: int) -> bool:
        if last < 0:
            known = self.reachable.get(rank)
            if known is None:
                known = self.reachable[rank] = self.merged(self.tokens[rank]) == [rank]
            return known
        key = last << 32 | rank
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > self.max_states:
                self.fits.clear()
            known = self.fits[key] = self.stay_apart(last, rank)
        return known

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token; None for a single byte."""
        if rank not in self.made_of:
            token = self.tokens[rank]
            self.made_of[rank] = tuple(self.merged(token, 2)) if len(token) > 1 else None
        return self.made_of[rank]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merges leave two tokens as they are when one follows the other.

        Merges are undone from both sides of the border, the later one first. A merge across the
        border would have come first if its rank is below that of the left token's next merge and
        not above that of the right token's (of equal ranks the leftmost merges first).
        """
        next_left = next_right = 1 << 62
        while True:
            across = self.ranks.get(self.tokens[left] + self.tokens[right])
            if across is not None and across < next_left and across <= next_right:
                return False
            of_left, of_right = self.halves(left), self.halves(right)
            if of_right is not None and (of_left is None or right >= left):
                next_right, right = right, of_right[0]
            elif of_left is not None:
                next_left, left = left, of_left[1]
            else:
                return True

    def _move(self, key: int) -> int:
        """The transition of a state and byte met for the first time, and what it sends."""
        byte, alive, sent, child, fits = key & 255, [], None, self.child.get, self.fits.get
        packed = self.states[key >> 8]
        values = struct.unpack(f"<{len(packed) // 4}I", packed)
        at = 0
        while at < len(values):
            last, until = values[at + 1] - 1, at + 3 + values[at + 2]
            grown = child(values[at] << 8 | byte)
            if grown is not None:
                if sent is None and (rank := self.rank_at[grown]) >= 0:
                    known = fits(last << 32 | rank)
                    if known or known is None and self._may_follow(last, rank):
                        sent = (*values[at + 3 : until], rank)
                if self.goes_on[grown]:
                    alive.append((grown, last, values[at + 3 : until]))
            at = until
        if sent is None:
            raise ValueError(f"no token can end at byte {byte} here: the ranks are not those of byte-level merges")
        agreed = len(sent)
        for _, _, unsent in alive:
            agreed = min(agreed, len(unsent))
            while unsent[:agreed] != sent[:agreed]:
                agreed -= 1
        flat = [0, sent[-1] + 1, len(sent) - agreed, *sent[agreed:]]
        for node, last, unsent in alive:
            flat += (node, last + 1, len(unsent) - agreed, *unsent[agreed:])
        state = struct.pack(f"<{len(flat)}I", *flat)
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
        number = self.send_numbers.setdefault(sent[:agreed], len(self.sends))
        if number == len(self.sends):
            self.sends.append(sent[:agreed])
        move = self.moves[key] = target << 24 | number
        return move

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.states) > self.max_states or len(self.sends) > 1 << 23:
            self.reset()
        state, out, moves, sends = 0, [], self.moves.get, self.sends
        for byte in piece:
            move = moves(state | byte)
            if move is None:
                if len(self.states) > self.max_states or len(sends) > 1 << 23:
                    # A long piece meets many states: all but the present one are built anew when met again.
                    state = self._restarted(state)
                    moves, sends = self.moves.get, self.sends
                move = self._move(state | byte)
            state = move >> 24 << 8
            if number := move & 0xFFFFFF:
                out += sends[number]
        packed = self.states[state >> 8]
        out += struct.unpack_from(f"<{int.from_bytes(packed[8:12], 'little')}I", packed, 12)
        return out


#: The UTF-8 machine: 0 between characters, 1 to 3 that many continuation bytes to come, then the
#: states after E0, ED, F0 and F4, which narrow the next byte; -1 is an error.
_NARROW = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}


def next_state(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if 0xE0 <= byte <= 0xEF:
            return _NARROW.get(byte, 2)
        if 0xF0 <= byte <= 0xF4:
            return _NARROW.get(byte, 3)
        return -1
    low, high = {4: (0xA0, 0xBF), 5: (0x80, 0x9F), 6: (0x90, 0xBF), 7: (0x80, 0x8F)}.get(state, (0x80, 0xBF))
    if not low <= byte <= high:
        return -1
    return {1: 0, 2: 1, 3: 2, 4: 1, 5: 1, 6: 2, 7: 2}[state]


class Decoder:
    """Ids to text as they come; unfinished characters wait for their last byte."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.state, self.held = codec, 0, b""

    def feed(self, ids: np.ndarray) -> tuple[bytes, str]:
        """The ids' bytes, and the characters that are complete with them."""
        table = self.codec.table
        data = b"".join(map(table.__getitem__, ids.tolist()))
        state = self._run(ids)
        text = self.held + data
        if state >= 0:
            cut = len(text)
            if state:
                while text[cut - 1] & 0xC0 == 0x80:
                    cut -= 1
                cut -= 1
            self.state, self.held = state, text[cut:]
            return data, text[:cut].decode("utf-8")
        return data, self._repair(text)

    def _run(self, ids: np.ndarray) -> int:
        """The state after the ids. Only ids that begin or end inside a character need a step."""
        nexts, state, at = self.codec.nexts, self.state, 0
        uneven = np.flatnonzero(nexts[0][ids])
        while state >= 0 and at < len(ids):
            if state == 0:
                k = np.searchsorted(uneven, at)
                if k == len(uneven):
                    return 0
                at = int(uneven[k])
            state = int(nexts[state][ids[at]])
            at += 1
        return state

    def _repair(self, text: bytes) -> str:
        """Byte by byte, with U+FFFD for each longest part that can't begin a character."""
        out, begun, state, i = [], 0, 0, 0
        while i < len(text):
            following = next_state(state, text[i])
            if following >= 0:
                i += 1
                if following == 0:
                    out.append(text[begun:i].decode("utf-8"))
                    begun = i
                state = following
                continue
            out.append("�")
            i += state == 0
            begun, state = i, 0
        self.state, self.held = state, text[begun:]
        return "".join(out)

    def close(self) -> str:
        left, self.state, self.held = self.held, 0, b""
        return "�" if left else ""


class Codec:
    """A vocabulary with its split pattern."""

    def __init__(self, data: bytes, pattern: str, max_states: int = MAX_STATES, max_pieces: int = MAX_PIECES) -> None:
        self.ranks = read_ranks(data)
        self.transducer = Transducer(self.ranks, max_states)
        self.split = regex.compile(pattern)
        self.table = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        # Only tokens with bytes above 127 can begin or end inside a character.
        self.nexts = np.zeros((8, len(self.table)), np.int8)
        self.nexts[1:] = -1
        for rank, token in enumerate(self.table):
            if not token.isascii():
                for state in range(8):
                    now = state
                    for byte in token:
                        now = next_state(now, byte)
                        if now < 0:
                            break
                    self.nexts[state, rank] = now
        self.pieces = _Pieces(self.transducer, max_pieces)

    def encode(self, text: str) -> np.ndarray:
        get = self.pieces.__getitem__
        if len(text) <= CHUNK:
            return np.frombuffer(b"".join(map(get, self.split.findall(text))), "<u4")
        # A long text's pieces are not all held at once.
        parts, found = [], []
        for match in self.split.finditer(text):
            found.append(get(match[0]))
            if len(found) == CHUNK:
                parts.append(b"".join(found))
                found.clear()
        return np.frombuffer(b"".join([*parts, *found]), "<u4")

    def decode(self, ids: np.ndarray) -> tuple[bytes, str]:
        decoder, data, text = Decoder(self), [], []
        for at in range(0, len(ids), CHUNK):
            some, whole = decoder.feed(ids[at : at + CHUNK])
            data.append(some)
            text.append(whole)
        return b"".join(data), "".join(text) + decoder.close()


class _Pieces(dict):
    """Ids of pieces seen before, as little-endian bytes.

    When it is full, a new generation begins, and what is met again is taken over from the last.
    """

    def __init__(self, transducer: Transducer, max_pieces: int) -> None:
        super().__init__()
        self.transducer, self.max_pieces = transducer, max_pieces
        self.last: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.last.get(piece)
        if ids is None:
            found = self.transducer.encode(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(ids) <= 64:
            if len(self) >= self.max_pieces:
                self.last = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_LOADED: dict[tuple, Codec] = {}


def codec(data: bytes, *settings) -> Codec:
    """One codec per worker process, vocabulary and settings; another one takes its place."""
    key = (hashlib.sha256(data).hexdigest(), *settings)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Codec(data, *settings)
    return _LOADED[key]


def forget() -> None:
    _LOADED.clear()


def _vocabulary(spark: SparkSession, path: str):
    """The rank file, read on the driver; its size does not depend on the corpus."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every text."""
    return round_trip(docs, path, pattern, with_ids=True).select("doc_id", "ids")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of encoded rows."""
    data = _vocabulary(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, pattern)
        for batch in batches:
            texts = [own.decode(np.array(ids or [], np.int64))[1] for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return by_batches(tokens.selectExpr("cast(doc_id AS bigint) AS doc_id", "ids"), run, "doc_id bigint, text string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text"))


def _listed(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    values = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    with_ids: bool = False,
    max_states: int = MAX_STATES,
    max_pieces: int = MAX_PIECES,
) -> DataFrame:
    """Encode every text and decode its ids again: token count and digests of ids and bytes, ids on request."""
    data = _vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data.value, pattern, max_states, max_pieces)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [own.encode(text) for text in part.column(1).to_pylist()]
                columns = {
                    "doc_id": part.column(0),
                    "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(own.decode(x)[0]).hexdigest() for x in ids]),
                }
                yield pa.record_batch(columns | ({"ids": _listed(ids)} if with_ids else {}))

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return by_batches(_narrow(docs), run, schema + ", ids array<int>" * with_ids)
