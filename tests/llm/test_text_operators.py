"""Operators over documents, against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from cases import DOCS, SF
from pyspark.sql import functions as F

from helixframe.llm import bpe, grace_dedup, minhash, mixing, quality, suffix_dedup, toxicity

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, key="doc_id"):
    rows = df.collect()
    return {r[key]: r for r in rows}, rows


# Quality rules


def test_quality_counts(documents, words):
    rng = random.Random(1)
    texts = []
    for i in range(40):
        pool = words(i, rng.choice([3, 30, 300]))
        texts.append("\n".join(" ".join(rng.choices(pool, k=rng.randint(0, 30))) + rng.choice(["", ".", " & | #"]) for _ in range(8)))
    found, _ = by_id(quality.report(documents(texts)))
    for i, text in enumerate(texts):
        w = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {x for x, c in Counter(windows).items() if c > 1}
        covered = {k + d for k, x in enumerate(windows) if x in many for d in range(3)}
        r = found[i]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_lines(documents, words):
    # Words that differ, so that only the lines decide.
    prose = ". ".join(" ".join(f"{w}{i}{k}" for k, w in enumerate(words(i, 12))) for i in range(9)) + "."
    bad = ["Home | News | Shop | Login | More", "HE!! SHE!! IT!!", "All rights reserved.", "no end of sentence here at all"]
    report = quality.line_first(documents([prose, "\n".join([prose, *bad]), "\n".join([prose, *bad * 12]), prose.replace(" ", " && ")]))
    found, _ = by_id(report)
    assert found[0].kept and found[0].lost_chars == 0
    assert found[1].kept and found[1].clean_text == prose and found[1].lost_chars == sum(map(len, bad))
    assert not found[2].kept and not found[3].kept


def test_quality_odd(odd):
    found, rows = by_id(quality.report(odd))
    assert len(rows) == odd.count()
    assert found[0].n_words == found[1].n_words == found[2].n_words == 0 and found[0].base_failed and not found[0].kept
    assert found[7].n_words == 20_000


# Mixing


def targets_by_loop(sizes, weights):
    """Water filling as it is told: cap, reshare, again."""
    total, left, out = sum(sizes.values()), dict(weights), {}
    rest = total
    while left:
        share = {s: rest * w / sum(left.values()) for s, w in left.items()}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3 * sizes[s]
            rest -= out[s]
            del left[s]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    names = [None, "a", "B", "ä", "z1", "z2", "zz"]
    rows = [(i, "w " * rng.randint(0, 40), "x", names[min(int(rng.expovariate(0.7)), 6)], 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.curriculum(docs).collect()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    wanted = targets_by_loop(sizes, {s: 1 + i % 3 for i, s in enumerate(order)})
    taken, longest = Counter(), Counter()
    for r in mixed:
        assert r.size == len(WORD.findall(rows[r.doc_id][1])) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(wanted[r.source])
        assert r.taken <= 3 * r.size and len(r.positions) * r.size == r.taken
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= longest[s]
    assert sorted(map(tuple, mixing.report(docs).collect()), key=str) == sorted(map(tuple, mixing.report(docs).collect()), key=str)


def test_mixing_order(spark):
    """Positions are the words demanded until then, so they fill the whole run evenly; late sources come late."""
    docs = spark.createDataFrame([(i, "w " * 10, "x", "abc"[i % 3], 0) for i in range(3000)], DOCS)
    due = mixing.training_order(mixing.curriculum(docs))
    rows = due.collect()
    positions = [r.position for r in rows]
    assert positions == sorted(positions)
    half = sum(p < 15_000 for p in positions) / len(positions)
    assert 0.48 < half < 0.52
    mean = {s: np.mean([r.position for r in rows if r.source == s]) for s in "abc"}
    assert mean["a"] < mean["b"] < mean["c"]


def test_mixing_schedules():
    for schedule in [*mixing.SCHEDULES, ((0.0, 1.0), (0.3, 5.0), (1.0, 0.0))]:
        segments = mixing._segments(schedule)
        t0, t1, done, w0, slope = segments[-1]
        assert done + (t1 - t0) * w0 + (t1 - t0) ** 2 * slope / 2 == pytest.approx(1)


def test_mixing_inverse(spark):
    from helixframe.llm.mixing import _share_until, _time_of

    for schedule in [*mixing.SCHEDULES, ((0.0, 1.0), (0.3, 5.0), (1.0, 0.0))]:
        shares = spark.range(0, 100).select((F.col("id") / 100).alias("s"))
        back = shares.select("s", _share_until(_time_of(F.col("s"), schedule), schedule).alias("b")).collect()
        assert all(abs(r.s - r.b) < 1e-9 for r in back)


def test_mixing_stage_and_odd(odd):
    counted = mixing.curriculum(odd)
    assert counted.count() == odd.count()
    staged = mixing.stage(odd)
    assert staged.columns == odd.columns
    taken = counted.select(F.sum("taken")).first()[0]
    words = staged.select(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert words == taken
    empty = odd.limit(0)
    assert mixing.report(empty).count() == 0 and mixing.stage(empty).count() == 0


def test_mixing_spreads_rows_without_ids(spark):
    """A third of all rows without an id lie in many slices, and each row is taken as its own text is due."""
    rows = [(None if i % 3 == 0 else i, f"w{i} " * (1 + i % 7), "x", "ab"[i % 2], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    slices = mixing.measure(docs.where("doc_id IS NULL")).groupBy(F.substring("_order", 1, 3)).count()
    assert slices.count() > 700 and slices.agg(F.max("count")).first()[0] < 10
    passes = {(r.doc_id, r.order_key): len(r.positions) for r in mixing.curriculum(docs).collect()}
    keyed = {r.k: (r.doc_id, r.text) for r in docs.select("doc_id", "text", mixing.hashed_order().alias("k")).collect()}
    taken = Counter((r.doc_id, r.text) for r in mixing.stage(docs).collect())
    assert taken == Counter({keyed[k]: n for (_, k), n in passes.items() if n})


# BPE


@pytest.fixture(scope="module")
def codec():
    with open(VOCABULARY, "rb") as file:
        return bpe.Codec(file.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_bpe_random(codec, reference):
    rng = random.Random(5)
    pool = ["a", "b", "é", " ", "\n", "\t", "0", "'s", "漢", "한", "🙂", "\x1c", "\x85", "　", "!", "the", "tion", "\x00", "́", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 40)))
        ids = codec.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids) == (text.encode(), text)


def test_bpe_long_pieces(codec, reference):
    rng = random.Random(6)
    for alphabet in ("ab", "aeiounrst", " ", "é"):
        text = "".join(rng.choices(alphabet, k=30_000))
        assert codec.encode(text).tolist() == reference.encode_ordinary(text)
    text = "ab " * 100_000
    assert codec.encode(text).tolist() == reference.encode_ordinary(text)


def test_bpe_bounded_tables(codec, reference, words):
    small = bpe.Transducer(codec.ranks, max_states=50)
    for word in words(8, 3000):
        assert small.encode(word.encode()) == reference.encode_ordinary(word) or codec.split.findall(word) != [word]
    assert len(small.states) < 200


def test_bpe_bounded_tables_inside_a_piece(codec, reference):
    """One piece of letters that meets far more states than the bound."""
    small, rng = bpe.Transducer(codec.ranks, max_states=60), random.Random(21)
    piece = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=20_000))
    most, move = [0], small._move
    small._move = lambda key: (most.append(len(small.states)), move(key))[1]
    assert small.encode(piece.encode()) == reference.encode_ordinary(piece)
    assert len(most) > 1000 and max(most) <= 62


def test_bpe_pairs_against_merges(codec):
    rng, machine = random.Random(9), codec.transducer
    ids = list(machine.tokens)
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids)
        assert machine.stay_apart(a, b) == (machine.merged(machine.tokens[a] + machine.tokens[b]) == [a, b])


def test_bpe_streaming_decode(codec):
    text = "naïve 漢字 🙂🙂 ok"
    ids = codec.encode(text)
    for size in (1, 2, 3, 7):
        decoder, out = bpe.Decoder(codec), ""
        for at in range(0, len(ids), size):
            out += decoder.feed(ids[at : at + size])[1]
            assert text.startswith(out)
        assert out + decoder.close() == text
    rng = random.Random(2)
    for _ in range(500):  # ids that make no UTF-8, in any pieces, as Python's own decoder reads them
        ids = np.array(rng.choices(range(256), k=12), np.uint32)
        decoder = bpe.Decoder(codec)
        got = "".join(decoder.feed(ids[at : at + 3])[1] for at in range(0, 12, 3)) + decoder.close()
        assert got == b"".join(codec.table[i] for i in ids).decode("utf-8", "replace")


def test_bpe_frames(odd, reference):
    found, rows = by_id(bpe.round_trip(odd, VOCABULARY, public_tokenizers.PATTERN))
    assert len(rows) == odd.count()
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for i, text in texts.items():
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        assert found[i].ids_sha256 == hashlib.sha256(ids).hexdigest() and found[i].n_tokens * 4 == len(ids)
        assert found[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    encoded = bpe.encode(odd, VOCABULARY, public_tokenizers.PATTERN)
    decoded, _ = by_id(bpe.decode(encoded, VOCABULARY, public_tokenizers.PATTERN), "doc_id")
    assert {i: r.text for i, r in decoded.items()} == texts
    assert bpe.encode(odd.limit(0), VOCABULARY, public_tokenizers.PATTERN).count() == 0


# Repeated strings


def repeats_by_hand(rows):
    """rows of (doc_id, bytes) -> what the operator returns, by every string's smallest document."""
    first = {}
    key = lambda i: float("inf") if i is None else i
    for i, data in rows:
        for j in range(len(data) - 49):
            s = data[j : j + 50]
            first[s] = min(first.get(s, float("inf")), key(i))
    out = []
    for i, data in rows:
        cover = bytearray(len(data))
        for j in range(len(data) - 49):
            if first[data[j : j + 50]] < key(i):
                cover[j : j + 50] = b"\1" * 50
        spans = sum(c and (k == 0 or not cover[k - 1]) for k, c in enumerate(cover))
        kept = bytes(b for b, c in zip(data, cover) if not c)
        out.append((i, len(data), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket", [1 << 24, 2_000])
def test_repeats(documents, words, monkeypatch, bucket):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    rng = random.Random(bucket)
    base = [" ".join(words(i, 120)) for i in range(12)]
    texts = list(base)
    for _ in range(60):
        a, b = rng.choice(base), rng.choice(base)
        cut = rng.randint(0, len(a) - 70)
        texts.append(b[: rng.randint(0, len(b))] + a[cut : cut + rng.randint(30, 300)] + " ".join(words(rng.random(), 9)))
    texts += [base[3]] * 3 + ["ab" * 400, "ba" * 300, "x" * 700, "x" * 49, base[0][:49], base[0][:50], base[0][:51]]
    rng.shuffle(texts)
    docs = documents(texts).repartition(5)
    found = sorted(map(tuple, suffix_dedup.report(docs).collect()), key=str)
    assert found == repeats_by_hand([(i, t.encode()) for i, t in enumerate(texts)])


def test_repeats_in_parts(documents, words, monkeypatch):
    """Long texts are parsed in parts, and pieces sent early; the results are the same."""
    import helixframe.llm.suffix_dedup as module

    texts = [" ".join(words(i % 3, 400)) + str(i) for i in range(5)]
    rows = [(i, i + 100, t, ) for i, t in enumerate(texts)]
    monkeypatch.setattr(module, "PART_BYTES", 500)
    monkeypatch.setattr(module, "PIECES", 20)
    monkeypatch.setattr(module, "FLUSH_BYTES", 3000)
    import pyarrow as pa

    def frame(rows, names):
        return pa.record_batch([pa.array(list(c)) for c in zip(*rows)], names=names)

    def through(step, batches):
        return [b for b in step(iter(batches))]

    def dealt(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["kind"], r["bucket"]))
        return [pa.record_batch([pa.array([r["kind"]], pa.int32()), pa.array([r["bucket"]], pa.int32()), pa.array([r["data"]], pa.binary())], names=["kind", "bucket", "data"]) for r in rows]

    def solved(batches):
        return [r for b in module._gather(iter(dealt(through(module._sort_buckets(3), dealt(batches))))) for r in b.to_pylist()]

    first = solved(through(module._parse(3), [frame(rows, ["d", "t", "x"])]))
    known = {(r["_doc"], r["_mark"]): r for r in first}
    more = [(d, t, x, known[d, t]["spans"], known[d, t]["anchors"]) for d, t, x in rows if (d, t) in known]
    second = {r["_doc"]: r["spans"] for r in solved(through(module._suffixes(3), [frame(more, list("dtxsa"))]))}
    final = [(d, x, known.get((d, t), {}).get("spans"), second.get(d)) for d, t, x in rows]
    left = [r for b in module._remove(iter([frame(final, list("dxsm"))])) for r in b.to_pylist()]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in left), key=str)
    assert got == repeats_by_hand([(i, t.encode()) for i, t in enumerate(texts)])


class Steps:
    """The steps of the operator in this process, as one task each."""

    def __init__(self, rows, n):
        self.rows, self.n = rows, n

    def sent(self, step, rows):
        import pyarrow as pa

        batch = pa.record_batch([pa.array(list(c)) for c in zip(*rows)], names=[f"c{i}" for i in range(len(rows[0]))])
        return [r for b in step(iter([batch])) for r in b.to_pylist()]

    def solved(self, sent):
        import pyarrow as pa

        def dealt(rows, *by):
            rows = sorted(rows, key=lambda r: [r[k] for k in by])
            return iter([pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary())]))])

        homes = [r for b in suffix_dedup._sort_buckets(self.n)(dealt(sent, "kind", "bucket")) for r in b.to_pylist()]
        notes = [r for b in suffix_dedup._gather(dealt(homes, "bucket")) for r in b.to_pylist()]
        assert len({(r["_doc"], r["_mark"], r["digest"]) for r in notes}) == len(notes)
        return {(r["_doc"], r["_mark"]): r for r in notes}

    def closed(self, notes, doc, file):
        return suffix_dedup._closed(*((notes[doc, file][k] for k in ("spans", "anchors", "copy")) if (doc, file) in notes else (None,) * 3))

    def phrases(self):
        return self.sent(suffix_dedup._parse(self.n, (suffix_dedup.PHRASES,)), self.rows)

    def anchors(self, first):
        rows = [(d, f, t, self.closed(first, d, f)) for d, f, t in self.rows]
        return self.sent(suffix_dedup._parse(self.n, (suffix_dedup.ANCHORS,)), rows)

    def pieces(self, first, second):
        rows = [(d, f, t, self.closed(first, d, f), second[d, f]["anchors"]) for d, f, t in self.rows if (d, f) in second]
        return self.sent(suffix_dedup._suffixes(self.n), rows)

    def all(self):
        """What is sent by each step, and the results."""
        out = [self.phrases()]
        first = self.solved(out[0])
        out.append(self.anchors(first))
        second = self.solved(out[1])
        out.append(self.pieces(first, second))
        third = self.solved(out[2])
        final = [(d, t, *(k.get((d, f), {}).get("spans") for k in (first, third))) for d, f, t in self.rows]
        left = self.sent(suffix_dedup._remove, final)
        results = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in left]
        return out, second, sorted(results, key=str)


def test_equal_rows_have_one_number():
    """Many rows without id and text, or equal otherwise, leave no others without a number."""
    rows = np.zeros(1001, np.dtype([*suffix_dedup._ROW, ("at", "<u8")]))
    rows["tag"][1000] = 1
    first = suffix_dedup._first_rows(rows)[0]
    numbers, names = suffix_dedup._numbered(rows, first, 0, 1)
    assert first.sum() == 2 and numbers[1000] == 1 and len(names) == 1


def _bytes(sent):
    return sum(int.from_bytes(r["data"][:8], "little") for r in sent)


def _alike(words, n):
    """Texts that have passages of each other."""
    rng = random.Random(n)
    base = [" ".join(words(700 + i, 250)) for i in range(n)]
    return [(i, i % 7, t[:900] + rng.choice(base)[300:700] + " ".join(words(rng.random(), 9))) for i, t in enumerate(base)]


@pytest.mark.parametrize("n", [1, 5, 90])
def test_repeats_of_many_chunks(words, monkeypatch, n):
    """Rows are known by their number in what a task sends at a time, by whatever bucket finds them."""
    import functools

    monkeypatch.setattr(suffix_dedup, "_parts", functools.partial(suffix_dedup._parts, limit=4000))
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 8000)
    monkeypatch.setattr(suffix_dedup, "PIECES", 50)
    rows = [(d - 20, f, t) for d, f, t in _alike(words, 40)]
    assert Steps(rows, n).all()[2] == repeats_by_hand([(d, t.encode()) for d, _, t in rows])


def test_what_is_sent_does_not_grow_with_the_buckets(words):
    """Records that go to more buckets take no more bytes: names of rows don't go with them."""
    rows = _alike(words, 300)
    few, many = (Steps(rows, n).all()[0] for n in (2, 60))
    for a, b in zip(few, many):
        assert _bytes(b) < 1.1 * _bytes(a)


def test_rows_repeated_with_their_ids_are_sorted_once(words, monkeypatch):
    """Where all rows stand in a second file too, no more anchors are shared, and no more pieces sent."""
    import functools

    monkeypatch.setattr(suffix_dedup, "_parts", functools.partial(suffix_dedup._parts, limit=4000))
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 8000)
    rows = _alike(words, 40)
    twice = rows + [(d, f + 7, t) for d, f, t in rows]
    (_, _, once), second, _ = Steps(rows, 5).all()
    (_, _, again), copied, results = Steps(twice, 5).all()
    assert results == repeats_by_hand([(d, t.encode()) for d, _, t in twice])
    assert {k: r["anchors"] for k, r in copied.items() if k in second} == {k: r["anchors"] for k, r in second.items()}
    texts = [sum(int.from_bytes(r["data"][:8], "little") for r in sent if r["kind"] == suffix_dedup.TEXTS) for sent in (once, again)]
    assert texts[0] == texts[1] > 0


def test_phrases_of_many_documents_share_no_anchors(words):
    """Only where a text differs from the one it repeats are suffixes sorted."""
    text = " ".join(words(5, 4000))
    rows = [(i, 0, text if i % 2 else text + " ".join(words(i, 30))) for i in range(8)]
    sent, second, results = Steps(rows, 3).all()
    assert results == repeats_by_hand([(d, t.encode()) for d, _, t in rows])
    assert max(len(r["anchors"]) for r in second.values()) // 4 < len(text) // 12 // 4


def test_repeats_of_one_id(documents, words, spark):
    """Texts under one id, or none, keep what others of that id lose, whatever their hashes have in common."""
    rng = random.Random(31)
    passages = [" ".join(words(400 + i, 30)) for i in range(8)]
    texts = [rng.choice(passages) + " ".join(words(500 + i, 20)) for i in range(40)] + [" ".join(words(600 + i, 25)) for i in range(20)]
    rows = [(rng.choice([None, 3, 5, 5, 9]), t) for t in texts] + [(1, passages[0]), (12, passages[1])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(4)
    expected = repeats_by_hand([(i, t.encode()) for i, t in rows])
    assert sorted(map(tuple, suffix_dedup.report(docs).collect()), key=str) == expected
    # Rows that repeat both id and text, in one file and in others.
    rows += rows[:30] + rows[:9]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    assert sorted(map(tuple, suffix_dedup.report(docs).collect()), key=str) == repeats_by_hand([(i, t.encode()) for i, t in rows])


def test_texts_are_told_apart_by_both_halves(words):
    """Two texts with one first half of their digest: an anchor that both have is shared."""
    rows = np.zeros(4, np.dtype([*suffix_dedup._ROW, ("at", "<u8")]))
    rows["doc"], rows["file"], rows["twin"] = [5, 3, 5, 3], [0, 0, 0, 1], [1, 2, 1, 2]
    first, chief, text = suffix_dedup._first_rows(rows)
    assert first.tolist() == [True, True, False, True] and chief.tolist() == [True, True, False, True]
    assert text[0] == text[2] != text[1] == text[3]


def test_equal_fingerprints_are_compared(words):
    """Strings with one fingerprint count as equal only if their bytes are."""
    text = " ".join(words(3, 60)).encode()
    data = text[:50] + text[:50] + text[50:100] + text[50:100]
    place, owner = np.array([0, 50, 100, 150]), np.array([4, 6, 5, 9])
    again = suffix_dedup._later(data, place, np.full(4, 77, np.uint64), owner)
    assert again.tolist() == [False, True, False, True]


def test_null_ids_are_spread(documents, words, spark, monkeypatch):
    """Entries of texts without ids go to many buckets."""
    found = np.zeros(2000, suffix_dedup.ENTRY)
    found["doc"], found["tag"] = (1 << 63) - 1, np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = [b["bucket"][0].as_py() for b in suffix_dedup._entries([found], 20)]
    assert len(set(rows)) == 20


def test_repeats_odd(odd):
    found = sorted(map(tuple, suffix_dedup.report(odd).collect()), key=str)
    assert found == repeats_by_hand([(r.doc_id, (r.text or "").encode()) for r in odd.collect()])
    assert suffix_dedup.report(odd.limit(0)).count() == 0


# Near copies


def test_cells_against_python(words):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(words(1, 6), k=n)).encode() for n in (0, 1, 3, 4, 5, 6, 50, 500)] + [b"", b" \n ", b"a  b\tc\x0bd e f"]
    cells, owners = minhash.shingle_cells(texts)
    sets = []
    for i, text in enumerate(texts):
        w = text.split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else Counter()
        sets.append({(g, n) for g, c in grams.items() for n in range(c)})
        assert len(set(cells[owners == i].tolist())) == int((owners == i).sum()) == len(sets[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert len(a & b) == len(set(cells[owners == i].tolist()) & set(cells[owners == j].tolist()))


def test_cells_of_long_text(words, monkeypatch):
    text = " ".join(words(3, 5000)).encode()
    whole = minhash.shingle_cells([text])[0]
    monkeypatch.setattr(minhash, "_BATCH_BYTES", 1000)
    assert (np.sort(whole) == np.sort(minhash.shingle_cells([text])[0])).all()


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, shared in ((100, 80), (1000, 500), (20_000, 16_000), (3, 2)):
        pool = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = pool[:n], pool[n - shared :]
        k = 2000
        _, s = minhash.signatures(np.concatenate([a, b]), np.r_[np.zeros(n, int), np.ones(n, int)], 2, k, k * 9)
        true = shared / (2 * n - shared)
        assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2000)] + [(i, i + 1) for i in range(4000, 4200)]
    edges += [(5000, 5001 + i) for i in range(300)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    found = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: root(x) for e in edges for x in e if root(x) != x}
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_classes(documents, words):
    """Classes as brute force has them: links of 0.8 and more, and their components."""
    rng = random.Random(11)
    texts = []
    for i in range(25):
        base = words(100 + i, rng.randint(40, 400))
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 2, 15])):
            edited = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                edited[rng.randrange(len(edited))] = "new" + str(rng.random())
            texts.append("  ".join(edited))
    rng.shuffle(texts)
    sets = []
    for t in texts:
        w = t.split()
        c = Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1)))
        sets.append({(g, n) for g, m in c.items() for n in range(m)})
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found, _ = by_id(minhash.near_classes(documents(texts).repartition(3)))
    assert {i: r.class_id for i, r in found.items()} == {i: root(i) for i in range(len(texts))}
    sizes = Counter(root(i) for i in range(len(texts)))
    assert all(r.class_size == sizes[r.class_id] for r in found.values())


def test_near_repeated_ids(spark, words):
    """A row that is a copy takes only itself out of the search: other texts of its id keep their links."""
    a, b = " ".join(words(1, 80)), words(2, 80)
    changed = [*b[:40], "changed", *b[41:]]
    rows = [(1, a), (5, a), (5, " ".join(b)), (9, " ".join(changed)), (11, " ".join(words(3, 80)))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    found = {r.doc_id: r.class_id for r in minhash.near_classes(docs).collect()}
    assert found == {1: 1, 5: 1, 9: 1, 11: 11}


@pytest.mark.parametrize("chunk", [1024, 40])
def test_near_template(documents, monkeypatch, chunk):
    """Families of one template: 0.75 to 0.79 between them, 0.8 to 0.85 inside."""
    monkeypatch.setattr(minhash, "CHUNK", chunk, raising=False)
    template = " ".join(f"t{k}" for k in range(870))
    own = lambda name, n: " ".join(f"{name}_{k}" for k in range(n))
    families = 150
    texts = [f"{template} {own(f'f{i // 2}', 38)} {own(f'd{i}', 90)}" for i in range(2 * families)]
    cells, owners = minhash.shingle_cells([t.encode() for t in texts])
    sets = [set(cells[owners == i].tolist()) for i in range(len(texts))]
    for i, a in enumerate(sets):
        for j in range(i):
            alike = len(a & sets[j]) / len(a | sets[j])
            assert 0.8 <= alike < 0.85 if i // 2 == j // 2 else 0.75 <= alike < 0.79
    found, _ = by_id(minhash.near_classes(documents(texts).repartition(3)))
    assert {i: r.class_id for i, r in found.items()} == {i: i - i % 2 for i in range(len(texts))}


def test_near_odd(odd):
    found, rows = by_id(minhash.near_classes(odd))
    assert len(rows) == odd.count()
    assert [found[i].class_id for i in (0, 1, 2)] == [0, 1, 2]
    assert found[4].class_id == 3 and found[6].class_id == 5 and found[8].class_id == 7
    assert found[None].class_id is None
    assert minhash.near_classes(odd.limit(0)).count() == 0
    assert minhash.stage(odd).columns == odd.columns


# Toxicity


def test_toxicity_held_out(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{SF}/../sf0.1/labels.parquet")
    found, rows = by_id(toxicity.report(docs, labels))
    assert len(rows) == docs.count()
    marks = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(marks[i], r.predicted) for i, r in found.items() if r.held_out and i in marks]
    hits = sum(m and p for m, p in held)
    assert hits / sum(m for m, _ in held) > 0.8 and hits / sum(p for _, p in held) > 0.95


def test_toxicity_blind_to_ids(spark):
    """Scores come from texts and training labels alone: held-out labels and lang and source change nothing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, _ = by_id(toxicity.report(docs, labels))
    b, _ = by_id(toxicity.report(docs.withColumn("lang", F.lit("q")).withColumn("source", F.lit("q")), flipped))
    assert {i: r.score for i, r in a.items()} == {i: r.score for i, r in b.items()}


def test_toxicity_rare_words(documents, words, spark):
    """A rare word of toxic texts has weight beside 20,000 n-grams that tell little but occur often."""
    rng = random.Random(4)
    common = [f"{w}{i}" for i, w in enumerate(words(4, 5000))]
    texts = [" ".join([w for w in common if rng.random() < (0.8 if i % 2 else 0.3)] + ["scumbag"] * (i % 2 and i < 60)) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(documents(texts), labels)
    assert len(model[0]) > 1 << 14
    found, _ = by_id(toxicity.scored(documents(["", "scumbag"]), model))
    assert found[1].score > found[0].score


def test_toxicity_copies_in_sample(documents, words, spark, monkeypatch):
    """Copies of one labelled text, the first by hash, leave the sample to other texts too."""
    monkeypatch.setattr(toxicity, "FIT_ROWS", 40)
    texts = [" ".join([*words(i, 30), *["scumbag"] * (i % 2)]) for i in range(120)]
    hashes = documents(texts).withColumn("h", F.xxhash64("text")).orderBy("h").collect()
    first = next(r.text for r in hashes if "scumbag" not in r.text)
    texts += [first] * 300
    rows = [(i, 1, int("scumbag" in t)) for i, t in enumerate(texts)]
    model = toxicity.train(documents(texts), spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int"))
    found, _ = by_id(toxicity.scored(documents(["plain words", "plain scumbag words"]), model))
    assert found[0].score < 0.1 and found[1].score > 3 * found[0].score


def grams_by_hand(text):
    """Distinct buckets of 5-grams."""
    clean, found = f" {text.lower()} ", set()
    for i in range(len(clean) - 4):
        mixed = 0
        for c in clean[i : i + 5]:
            mixed = (mixed * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
        mixed ^= mixed >> 29
        found.add(mixed * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - 20)
    return found


def test_toxicity_against_python(documents, words, spark):
    """Features, counts, ratios and the fit, against plain Python and a slow gradient descent."""
    rng = random.Random(17)
    texts = [" ".join(words(i, 12)) + (" slur slurs" if i % 3 == 0 else "") + rng.choice(["", " é"]) for i in range(90)]
    assert all(set(toxicity.features(t).tolist()) == grams_by_hand(t) for t in [*texts, "", "abc", "ÄÖ  x\n"])
    docs = documents(texts)
    marks = [(i, 1, int(i % 3 == 0) if i % 7 else None) for i in range(90)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    buckets, weights, bias = toxicity.train(docs, labels)
    rows = [(grams_by_hand(texts[i]), y) for i, _, y in marks if y is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    n = Counter(y for _, y in rows)
    count = {y: Counter(g for grams, own in rows if own == y for g in grams) for y in (0, 1)}
    a1, a0 = n[1] / len(rows), n[0] / len(rows)
    ratio = lambda g, d0=0, d1=0: np.log((max(count[1][g] - d1, 0) + a1) / (n[1] - d1)) - np.log((max(count[0][g] - d0, 0) + a0) / (n[0] - d0))
    strong = {g for g in {*count[0], *count[1]} if abs(ratio(g)) / np.sqrt(1 / (count[0][g] + 1) + 1 / (count[1][g] + 1)) >= toxicity.MIN_STRENGTH}
    assert strong == set(buckets.tolist())
    place = {g: i for i, g in enumerate(buckets.tolist())}
    x = np.zeros((len(rows), len(place)))
    for k, (grams, y) in enumerate(rows):
        for g in grams & strong:
            x[k, place[g]] = ratio(g, 1 - y, y)
    y = np.array([y for _, y in rows], float)
    w, b = np.zeros(len(place)), 0.0
    for _ in range(20_000):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= 0.002 * (x.T @ error + toxicity.RIDGE * w)
        b -= 0.002 * error.sum()
    expected = np.array([w[place[g]] * ratio(g) for g in buckets.tolist()])
    assert np.allclose(weights, expected, atol=1e-3) and abs(bias - b) < 1e-2
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, (buckets, weights, bias)).collect()}
    for i, text in enumerate(texts):
        by_hand = sum(weights[place[g]] for g in grams_by_hand(text) & strong) + bias
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-by_hand)))


def test_toxicity_bounded_bytes(documents, words, spark, monkeypatch):
    """Few long texts fill the sample by bytes; the model still tells the labels apart."""
    texts = [" ".join(words(i, 3000)) + " slur slurs" * (i % 2) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id bigint, quality int, toxic int")
    fitted, fit = [], toxicity._logistic
    monkeypatch.setattr(toxicity, "_logistic", lambda x, *rest: (fitted.append(len(x)), fit(x, *rest))[1])
    monkeypatch.setattr(toxicity, "MIN_STRENGTH", 0.0)
    toxicity.train(documents(texts), labels)
    monkeypatch.setattr(toxicity, "FIT_BYTES", 100_000)
    toxicity.train(documents(texts), labels)
    assert fitted[0] > 2 * fitted[1] >= 2


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(3, 0, 1), (5, 0, 0), (7, 1, 0), (8, 1, 1), (None, 1, 1), (9, 1, None), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    found, rows = by_id(toxicity.report(odd, labels))
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert found[0].score == found[1].score
    none = toxicity.report(odd, labels.limit(0))
    assert all(r.score < 1e-9 for r in none.collect())
    assert toxicity.report(odd.limit(0), labels).count() == 0
    assert toxicity.stage(odd, labels).columns == odd.columns


def test_stages_without_ids(spark, words):
    """Rows with null or repeated ids pass a stage by what their own text is."""
    clean = [" ".join(words(i, 120)) for i in range(60)]
    toxic = [" ".join([*words(900 + i, 60), "scumbag", *words(700 + i, 30), "scumbag"]) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id bigint, quality int, toxic int")
    near = clean[5].split(" ")
    near[60] = "changed"
    near = " ".join(near)
    rows = [(i, t) for i, t in enumerate(clean + toxic)]
    make = lambda more: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows + more], DOCS)
    texts = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    more = [(None, toxic[0] + " end"), (None, clean[0] + " end"), (2, toxic[1] + " end")]
    assert texts(toxicity.stage(make(more), labels)) == Counter([*rows[:60], (None, clean[0] + " end")])
    assert texts(grace_dedup.stage(make([(None, clean[3])]))) == Counter(rows)
    other = " ".join(words(500, 120))
    more = [(None, near), (None, other), (None, other + " end"), (None, other)]
    left = texts(minhash.stage(make(more)))
    assert left - Counter(rows) in (Counter([(None, other)]), Counter([(None, other + " end")]))
    assert not Counter(rows[:60]) - left


# Exact copies


def copies_by_hand(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [300, 20_000, 1 << 24])
def test_exact_groups(documents, words, bound):
    rng = random.Random(bound)
    pool = [" ".join(words(i, rng.randint(0, 60))) for i in range(150)]
    texts = [rng.choice([" ", "\t", "\n "]).join(rng.choice(pool).split(" ")) for _ in range(500)] + [pool[3]] * 200
    found = sorted(map(tuple, grace_dedup.exact_groups(documents(texts).repartition(4), bound).collect()), key=str)
    assert found == copies_by_hand(list(enumerate(texts)))


def test_grace_recursion(tmp_path):
    """A bound of a few records sends records down many levels, equal digests included."""
    rng = random.Random(1)
    records = []
    for i in range(3000):
        text = str(rng.randrange(700)).encode()
        records.append((b"\0" * 30 + hashlib.sha256(text).digest()[:2], text, i, 1))
    tables = list(grace_dedup.grace(iter(records), str(tmp_path), 900))
    merged = sorted(tuple(r) for t in tables for r in t.records)
    wanted = {}
    for digest, text, i, n in records:
        old = wanted.get(text)
        wanted[text] = (digest, text, i, 1) if old is None else (digest, text, min(i, old[2]), old[3] + 1)
    assert merged == sorted(wanted.values()) and not list(tmp_path.iterdir())


def test_open_table_compares_contents():
    table = grace_dedup.OpenTable()
    for i, text in enumerate([b"a", b"b", b"a", b"c"]):
        table.add(b"same digest.....", text, i, 1)
    assert [tuple(r[1:]) for r in table.records] == [(b"a", 0, 2), (b"b", 1, 1), (b"c", 3, 1)]


def test_exact_odd(odd):
    found = sorted(map(tuple, grace_dedup.exact_groups(odd).collect()), key=str)
    assert found == copies_by_hand([(r.doc_id, r.text) for r in odd.collect()])
    left = grace_dedup.stage(odd)
    assert left.columns == odd.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([0, 2, 3, 5, 7, 8, 9, 10, 11, None], key=str)
    assert grace_dedup.exact_groups(odd.limit(0)).count() == 0 and grace_dedup.stage(odd.limit(0)).count() == 0
