"""Operators over pages and conversations, against brute force and on odd rows."""

import datetime
import gzip
import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, url_filters, warc

# URL filters


def test_keys(spark):
    urls = {
        "http://a.B.example.com/x/y.html?q=/no": {"a.b.example.com", "b.example.com", "example.com", "a.b.example.com/", "a.b.example.com/x/"},
        "https://user@host.org:8080": {"host.org"},
        "ftp://localhost/a/b/": {"localhost/", "localhost/a/", "localhost/a/b/"},
        "no url": set(),
        "": set(),
        None: set(),
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    for r in url_filters.with_keys(rows).collect():
        assert set(r._keys) == urls[r.url] and len(r._keys) == len(set(r._keys))


def test_as_of(spark):
    rng = random.Random(1)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    hosts = [f"h{i}.com" for i in range(6)]
    captures = [(i, f"http://www.{rng.choice(hosts)}/{rng.choice('ab')}/p", day(rng.randint(0, 200))) for i in range(300)]
    captures += [(1000, None, day(3)), (1001, "http://h1.com/a/", None), (None, "http://h1.com/a/", day(5)), (1002, "x", day(1))]
    keys = hosts + [f"www.{h}/a/" for h in hosts]
    events = [(rng.choice(keys), day(rng.randint(0, 200)), rng.choice(["add", "remove"]), rng.choice("xy")) for _ in range(120)]
    events += [(None, day(1), "add", "x"), ("h1.com", None, "add", "x")] + events[:5]
    found = url_filters.evaluate(
        spark.createDataFrame(captures, "page_id bigint, url string, fetched date").withColumn("key", F.lit("clash")),
        spark.createDataFrame(events, "key string, day date, action string, category string"),
    ).collect()
    assert len(found) == len(captures)
    by_id = {r.page_id: r for r in found}
    for page, url, fetched in captures:
        best = None
        host = url.split("/")[2] if url and "//" in url else ""
        covers = [h for h in keys if host and (host == h or host.endswith("." + h) or (host + "/a/" == h and "/a/" in url))]
        for key in covers if fetched else []:
            past = sorted((d, a) for k, d, a, _ in events if k == key and d and d <= fetched)
            if past and max(a for d, a in past if d == past[-1][0]) == "add":
                best = max(best, (len(key), key)) if best and len(key) != best[0] else min(best or (len(key), key), (len(key), key))
        assert by_id[page].blocked == (best is not None), (page, url, fetched)
        assert by_id[page].entry == (best and best[1])


def test_url_empty(spark):
    captures = spark.createDataFrame([], "page_id bigint, url string, fetched date")
    events = spark.createDataFrame([], "key string, day date, action string, category string")
    assert url_filters.evaluate(captures, events).count() == 0
    one = spark.createDataFrame([(1, "http://a.b/", None)] * 2, "page_id bigint, url string, fetched date")
    assert [r.blocked for r in url_filters.evaluate(one, events).collect()] == [False]


# Chat formatting


def kept_by_hand(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((1 << 63 if turn is None else turn, role or "unknown", text or ""))
    whole = {c: sorted(t) for c, t in turns.items()}
    out = set()
    for c, t in whole.items():
        longer = any(
            len(o) > len(t) and o[: len(t)] == t and o[len(t)][0] > t[-1][0] for x, o in whole.items() if x != c
        )
        equal = [x for x, o in whole.items() if o == t and x is not None]
        if not longer and c == (min(equal) if equal else None):
            out.add(c)
    return out, whole


def test_chat(spark):
    rng = random.Random(2)
    rows = []
    for c in range(300):
        seed = rng.randrange(12)
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"text {seed} {t} {rng.random() if rng.random() < 0.05 else ''}"))
    rows += [(400, t, "user", str(t)) for t in range(300)] + [(401, t, "user", str(t)) for t in range(150)]
    rows += [(402, 0, "user", "0"), (402, 0, "user", "0")]
    rows += [(403, None, None, None), (403, 1, "user", "<|end|>"), (None, 0, "user", "lost"), (404, 0, "user", "lost")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", F.lit("clash"))
    kept, whole = kept_by_hand(rows)
    assert {r.conv_id for r in chat.maximal(frame).collect()} == kept
    found = sorted(chat.rendered(frame, 100).collect(), key=lambda r: (str(r.conv_id), r.part))
    texts = defaultdict(str)
    for r in found:
        texts[r.conv_id] += r.text
    mark = lambda s: s.replace("<|", "< |")
    assert set(texts) == kept
    for c in kept:
        assert texts[c] == "".join(f"<|{mark(role)}|>\n{mark(text)}<|end|>\n" for _, role, text in whole[c])
    assert [r.n_turns for r in found if r.conv_id == 400] == [100, 100, 100]
    assert chat.rendered(frame.limit(0)).count() == 0


# WARC


def test_record_round_trip():
    payload = "é<p>\r\n\r\n".encode() * 20
    digest = hashlib.sha256(payload).hexdigest()
    for page in (0, 5, -3, (1 << 63) - 1, None):
        fields, back = warc.parsed(warc.record(page, "http://a b/\n", payload, digest, None))
        assert back == payload and warc._page_of(fields["WARC-Record-ID"]) == page
        fields, back = warc.parsed(warc.record(page, None, payload, digest, 7))
        assert back == b"" and fields["WARC-Type"] == "revisit" and warc._page_of(fields["WARC-Refers-To"]) == 7
    member = warc.record(1, "u", payload, digest, None)
    with pytest.raises(Exception):
        warc.parsed(member[:-3])


def test_url_key():
    assert warc.url_key("HTTP://Www.Example.com:8080/a/b?c=d#e") == "com,example,www:8080)/a/b?c=d"
    assert warc.url_key(None) == "-" and "\n" not in warc.url_key("http://[bad\n") and "\t" not in warc.url_key("a\tb")


@pytest.fixture
def pages(spark):
    rng = random.Random(3)
    bodies = [f"<p>{i}</p>" * rng.randint(1, 80) for i in range(40)] + ["é" * 49, "é" * 50, "", None]
    rows = [(i * 7 % 500, f"http://h{rng.randrange(9)}.org/{rng.randrange(30)}", rng.choice(bodies)) for i in range(500)]
    rows += [(None, "http://h1.org/x", bodies[0]), (900, None, bodies[1]), (901, "not a url \t", "z" * 300), (901, "not a url \t", "z" * 300)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("file", F.lit("clash")).repartition(4)


def test_warc(pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    rows = pages.select("page_id", "html").collect()
    groups = defaultdict(list)
    for r in rows:
        if r.page_id is not None:
            groups[r.html or ""].append(r.page_id)
    wanted = []
    for r in rows:
        data = (r.html or "").encode()
        first = min(groups[r.html or ""], default=None)
        again = len(data) >= 100 and first is not None and first != r.page_id
        wanted.append((r.page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    found = [tuple(r) for r in warc.report(pages).collect()]
    assert sorted(found, key=str) == sorted(wanted, key=str)
    assert warc.report(pages.limit(0)).count() == 0


def test_warc_files_and_lookup(pages, scratch, spark):
    captures = warc.write_archives(pages, scratch)
    index = warc.write_index(captures, scratch)
    assert index.count() >= 1
    files = {r.file for r in captures.collect()}
    total = 0
    for name in files:
        with gzip.open(re.sub("^file:", "", name)) as file:
            total += file.read().count(b"WARC/1.1\r\nWARC-Type: ")
    assert total == pages.count()
    assert len(list(Path(re.sub("^file:", "", scratch)).glob("*.index"))) == index.count()
    wanted = spark.createDataFrame([("http://h1.org/x", None), ("http://nowhere/", 3), ("not a url \t", 901)], "url string, page_id bigint")
    assert sorted(r.page_id or 0 for r in warc.locate(wanted, index).collect()) == [0, 901, 901]


def test_index_in_one_task(spark, tmp_path, monkeypatch):
    """Equal entries over several blocks and files, and keys that are missing."""
    import pyarrow as pa

    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    lines = sorted([("k%03d" % (i // 4), i // 8, "f", i, 1) for i in range(100)])
    files = []
    for part in (lines[:41], lines[41:]):
        batch = pa.record_batch([pa.array(list(c)) for c in zip(*part)], names=["key", "page_id", "file", "offset", "length"])
        files += [tuple(r.values()) for b in warc._write_index(str(tmp_path))(iter([batch])) for r in b.to_pylist()]
    index = warc.Index(files)
    for key, page in {x[:2] for x in lines}:
        assert sorted(o for _, o, _ in index.find(key, page)) == [x[3] for x in lines if x[:2] == (key, page)]
    assert index.find("k", 1) == index.find("zzz", 1) == index.find("k001", 77) == []
