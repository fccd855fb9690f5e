"""Block-gzip files against the whole text, whatever the ranges."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

from helixframe.schemas import WEIGHTS
from helixframe.sources import blockgzip


def packed(text, cuts):
    """A block-gzip file of the text, with members that end at the cuts."""
    bounds = sorted({0, *cuts, len(text)})
    return b"".join(blockgzip.member(text[a:b]) for a, b in zip(bounds, bounds[1:])) + blockgzip._END


def lines_by_hand(text):
    lines = text.split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


@pytest.mark.parametrize("seed", range(6))
def test_ranges_have_every_line_once(seed):
    rng = random.Random(seed)
    text = b"\n".join(bytes(rng.choices(b"ab\x1f\x8b\x08\x04BC", k=rng.choice([0, 1, 5, 40, 900]))) for _ in range(rng.choice([1, 30, 200])))
    text += rng.choice([b"", b"\n", b"\n\n"])
    newlines = [i + 1 for i, c in enumerate(text) if c == 10]
    cuts = [rng.randrange(len(text) + 1) for _ in range(rng.choice([0, 3, 60]))] + rng.sample(newlines, min(len(newlines), 9))
    data = packed(text, cuts)
    assert gzip.decompress(data) == text
    for width in (1, 7, 64, 500, 1 << 20):
        found = [x for a in range(0, len(data), width) for x in blockgzip.lines_of_range(io.BytesIO(data), len(data), a, min(a + width, len(data)))]
        assert found == lines_by_hand(text), width


def test_a_line_longer_than_many_ranges():
    text = b"short\n" + b"x" * 300_000 + b"\nend"
    data = packed(text, range(0, len(text), 9_000))
    found = [x for a in range(0, len(data), 100) for x in blockgzip.lines_of_range(io.BytesIO(data), len(data), a, a + 100)]
    assert found == lines_by_hand(text)


def test_members_that_do_not_compress():
    noise = random.Random(1).randbytes(blockgzip.BLOCK_BYTES)
    made = blockgzip.member(noise)
    assert len(made) <= 1 << 16 and blockgzip.member_size(made) == len(made) and gzip.decompress(made) == noise


def test_plain_gzip_is_one_stream():
    text = b"".join(b"line %d\n" % i for i in range(50_000))
    data = gzip.compress(text[:100_000]) + gzip.compress(text[100_000:])
    read = lambda a, b: list(blockgzip.lines_of_range(io.BytesIO(data), len(data), a, b))
    assert read(0, 10) == lines_by_hand(text) and read(10, len(data)) == []
    with pytest.raises(ValueError):
        list(blockgzip.lines_of_range(io.BytesIO(data[:-9]), len(data) - 9, 0, 10))


def test_one_file_is_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    rows = [f"{i},{rng.random()}" for i in range(60_000)]
    text = "\n".join(["location,weight", *rows]).encode()
    (tmp_path / "a.csv.gz").write_bytes(packed(text, range(0, len(text), 20_000)))
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b"location,weight\r\n7,8\r\n"))
    (tmp_path / "empty.gz").write_bytes(b"")
    files = blockgzip.files_in(spark, f"file://{tmp_path}")
    lines = blockgzip.read_block_gzip(files, range_bytes=100_000)
    assert sorted(r.value for r in lines.where("NOT first AND file LIKE '%a.csv.gz'").collect()) == sorted(rows)
    tasks = lines.where("file LIKE '%a.csv.gz'").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(tasks) > 4 and max(r["count"] for r in tasks) < 30_000
    assert [r.value for r in lines.where("first").orderBy("file").collect()] == ["location,weight"] * 2


def test_headers_are_held_against_the_schema(spark, scratch):
    frame = spark.createDataFrame([("1,2",), (None,), ("3,",), ("x,5",)], "value string").repartition(3)
    files = blockgzip.write_block_gzip(frame, scratch, header="location,weight")
    rows = blockgzip.read_block_gzip_csv(files, WEIGHTS, range_bytes=50).collect()
    assert sorted(map(str, map(tuple, rows))) == ["(1, 2)", "(3, None)", "(None, 5)"]
    wrong = blockgzip.write_block_gzip(frame, scratch + "-wrong", header="a,b")
    with pytest.raises(Exception, match="unexpected header"):
        blockgzip.read_block_gzip_csv(wrong, WEIGHTS).collect()
    sizes = {r.file.rpartition("/")[2]: r.bytes for r in files.collect()}
    assert sizes == {r.file.rpartition("/")[2]: r.bytes for r in blockgzip.files_in(spark, scratch).collect()}
