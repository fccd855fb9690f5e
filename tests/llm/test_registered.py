"""Every registered query of the subpackage, the pipeline, and the entry without them."""

import subprocess
import sys

import __spark_entry__ as entry
import pytest
from cases import DOCS, ROOT, SF
from check import open_oracle, oracle_bag, spark_bag, type_gaps

from helixframe.llm import catalog
import corpus_pipeline

NAMES = sorted(catalog.queries())


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert set(catalog.oracle_sql()) <= set(NAMES) and set(NAMES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = open_oracle(SF)
    df = catalog.queries()[name](spark, SF)
    assert not type_gaps(df, con, catalog.oracle_sql()[name])
    assert spark_bag(df) == oracle_bag(con, catalog.oracle_sql()[name])


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(len(r.ids) == r.n_tokens for r in rows)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in rows) == sorted((r.doc_id, r.ids_sha256) for r in again)


def test_pipeline_by_hand(spark, words):
    """Toxic texts, copies and near copies go; the others stay until the mix, which takes its share."""
    clean = [" ".join(words(i, 120)) for i in range(60)]
    toxic = [" ".join([*words(900 + i, 60), "scumbag", *words(700 + i, 30), "scumbag"]) for i in range(60)]
    near = clean[5].split(" ")
    near[60] = "changed"
    texts = [*clean, *toxic, clean[3].replace(" ", "\t\n"), " ".join(near)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(60 <= i < 120)) for i in range(len(texts))], "doc_id bigint, quality int, toxic int")
    from helixframe.llm import grace_dedup, minhash, mixing, toxicity

    left = toxicity.stage(docs, labels)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {*range(60), 120, 121}
    left = grace_dedup.stage(left)
    assert {r.doc_id for r in left.collect()} == {*range(60), 121}
    left = minhash.stage(left)
    assert {r.doc_id for r in left.collect()} == set(range(60))
    mixed = mixing.stage(left).collect()
    assert {r.doc_id for r in mixed} <= set(range(60)) and 55 <= len(mixed) <= 65


def test_entry_without_the_subpackage(tmp_path):
    """The rest works when the operators and the pipeline are gone."""
    for item in ("helixframe", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", ROOT / item, tmp_path], check=True)
    (tmp_path / "helixframe" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; assert e.queries() and not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
