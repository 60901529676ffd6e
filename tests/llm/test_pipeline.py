"""The pipeline's stages, each held against brute force on its own input."""

import os
import sys

import pytest

import corpus_pipeline
from topicflow.scratch import Scratch

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_dedup import brute_lines, brute_near, brute_words  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    scratch = Scratch(spark, "pipeline-test")
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(scratch.save(stage(spark, docs[-1], SF), name))
    yield docs
    scratch.drop()


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[1:-1])


def test_language_keeps_clean_documents(stages):
    assert set(rows(stages[1])) == set(rows(stages[0]))


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    want = brute_lines([(i, r.text) for i, r in before.items()])
    assert {i: r.text for i, r in after.items()} == {i: t for i, (n, gone, t) in want.items() if not gone or gone < n}
    assert all(r.n_chars == len(r.text) for r in after.values())


def test_near(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = brute_near([(i, r.text) for i, r in before.items()], 5)
    assert set(after) == {i for i, (_, root) in want.items() if root == i}
    assert all(after[i].text == before[i].text for i in after)


def test_substrings(stages):
    before, after = rows(stages[3]), rows(stages[4])
    want = brute_words([(i, r.text) for i, r in before.items()], 50)
    assert set(after) == {i for i, (n, gone, _) in want.items() if not gone or gone < n}
    for i, r in after.items():
        assert r.text == (want[i][2] if want[i][1] else before[i].text)


def test_packing(stages):
    out = stages[5].toPandas()
    assert set(out.doc_id) == set(rows(stages[4]))
    assert (out.groupby("sequence_id").length.sum() <= 4096).all()


def test_awkward_documents(spark):
    """Null, empty and long texts, null columns and repeated texts pass through every stage; so does an empty table."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text = "the cat sat on the mat and then it went away\n" * 3
    made = [(1, text, "en", None, None), (2, None, "de", "s", 5), (3, "", None, "s", 0), (4, "der Hund und die Katze " * 9000, "de", "s", 1), (5, text, "en", "s", 2), (6, "12 34", "en", "s", 3)]
    for given in (made, []):
        docs = spark.createDataFrame(given, schema)
        scratch = Scratch(spark, "awkward")
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.save(stage(spark, docs, SF), name)
        assert {r.doc_id for r in docs.collect()} == ({1, 4} if given else set())
