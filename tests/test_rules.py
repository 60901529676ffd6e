"""Rules that hold whatever the size: ids, finite points, scratch tables, text that stays in place."""

import os

import pytest
from conftest import rows

from checks import queries
from topicflow.operators import clustering as cl
from topicflow.operators import lda
from topicflow.operators import slicing as sl
from topicflow.operators import vocabulary as vo
from topicflow.scratch import Scratch, broadcast_checked
from topicflow.sources.corpus import write_result_csv


@pytest.fixture(scope="module")
def repeated(spark):
    return spark.createDataFrame([(1, "cat dog"), (1, "dog dog"), (2, "bird"), (3, "cat")], "doc_id long, text string")


@pytest.mark.parametrize("terms", [4_000_000, 1])
def test_packing_keeps_rows_of_repeated_ids_apart(spark, repeated, terms, monkeypatch):
    monkeypatch.setattr(vo, "TABLE_TERMS", terms)
    packed = vo.pack_documents(repeated, vo.fit_vocabulary(repeated, 3))
    assert sorted((r["doc_id"], r["terms"], r["cnts"]) for r in packed.collect()) == [
        (1, [1, 2], [1.0, 1.0]), (1, [2], [2.0]), (2, [0], [1.0]), (3, [1], [1.0])
    ]


def test_counted_corpus_packs_like_text(repeated):
    counted = vo.count_documents(repeated)
    assert counted.columns == ["doc_id", "counted"]
    vocab = vo.fit_vocabulary(counted, 3)
    assert rows(vocab) == rows(vo.fit_vocabulary(repeated, 3))
    key = lambda df: sorted((r["doc_id"], r["terms"]) for r in df.collect())
    assert key(vo.pack_documents(counted, vocab)) == key(vo.pack_documents(repeated, vocab))


def test_repeated_or_missing_ids_are_refused(spark, repeated):
    with pytest.raises(ValueError, match="unique"):
        sl.slice_by_position(repeated, 2)
    with pytest.raises(ValueError, match="unique"):
        sl.slice_by_position(spark.createDataFrame([(1,), (None,)], "doc_id long"), 2)


@pytest.mark.parametrize("bound", [128 << 20, 0])
def test_fitting_refuses_repeated_documents(spark, repeated, bound, monkeypatch):
    monkeypatch.setattr(lda, "MODEL_BYTES", bound)
    packed = vo.pack_documents(repeated, vo.fit_vocabulary(repeated, 3)).selectExpr("0 as slice_id", "*")
    with pytest.raises(ValueError, match="unique"):
        lda.fit_lda(packed, 3, 2, 1)


@pytest.mark.parametrize("bad", [float("inf"), float("nan"), 1e200, None])
def test_points_must_be_finite(spark, bad):
    points = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, bad])], "id long, features array<double>")
    with pytest.raises(ValueError, match="features"):
        cl.agglomerate(points)


def test_points_must_be_few_and_distinct(spark, monkeypatch):
    with pytest.raises(ValueError, match="unique"):
        cl.agglomerate(spark.createDataFrame([(1, [0.0]), (1, [1.0])], "id long, features array<double>"))
    monkeypatch.setattr(cl, "MAX_POINTS", 1)
    with pytest.raises(ValueError, match="limited"):
        cl.agglomerate(spark.createDataFrame([(1, [0.0]), (2, [1.0])], "id long, features array<double>"))


def test_result_csv_never_replaces_a_folder(spark, tmp_path):
    with pytest.raises(Exception, match="exists"):
        write_result_csv(spark.range(1), str(tmp_path))


def test_scratch_forgets_and_drops(spark):
    scratch = Scratch(spark, "forget")
    one, two = scratch.save(spark.range(3), "one"), scratch.save(spark.range(4), "two")
    folder = scratch.path.removeprefix("file:")
    scratch.forget(one, spark.range(1))
    assert [x for x in os.listdir(folder) if not x.startswith(".")] == ["0002-two"] and two.count() == 4
    scratch.drop()
    assert not os.path.exists(folder)


@pytest.mark.parametrize("name", ["tokens", "tokens_nostop", "doc_term_counts", "strip_mail"])
def test_no_exchange_in_row_wise_text_queries(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_broadcast_is_bounded_in_rows_and_bytes(spark):
    wide = spark.range(100).selectExpr("id", "sequence(0, 200) as a", "repeat('x', 100) as s")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_checked(wide))
    assert not hinted(broadcast_checked(wide, max_rows=99))
    assert not hinted(broadcast_checked(wide, max_bytes=50_000))
    assert hinted(broadcast_checked(spark.range(0)))
