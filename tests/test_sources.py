"""Corpora without ids: positions from files."""

import pytest

from topicflow.operators import slicing as sl
from topicflow.sources.corpus import read_corpus


def in_order(df):
    return [r["text"] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def test_positions_of_many_parquet_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    want = []
    for name, n in (("b", 70), ("a", 50), ("c", 0), ("d", 1)):
        rows = [(f"{name}{i}" if i % 9 else None, i) for i in range(n)]
        df = spark.createDataFrame(rows, "text string, other long").coalesce(1)
        df.write.option("parquet.block.size", 1024).parquet(str(tmp_path / name))
        part = next((tmp_path / name).glob("part-*.parquet"))
        part.rename(folder / f"{name}.parquet")
    for name, n in (("a", 50), ("b", 70), ("d", 1)):
        want += [f"{name}{i}" if i % 9 else "" for i in range(n)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "600b"):  # a file in one split, and in many
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = read_corpus(spark, str(folder), id_col=None, keep=("other",))
            assert df.columns == ["doc_id", "text", "other"]
            assert sorted(r["doc_id"] for r in df.collect()) == list(range(121))
            assert in_order(df) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "RangePartitioning" not in plan
    # the number serves as an id
    sizes = {r["slice_id"]: r["n_docs"] for r in sl.slice_sizes(sl.slice_by_position(df, 4)).collect()}
    assert sizes == {0: 30, 1: 30, 2: 30, 3: 31}


@pytest.mark.parametrize("size", ["128m", "500b"])
def test_positions_of_text_lines(spark, tmp_path, size):
    lines = {f"f{k}.txt": [f"file {k} line {i} " + "x" * (i % 7) for i in range(60 - 25 * k)] for k in (2, 0, 1)}
    for name, own in lines.items():
        (tmp_path / name).write_text("\n".join(own) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        df = read_corpus(spark, str(tmp_path), "text", id_col=None)
        assert in_order(df) == [x for name in sorted(lines) for x in lines[name]]
        whole = read_corpus(spark, str(tmp_path), "text", id_col=None, wholetext=True)
        assert [t.count("\n") for t in in_order(whole)] == [60, 35, 10]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_columns_and_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert read_corpus(spark, str(tmp_path / "none"), id_col=None).count() == 0
    with pytest.raises(ValueError, match="not in"):
        read_corpus(spark, str(tmp_path / "none"), id_col="key")
    with pytest.raises(ValueError, match="position"):
        read_corpus(spark, str(tmp_path / "none"), id_col=None, keep=("doc_id",))
