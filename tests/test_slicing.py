"""Positions and slices."""

from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicflow.operators import slicing as sl


def sizes(df):
    return [n for _, n in rows(sl.slice_sizes(df))]


@pytest.mark.parametrize("n,s", [(1000, 7), (10, 3), (5, 5), (9, 1), (101, 4), (300, 80)])
def test_last_slice_takes_the_remainder(spark, n, s):
    df = spark.range(n).withColumnRenamed("id", "doc_id").orderBy(F.rand(1))
    sliced = sl.slice_by_position(df, s)
    assert sizes(sliced) == [n // s] * (s - 1) + [n - (s - 1) * (n // s)]
    for doc, part in rows(sliced.select("doc_id", "slice_id")):
        assert part == min(doc // (n // s), s - 1)


def test_slices_by_a_tied_order_column(spark):
    # a third of all rows share one timestamp; the id breaks the tie
    df = spark.range(90).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 30, 5).otherwise(F.col("id") % 7).alias("ts")
    )
    sliced = sl.slice_by_position(df, 4, ["ts"])
    order = sorted(((r["ts"], r["doc_id"], r["slice_id"]) for r in sliced.collect()))
    assert [s for _, _, s in order] == [min(i // 22, 3) for i in range(90)]


def test_slicing_leaves_the_text_in_place(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    plan = sl.slice_by_position(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_bad_slice_counts(spark):
    df = spark.range(3).withColumnRenamed("id", "doc_id")
    with pytest.raises(ValueError, match="at least 1"):
        sl.slice_by_position(df, 0)
    with pytest.raises(ValueError, match="cannot fill"):
        sl.slice_by_position(df, 4)
    with pytest.raises(ValueError, match="cannot fill"):
        sl.slice_by_position(df.filter("doc_id < 0"), 1)


def test_positions_are_global_and_dense(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 5003).alias("k")).repartition(5)
    got = rows(sl.with_position(df, ["k"]))
    assert [p for _, p in got] == list(range(500))


def test_rows_at(spark):
    df = spark.range(200).select((199 - F.col("id")).alias("k"))
    total, found = sl.rows_at(df, ["k"], positions=[0, 77, 199])
    assert total == 200 and [r["k"] for r in found] == [0, 77, 199]
    with pytest.raises(ValueError):
        sl.rows_at(df, ["k"], positions=[200])


def test_time_slices_skip_empty_windows(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (3, "2024-01-01 05:00:00")],
        "doc_id long, t string",
    ).select("doc_id", F.to_timestamp("t").alias("ts"))
    got = rows(sl.slice_by_time(df, "ts", "1 hour").select("doc_id", "slice_id"))
    assert got == [(1, 0), (2, 0), (3, 1)]


def test_slices_by_time(spark):
    rows_ = [(i, f"2024-01-{1 + (i * 7) % 28:02d} 12:00:00") for i in range(40)]
    df = spark.createDataFrame(rows_, "doc_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["doc_id"]: r["slice_id"] for r in sl.slice_by_time(df, "ts", "5 days").collect()}
    day = {i: datetime.fromisoformat(t).timestamp() // (5 * 86400) for i, t in rows_}
    names = sorted(set(day.values()))
    assert got == {i: names.index(d) for i, d in day.items()}
    assert {r["slice_id"] for r in sl.slice_by_time(df.filter("doc_id < 3"), "ts", "1 day").collect()} == {0, 1, 2}
    missing = df.unionByName(spark.createDataFrame([(99, None)], df.schema))
    with pytest.raises(ValueError, match="no slice"):
        sl.slice_by_time(missing, "ts", "5 days")
