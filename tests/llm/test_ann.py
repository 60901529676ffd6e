"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from topicflow.llm.ann import nearest
from topicflow.llm.queries import op7_nearest_neighbours
from topicflow.session import ship_package


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def brute(ids, vectors, query, k):
    own = vectors[ids.index(query)]
    rows = []
    for i, v in zip(ids, vectors):
        if i != query:
            a, b = np.array(own, float), np.array(v, float)
            rows.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 12), i))
    return sorted(rows)[:k]


def test_query_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    ids, vectors = [r.vec_id for r in rows], [r.embedding for r in rows]
    got = {}
    for r in op7_nearest_neighbours(spark, "/root/testdata/sf0.01").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    assert sorted(got) == [i for i in ids if i % 50 == 0]
    hits = 0
    for q, found in got.items():
        want = brute(ids, vectors, q, 5)
        assert [r["rank"] for r in found] == [1, 2, 3, 4, 5]
        hits += len({r.vec_id for r in found} & {i for _, i in want})
    assert hits / (5 * len(got)) >= 0.95


def test_copies_shards_and_useless_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(500)]
    bad = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf")] + [0.0] * 5), (2005, []), (None, [1.0] * 6), (2006, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as shard")
    out = nearest(df, df.filter("vec_id % 50 = 7 or vec_id >= 2000"), k=5, shard=64).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-round(r.score, 12), r.vec_id))
    ids, vectors = [i for i, _ in rows], [v for _, v in rows]
    assert set(got) == {i for i in ids if i % 50 == 7}
    for q, found in got.items():
        assert found == brute(ids, vectors, q, 5)
    assert got[7] == [(-1.0, 1000 + k) for k in range(5)]


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    three = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])], schema)
    out = nearest(three, three.filter("vec_id = 1")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in out] == [(3, 1.0), (2, 0.0)]
