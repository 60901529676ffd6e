"""Assignment and tracks."""

from itertools import permutations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_metrics import random_topics, topic_table

from topicflow.functions.assignment import assign, auction
from topicflow.operators import alignment as al


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_assignment_is_optimal(n):
    rng = np.random.default_rng(n)
    for trial in range(30):
        cost = rng.random((n, n)) if trial % 2 else rng.integers(0, 4, (n, n)).astype(float)
        got = assign(cost)
        assert sorted(got) == list(range(n))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert cost[np.arange(n), got].sum() == pytest.approx(best)


def test_assignment_of_larger_matrices_cannot_be_improved_by_swaps():
    cost = np.random.default_rng(1).random((60, 60))
    got = assign(cost)
    assert sorted(got) == list(range(60))
    now = cost[np.arange(60), got]
    for i in range(60):
        for j in range(i):
            assert now[i] + now[j] <= cost[i, got[j]] + cost[j, got[i]] + 1e-12


def test_rectangular_costs():
    assert assign(np.array([[3.0, 1.0, 2.0]])).tolist() == [1]
    with pytest.raises(ValueError):
        assign(np.ones((3, 2)))


@pytest.mark.parametrize("slices", [1, 2, 6])
def test_tracks_undo_planted_permutations(spark, slices):
    rng = np.random.default_rng(8)
    base = random_topics(rng, 4, 30)
    orders = [np.arange(4)] + [rng.permutation(4) for _ in range(slices - 1)]
    cubes = []
    for order in orders:
        noisy = base + rng.random(base.shape) * 1e-3
        cubes.append(noisy[order] / noisy[order].sum(1, keepdims=True))
    tw = topic_table(spark, cubes)
    cost = al.topic_cost(al.topic_cosine(tw))
    match = al.topic_assignment(cost)
    first = tw.filter("slice_id = 0").select("topic_id").distinct()
    tracks = al.topic_tracks(match, first)
    want = sorted((s, k, int(np.flatnonzero(o == k)[0])) for s, o in enumerate(orders) for k in range(4))
    assert rows(tracks) == want
    log = dict(rows(al.assignment_log(tracks)))
    assert log == {s: [int(np.flatnonzero(o == k)[0]) for k in range(4)] for s, o in enumerate(orders)}
    aligned = al.aligned_topic_word(tw, tracks)
    heads = aligned.groupBy("slice_id", "track_id").agg(F.max_by("term_id", "p").alias("t"))
    for s, k, t in rows(heads):
        assert t == cubes[0][k].argmax()


@pytest.mark.parametrize("ties", [False, True])
def test_auction_finds_the_total_of_the_solver(ties):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        cost = rng.integers(0, 5, (n, n)).astype(float) if ties else rng.random((n, n))
        chosen, price = auction(cost, np.tile(np.arange(n), (n, 1)), n, 1e-10)
        assert sorted(chosen) == list(range(n))
        at = np.arange(n)
        assert cost[at, chosen].sum() == pytest.approx(cost[at, assign(cost)].sum(), abs=1e-8)
        assert ((cost + price).min(axis=1) >= cost[at, chosen] + price[chosen] - 1e-9).all()


def _cost_table(spark, matrices):
    rows_ = [(s, int(i) + 3, int(j) + 10, float(v)) for s, c in enumerate(matrices) for (i, j), v in np.ndenumerate(c)]
    return spark.createDataFrame(rows_, "slice_id int, src_topic int, tgt_topic int, cost double")


def test_large_problems_equal_the_solver(spark, monkeypatch):
    monkeypatch.setattr(al, "DENSE_CELLS", 5000)
    rng = np.random.default_rng(8)
    crowded = rng.random((200, 200)) + np.arange(200)[None, :]  # all sources want the same few targets
    matrices = [rng.random((200, 200)), crowded, rng.random((5, 5))]
    got = {}
    for s, i, j in rows(al.topic_assignment(_cost_table(spark, matrices))):
        got.setdefault(s, {})[i - 3] = j - 10
    for s, c in enumerate(matrices):
        n = len(c)
        mine = np.array([got[s][i] for i in range(n)])
        assert sorted(mine) == list(range(n))
        assert c[np.arange(n), mine].sum() == pytest.approx(c[np.arange(n), assign(c)].sum(), rel=1e-8)


def test_large_problems_must_be_complete(spark, monkeypatch):
    monkeypatch.setattr(al, "DENSE_CELLS", 1)
    with pytest.raises(ValueError, match="every pair"):
        al.topic_assignment(_cost_table(spark, [np.ones((3, 4))]))
    flat = rows(al.topic_assignment(_cost_table(spark, [np.ones((6, 6))])))
    assert sorted(j for _, _, j in flat) == list(range(10, 16))
