"""Coherence, diversity, drift and alignment against plain NumPy."""

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from topicflow.operators import alignment as al
from topicflow.operators import metrics as me
from topicflow.operators import topics as tp


def topic_table(spark, cubes):
    """Arrays (K x V) per slice as a topic-word table; zero cells are left out."""
    data = [
        (s, k, v, float(m[k, v]))
        for s, m in enumerate(cubes)
        for k in range(m.shape[0])
        for v in range(m.shape[1])
        if m[k, v] > 0
    ]
    return spark.createDataFrame(data, "slice_id int, topic_id int, term_id int, p double")


def packed_table(spark, matrices):
    data, doc = [], 0
    for s, m in enumerate(matrices):
        for r in m:
            nz = np.flatnonzero(r).tolist()
            data.append((doc, s, nz, [float(r[i]) for i in nz]))
            doc += 1
    return spark.createDataFrame(data, "doc_id long, slice_id int, terms array<int>, cnts array<double>")


def random_topics(rng, k, v):
    return rng.dirichlet(np.full(v, 0.3), size=k)


def np_npmi(m):
    x = (m > 0).astype(float)
    n = len(x)
    df = x.sum(0) + 1e-12
    co = x.T @ x
    p, pij = df / n, co / n
    ratio = np.divide(pij, p[:, None] * p[None, :])
    with np.errstate(all="ignore"):
        out = np.log(np.where(pij > 0, ratio, 1.0)) / -np.log(pij + 1e-12)
    return np.nan_to_num(out, nan=0.0)


def np_coherence(topic, m, n):
    score = np_npmi(m)
    out = []
    for row in topic:
        top = sorted(range(len(row)), key=lambda v: (row[v], v))[-n:]
        pairs = [score[a, b] for i, a in enumerate(top) for b in top[i + 1 :]]
        if pairs:
            out.append(np.mean(pairs))
    return float(np.mean(out)) if out else 0.0


def np_js(p, q):
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: np.sum(np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / m), 0.0))
    return np.sqrt(max((part(p) + part(q)) / 2 / np.log(2), 0.0))


def coherence(spark, cubes, matrices, n):
    packed = packed_table(spark, matrices)
    sizes = packed.groupBy("slice_id").agg(F.count("*").alias("n_docs"))
    top = tp.top_words(topic_table(spark, cubes), n)
    scores = me.npmi(top, me.top_word_patterns(packed, top), sizes)
    return [c for _, c in rows(me.topic_coherence(scores, sizes))]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    cubes = [random_topics(rng, 3, 12) + 1e-6 for _ in range(3)]
    matrices = [rng.poisson(0.6, size=(40 + 5 * s, 12)) for s in range(3)]
    matrices[1][0] = 0  # a document without any term still counts
    return cubes, matrices


def test_coherence(spark, sample):
    cubes, matrices = sample
    want = [np_coherence(c, m, 4) for c, m in zip(cubes, matrices)]
    assert coherence(spark, cubes, matrices, 4) == pytest.approx(want, abs=1e-9)


def test_single_top_word_gives_zero_coherence(spark, sample):
    cubes, matrices = sample
    assert coherence(spark, cubes, matrices, 1) == [0.0, 0.0, 0.0]


def test_pair_that_never_meets_scores_zero(spark):
    m = np.array([[1, 0], [0, 1], [1, 0]])
    assert coherence(spark, [np.array([[0.6, 0.4]])], [m], 2) == [0.0]


def test_pair_in_every_document_keeps_the_epsilon_ratio(spark):
    got = coherence(spark, [np.array([[0.6, 0.4]])], [np.ones((50, 2))], 2)
    assert got[0] == pytest.approx(0.04, abs=1e-3)


def test_doc_freq(spark, sample):
    _, matrices = sample
    got = {(s, t): n for s, t, n in rows(me.doc_freq(packed_table(spark, matrices)))}
    for s, m in enumerate(matrices):
        for t, n in enumerate((m > 0).sum(0)):
            assert got.get((s, t), 0) == n


def test_top_words_break_ties_by_larger_id(spark):
    top = tp.top_words(topic_table(spark, [np.array([[0.25, 0.25, 0.25, 0.25]])]), 2)
    assert [(r["rank"], r["term_id"]) for r in top.orderBy("rank").collect()] == [(1, 3), (2, 2)]
    with pytest.raises(ValueError):
        tp.top_words(top, 0)
    with pytest.raises(ValueError, match="exceeds"):
        tp.check_top_n(top, 3)


def test_diversity(spark, sample):
    cubes, _ = sample
    got = [d for _, d in rows(me.topic_diversity(tp.top_words(topic_table(spark, cubes), 4)))]
    for c, d in zip(cubes, got):
        words = {v for row in c for v in np.argsort(row)[-4:]}
        assert d == pytest.approx(len(words) / 12)


def test_drift_and_smoothness(spark):
    rng = np.random.default_rng(5)
    cubes = [random_topics(rng, 3, 9) for _ in range(3)]
    for c in cubes:
        c[rng.random(c.shape) < 0.3] = 0
    aligned = topic_table(spark, cubes).withColumnRenamed("topic_id", "track_id")
    drift = me.topic_drift(aligned)
    want = {(t, k): np_js(cubes[t][k], cubes[t + 1][k]) for t in range(2) for k in range(3)}
    got = {(r["slice_id"], r["track_id"]): r["js_distance"] for r in drift.collect()}
    assert got == pytest.approx(want, abs=1e-12)
    es = me.evolution_smoothness(drift).first()[0]
    assert es == pytest.approx(1 - np.mean(list(want.values())))


def test_identical_slices_and_single_slice(spark):
    rng = np.random.default_rng(6)
    c = random_topics(rng, 3, 8)
    same = topic_table(spark, [c, c])
    drift = me.topic_drift(same.withColumnRenamed("topic_id", "track_id"))
    assert me.evolution_smoothness(drift).first()[0] == pytest.approx(1.0, abs=1e-6)
    assert rows(me.topic_alignment(al.topic_cosine(same)))[0][1] == pytest.approx(1.0)
    one = topic_table(spark, [c])
    drift = me.topic_drift(one.withColumnRenamed("topic_id", "track_id"))
    assert me.evolution_smoothness(drift).first()[0] == 0.0
    assert me.topic_alignment(al.topic_cosine(one)).count() == 0


def test_cosine_completes_pairs_without_common_terms(spark):
    a, b = np.array([[1.0, 0, 0], [0, 0.5, 0.5]]), np.array([[0, 1.0, 0], [0.2, 0.8, 0]])
    got = {(r["src_topic"], r["tgt_topic"]): r["similarity"] for r in al.topic_cosine(topic_table(spark, [a, b])).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = unit(a) @ unit(b).T
    assert got == pytest.approx({(i, j): want[i, j] for i in range(2) for j in range(2)})


def test_metrics_do_not_depend_on_topic_order(spark, sample):
    cubes, matrices = sample
    shuffled = [c[[2, 0, 1]] if s == 1 else c for s, c in enumerate(cubes)]
    assert coherence(spark, cubes, matrices, 4) == pytest.approx(coherence(spark, shuffled, matrices, 4))
    best = [
        [x for _, x in rows(me.topic_alignment(al.topic_cosine(topic_table(spark, c))))] for c in (cubes, shuffled)
    ]
    assert best[0] == pytest.approx(best[1])
