"""Special functions, the variational kernel, fitting, inference, perplexity, the pipeline."""

import math

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_metrics import packed_table

from checks import queries
from topicflow import Config, report, run
from topicflow.batches import split_scans
from topicflow.functions import special as sp
from topicflow.functions import variational as va
from topicflow.operators import lda
from topicflow.operators import vocabulary as vo
from topicflow.scratch import Scratch
from topicflow.streaming.scoring import score_documents

K = 3


def test_special_functions():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 7.0, 50.0, 1e5])
    assert sp.gammaln(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-12)
    step = 1e-5
    slope = [(math.lgamma(v * (1 + step)) - math.lgamma(v * (1 - step))) / (2 * v * step) for v in x[1:]]
    assert sp.digamma(x)[1:] == pytest.approx(slope, rel=1e-6, abs=1e-6)
    assert sp.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, abs=1e-12)


def test_exp_digamma_is_the_exponential():
    x = np.concatenate([[1e-2, 0.1, 1.0], np.geomspace(1e-2, 1e6, 500)])
    assert sp.exp_digamma(x) == pytest.approx(np.exp(sp.digamma(x)), rel=1e-11)


def test_distinct_cells_by_table_and_by_sorting():
    for cell in (np.array([7, 3, 7, 0, 3]), np.array([900, 3, 900]), np.zeros(0, dtype=np.int64)):
        cells, at = lda._distinct(cell)
        assert cells.tolist() == sorted(set(cell.tolist()))
        assert cells[at].tolist() == cell.tolist()


def test_passes_have_a_task_for_every_core(spark, packed, model, tmp_path):
    # few bytes but much work: neither adaptive partitions nor joined file splits may leave cores idle
    tasks = lda.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    scratch = Scratch(spark, "tasks")
    lda.fit_lda(packed, model.n_terms, K, max_iter=1, seed=0, scratch=scratch)
    files = spark.read.parquet(f"{scratch.path}/*-by-slice")
    assert len(files.inputFiles()) > tasks // 2
    with split_scans(spark, tasks):
        assert files.select("terms").rdd.getNumPartitions() > tasks // 2
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None
    assert lda.infer_topics(packed, model).rdd.getNumPartitions() == tasks


def test_gamma_sampler_depends_on_keys_only():
    keys = sp.hash_keys(1, np.arange(4000))
    draws = sp.gamma_sample(keys, 5, 100.0, 0.01)
    assert draws.mean() == pytest.approx(1.0, abs=0.005)
    assert draws.std() == pytest.approx(0.1, abs=0.005)
    assert np.array_equal(draws[7:9], sp.gamma_sample(keys[7:9], 5, 100.0, 0.01))


def plain_gamma(ids, n, beta, gamma, alpha):
    """One document at a time, as the update is written in the literature."""
    for _ in range(va.MAX_DOC_ITER):
        theta = np.exp(sp.dirichlet_log_mean(gamma))
        phi = theta @ beta[ids].T + va.EPS
        new = alpha + theta * ((n / phi) @ beta[ids])
        change = np.abs(new - gamma).mean()
        gamma = new
        if change < va.MEAN_CHANGE_TOL:
            break
    return gamma


def corpus_matrix(seed=0, docs=60, terms=25):
    rng = np.random.default_rng(seed)
    topics = rng.dirichlet(np.full(terms, 0.2), size=K)
    m = np.array([rng.multinomial(rng.integers(1, 60), rng.dirichlet(np.full(K, 0.3)) @ topics) for _ in range(docs)])
    m[3] = 0
    return m


def test_block_update_equals_single_documents():
    m = corpus_matrix()
    beta = np.random.default_rng(1).dirichlet(np.full(25, 0.5), size=K).T.copy()
    ids = [np.flatnonzero(r) for r in m]
    offsets = np.r_[0, np.cumsum([len(i) for i in ids])]
    terms, cnts = np.concatenate(ids), np.concatenate([r[i] for r, i in zip(m, ids)]).astype(float)
    start = np.random.default_rng(2).gamma(100, 0.01, (len(m), K))
    got = va.infer_gamma(offsets, cnts, lambda e: beta[terms[e]], start, 1 / K)
    for d, i in enumerate(ids):
        assert got[d] == pytest.approx(plain_gamma(i, m[d][i], beta, start[d], 1 / K), rel=1e-9)


def lam_cube(model):
    cube = np.zeros((model.n_slices, model.n_topics, model.n_terms))
    for s, k, v, lam in rows(model.long()):
        cube[s, k, v] = lam
    return cube


@pytest.fixture(scope="module")
def packed(spark):
    return packed_table(spark, [corpus_matrix(0), corpus_matrix(1, docs=45)]).cache()


@pytest.fixture(scope="module")
def model(packed):
    return lda.fit_lda(packed, 25, K, 6)


def test_fit_keeps_token_mass_and_ignores_partitioning(packed, model):
    lam = lam_cube(model)
    tokens = [corpus_matrix(0).sum(), corpus_matrix(1, docs=45).sum()]
    assert (lam - 1 / K).sum(axis=(1, 2)) == pytest.approx(tokens)
    other = lam_cube(lda.fit_lda(packed.repartition(3), 25, K, 6))
    assert other == pytest.approx(lam, rel=1e-9)
    assert lam_cube(lda.fit_lda(packed, 25, K, 6, seed=1)) != pytest.approx(lam, rel=1e-3)


def test_fit_equals_a_plain_loop(packed, model):
    """The same starts and updates, one document at a time."""
    want = np.zeros((2, K, 25))
    doc = 0
    for s, m in enumerate((corpus_matrix(0), corpus_matrix(1, docs=45))):
        lam = lda._initial(0, np.arange(25), K).T
        for it in range(6):
            beta = np.exp(sp.dirichlet_log_mean(lam)).T.copy()
            stats = np.zeros_like(lam)
            for d, r in enumerate(m):
                i = np.flatnonzero(r)
                start = sp.gamma_sample(sp.hash_keys(0, it, s, doc + d), K, 100.0, 0.01)[0]
                theta = np.exp(sp.dirichlet_log_mean(plain_gamma(i, r[i], beta, start, 1 / K)))
                stats[:, i] += theta[:, None] * (r[i] / (beta[i] @ theta + va.EPS))[None, :]
            lam = 1 / K + stats * beta.T
        doc += len(m)
        want[s] = lam
    assert lam_cube(model) == pytest.approx(want, rel=1e-8)


def test_joined_model_equals_broadcast(packed, model, monkeypatch):
    ppl = dict(rows(lda.perplexity(packed, model)))
    topics = rows(lda.doc_topic(packed, model))
    monkeypatch.setattr(lda, "MODEL_BYTES", 0)
    joined = lda.fit_lda(packed, 25, K, 6)
    assert lam_cube(joined) == pytest.approx(lam_cube(model), rel=1e-8)
    # three blocks of 20 (slice, term) rows; the second holds rows of both slices
    monkeypatch.setattr(lda, "MODEL_BYTES", 8 * K * 20)
    plan = lda.infer_topics(packed, joined)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 4 and "Exchange" not in plan and "Join" not in plan
    assert dict(rows(lda.perplexity(packed, joined))) == pytest.approx(ppl)
    again = rows(lda.doc_topic(packed, joined))
    assert [r[:3] for r in again] == [r[:3] for r in topics]
    assert [r[3] for r in again] == pytest.approx([r[3] for r in topics])


def test_slice_groups_equal_one_fit(spark, monkeypatch):
    parts = [corpus_matrix(s, docs=20 + 7 * s) for s in range(5)]
    packed = packed_table(spark, parts).cache()
    whole = lam_cube(lda.fit_lda(packed, 25, K, 4))
    monkeypatch.setattr(lda, "_fit_joined", None)  # entries are never joined while a slice fits
    for slices in (2, 1):
        monkeypatch.setattr(lda, "MODEL_BYTES", slices * 8 * 25 * K)
        assert lam_cube(lda.fit_lda(packed, 25, K, 4)) == pytest.approx(whole, rel=1e-8)


def test_fit_goes_on_from_a_model(packed, monkeypatch):
    first = lda.fit_lda(packed, 25, K, 3)
    ahead = lam_cube(lda.fit_lda(packed, 25, K, 2, seed=None, start=first))
    # from ones nothing is random: two passes at once equal one after the other, in every way of fitting
    step = lda.fit_lda(packed, 25, K, 1, seed=None, start=first)
    assert lam_cube(lda.fit_lda(packed, 25, K, 1, seed=None, start=step)) == pytest.approx(ahead, rel=1e-8)
    for limit in (8 * 25 * K, 0):
        monkeypatch.setattr(lda, "MODEL_BYTES", limit)
        assert lam_cube(lda.fit_lda(packed, 25, K, 2, seed=None, start=first)) == pytest.approx(ahead, rel=1e-8)
    with pytest.raises(ValueError, match="start model"):
        lda.fit_lda(packed, 25, K, 2, seed=None)
    with pytest.raises(ValueError, match="other slices"):
        lda.fit_lda(packed, 24, K, 2, start=first)


def test_topics_in_blocks_wider_than_one_row(spark, packed):
    model = lda.fit_lda(packed, 25, 20, 2)
    assert (lam_cube(model) - 1 / 20).sum() == pytest.approx(corpus_matrix(0).sum() + corpus_matrix(1, docs=45).sum())


def test_doc_topic_rows_sum_to_one_and_empty_is_uniform(packed, model):
    shares = {}
    for s, d, k, p in rows(lda.doc_topic(packed, model)):
        shares.setdefault(d, []).append(p)
    assert len(shares) == 105
    assert [sum(v) for v in shares.values()] == pytest.approx([1.0] * 105)
    assert shares[3] == pytest.approx([1 / K] * K)


def test_perplexity_equals_the_written_bound(packed, model):
    lam = lam_cube(model)
    got = dict(rows(lda.perplexity(packed, model)))
    for s, m in enumerate((corpus_matrix(0), corpus_matrix(1, docs=45))):
        elog = sp.dirichlet_log_mean(lam[s])
        bound = va.dirichlet_bound(1 / K, lam[s], elog).sum()
        for r in m:
            i = np.flatnonzero(r)
            g = plain_gamma(i, r[i], np.exp(elog).T, np.ones(K), 1 / K)
            log_theta = sp.dirichlet_log_mean(g)
            words = np.log(np.exp(log_theta[:, None] + elog[:, i]).sum(axis=0))
            bound += (r[i] * words).sum() + va.dirichlet_bound(1 / K, g[None], log_theta[None])[0]
        assert got[s] == pytest.approx(np.exp(-bound / m.sum()), rel=1e-8)


def test_perplexity_falls_with_iterations(packed, model):
    early = dict(rows(lda.perplexity(packed, lda.fit_lda(packed, 25, K, 1))))
    late = dict(rows(lda.perplexity(packed, model)))
    assert all(late[s] < early[s] for s in early)


def test_bad_arguments(spark, packed):
    with pytest.raises(ValueError):
        lda.fit_lda(packed, 25, 0, 1)
    with pytest.raises(ValueError, match="known term"):
        lda.fit_lda(packed.filter("doc_id = 3"), 25, 2, 1)


def word_corpus(spark, docs=300, seed=42, vocab=100, words=100):
    rng = np.random.default_rng(seed)
    data = []
    for d in range(docs):
        counts = rng.multinomial(words, rng.dirichlet(np.ones(vocab)))
        data.append((d, " ".join(f"w{i}" for i in np.repeat(np.arange(vocab), counts))))
    return spark.createDataFrame(data, "doc_id long, text string")


def test_pipeline_reaches_the_published_band(spark, tmp_path):
    """1000 documents of 100 words over 100 terms, 3 slices, 5 topics, 5 iterations."""
    corpus = word_corpus(spark, 1000).repartition(8)
    out = run(spark, corpus, Config(3, 5, 100, 5, stop_words=()), str(tmp_path / "csv"))
    row = out.result.first()
    assert (row["n_slices"], row["n_topics"], row["max_features"]) == (3, 5, 100)
    assert abs(row["avg_coherence"]) < 0.02
    assert row["avg_diversity"] == pytest.approx(0.9533, abs=0.03)
    assert row["evolution_smoothness"] == pytest.approx(0.7755, abs=0.02)
    assert row["avg_alignment"] == pytest.approx(0.8789, abs=0.02)
    assert row["avg_perplexity"] == pytest.approx(106.25, abs=0.5)
    header = "n_slices,n_topics,max_features,avg_coherence,avg_diversity,evolution_smoothness,avg_alignment,avg_perplexity"
    lines = spark.read.text(str(tmp_path / "csv")).collect()
    assert [r[0] for r in lines][0] == header and len(lines) == 2
    text = dict(rows(report(out.result)))
    assert text["Average Perplexity (PPL)"] == f"{row['avg_perplexity']:.2f}"
    assert out.tracks.count() == 15
    out.close()


def test_pipeline_with_one_slice(spark):
    row = run(spark, word_corpus(spark, 30), Config(1, 2, 50, 2, stop_words=())).result.first()
    assert row["evolution_smoothness"] == 0.0 and row["avg_alignment"] is None


def test_pipeline_sliced_by_time(spark):
    corpus = word_corpus(spark, 90).withColumn("day", F.expr("timestamp'2024-01-01' + make_dt_interval(doc_id div 30 * 40)"))
    out = run(spark, corpus, Config(n_topics=2, max_features=50, max_iter=2, stop_words=(), time_col="day", time_width="10 days"))
    row = out.result.first()
    assert row["n_slices"] == 3 and row["avg_perplexity"] > 0 and row["avg_alignment"] is not None
    sizes = {r["slice_id"]: r["count"] for r in out.packed.groupBy("slice_id").count().collect()}
    assert sizes == {0: 30, 1: 30, 2: 30}


def test_pipeline_rejects_bad_settings(spark):
    corpus = word_corpus(spark, 5)
    with pytest.raises(ValueError, match="at least 1"):
        run(spark, corpus, Config(n_slices=0))
    with pytest.raises(ValueError, match="cannot fill"):
        run(spark, corpus, Config(n_slices=6, stop_words=()))
    with pytest.raises(ValueError, match="exceeds the vocabulary"):
        run(spark, corpus, Config(2, 2, 5, 1, top_n=10, stop_words=()))


def test_library_estimator(spark):
    corpus = word_corpus(spark, 40, vocab=20).withColumn("slice_id", F.lit(0))
    vocab = vo.fit_vocabulary(corpus, 20, ()).cache()
    topics = lda.fit_lda_mllib(corpus, vocab, 3, 2)
    got = rows(topics.groupBy("topic_id").agg(F.round(F.sum("p"), 9), F.count_distinct("term_id")))
    assert got == [(k, 1.0, 20) for k in range(3)]


def test_library_query_runs_the_default_experiment(spark, tmp_path, monkeypatch):
    # 750 different words: more than a smaller vocabulary would keep
    data = [(i, " ".join(f"word{25 * i + j}" for j in range(25))) for i in range(30)]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    met = []
    monkeypatch.setattr(lda, "fit_lda_mllib", lambda *given: met.append(given))
    queries.lda_fit_ml(spark, str(tmp_path))
    ((sliced, vocab, *rest),) = met
    cfg = Config()
    assert vocab.count() == 750
    assert sliced.select("slice_id").distinct().count() == cfg.n_slices
    assert rest == [cfg.n_topics, cfg.max_iter, cfg.random_state] == [10, 50, 0]


def test_string_document_ids(spark):
    corpus = word_corpus(spark, 60).withColumn("doc_id", F.concat(F.lit("d"), F.lpad("doc_id", 4, "0")))
    out = run(spark, corpus, Config(2, 2, 50, 2, stop_words=()))
    assert out.result.first()["avg_perplexity"] > 0
    shares = lda.doc_topic(out.packed, out.model)
    assert shares.select("doc_id").distinct().count() == 60


def test_scoring_a_stream_equals_batch(spark, packed, model, tmp_path, monkeypatch):
    corpus = word_corpus(spark, 40, vocab=25).withColumn("slice_id", F.lit(0))
    vocab = vo.fit_vocabulary(corpus, 25, ()).cache()
    corpus.write.parquet(str(tmp_path / "in"))
    want = rows(score_documents(corpus, vocab, model))
    # a model beyond the bound, in three blocks
    monkeypatch.setattr(lda, "MODEL_BYTES", 8 * K * 20)
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in"))
    query = (
        score_documents(stream, vocab, model)
        .writeStream.format("memory")
        .queryName("scored")
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = rows(spark.table("scored"))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == [pytest.approx(r[2]) for r in want]
