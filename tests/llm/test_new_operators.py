"""Source divergence, whitening and chat formatting against plain loops."""

import hashlib
import re

import numpy as np
import pytest

from topicflow.llm.chat_format import format_chats, read_loss, read_turns
from topicflow.llm.divergence import DEEP, count_runs, pointer_sort, source_divergence, word_starts
from topicflow.llm.queries import op12_whitening, op13_chat_format
from topicflow.llm.whitening import whiten
from topicflow.session import ship_package
from pyspark.sql import functions as F

CHATS = "conv_id long, turn long, role string, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


# --- chat formatting ---------------------------------------------------------


def _read(chats):
    read = chats.select(
        "conv_id", "formatted", "loss",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    return {r.conv_id: r for r in read.collect()}


def test_chats_read_back(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant ok", "\\<|\\|<\\|", "<|im_sep|>", "", None, "a<", "|>\\", "x\U0001f600y", "\n", "<\\n>", "é" * 5000]
    roles = ["user", "assistant", "assistant", "assistant", "user", "user", None, "ro\nle", "ro<|im_start|>\\", "assistant", "assistant"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, nasty))]
    rows += [(2, None, "assistant", "first"), (2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    rows += [(None, 5, "assistant", "z" * 9000), (None, 600, "assistant", "y"), (None, 601, "user", "x")]
    rows += [(3, 1, None, None)]
    df = spark.createDataFrame(rows, CHATS).selectExpr("*", "1 AS chunk", "2 AS t", "3 AS conv", "4 AS formatted", "5 AS loss")
    for chunk in (256, 2):
        got = _read(format_chats(df, chunk=chunk))
        for conv in {r[0] for r in rows}:
            own = [(r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv]
            own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
            assert [(t.role, t.text) for t in got[conv].turns] == [r[1:] for r in own]
            assert got[conv].learned == [t for _, r, t in own if r == "assistant"]
    # neighbours of one role share a block
    assert got[2].formatted == "<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>user\na<|im_sep|>a<|im_sep|>b<|im_end|>\n"
    assert got[2].formatted[got[2].loss[0].start : got[2].loss[0].stop] == "first"


def test_chat_chunks_do_not_matter(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(3)), i, ["user", "assistant"][int(rng.integers(2))], "w" * int(rng.integers(4))) for i in range(900)]
    df = spark.createDataFrame(rows, CHATS)
    plain = {r.conv_id: tuple(r) for r in format_chats(df, chunk=10**6).collect()}
    assert {r.conv_id: tuple(r) for r in format_chats(df, chunk=7).collect()} == plain


def test_chats_of_nothing(spark):
    assert format_chats(spark.createDataFrame([], CHATS)).count() == 0


def test_chat_query_has_the_control_conversation_and_no_python(spark):
    out = op13_chat_format(spark, "/root/testdata/sf0.001")
    said = "<|im_end|><|im_start|>assistant ok"
    r = out.filter("conv_id = -1").first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


# --- whitening ---------------------------------------------------------------


def _whitened(vectors, k):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    used = min(k, int((e > 1e-12 * e.sum()).sum()))
    return n, ((n * x - s) ** 2).sum(axis=1), (n * x - s) / n @ v[:, :used] / np.sqrt(e[:used]), e[:used] / e.sum()


def _compare(out, ids, vectors, k=16):
    n, deviation, want, explained = _whitened(vectors, k)
    got = out.toPandas()
    assert set(got.n) == {n} and len(got) == want.size
    assert got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    for c, rows in got.groupby("component"):
        rows = rows.set_index("vec_id").loc[ids]
        assert rows.deviation.tolist() == deviation.tolist()
        assert abs(rows.explained / explained[c - 1] - 1).max() < 1e-9
        a, b = rows.whitened.to_numpy(), want[:, c - 1]
        assert np.abs(a * np.sign(a @ b) - b).max() < 1e-7


def test_whitening_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    _compare(op12_whitening(spark, "/root/testdata/sf0.001"), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_whitening_copies_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr("topicflow.llm.whitening.BLOCK_ROWS", 16)
    monkeypatch.setattr("topicflow.llm.whitening.BLOCK_COLS", 4)
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=10).tolist() for _ in range(120)]
    vectors += [vectors[5]] * 60
    rows = list(enumerate(vectors))
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 9), (903, [float("nan")] * 10), (904, [float("-inf")] * 10), (905, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(5).selectExpr("*", "1 AS idx", "2 AS x", "3 AS id")
    _compare(whiten(df, components=3), [i for i, _ in rows], vectors, 3)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    # the third entry never changes: two components have variance
    rows = [(1, [1.0, 2.0, 7.0]), (1, [3.0, 1.0, 7.0]), (None, [0.0, 5.0, 7.0]), (4, [2.0, 2.0, 7.0])]
    out = whiten(spark.createDataFrame(rows, schema)).toPandas()
    assert sorted(out.component) == [1] * 4 + [2] * 4


# --- source divergence -------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _divergence(docs, min_docs, top, scale=10**9):
    """Rows (lang, source, text) to the expected rows, by plain loops."""
    docs = [tuple(v or "" for v in d) for d in docs]
    out = []
    for lang in sorted({d[0] for d in docs}):
        own = [(s, _TERM.findall(t.translate(_LOWER))) for x, s, t in docs if x == lang]
        kept = {w for w in {w for _, ws in own for w in ws} if sum(w in ws for _, ws in own) >= min_docs}
        count = {s: {} for s, _ in own}
        for s, ws in own:
            for w in ws:
                if w in kept:
                    count[s][w] = count[s].get(w, 0) + 1
        whole = {w: sum(c.get(w, 0) for c in count.values()) for w in kept}

        def share(c):
            total = sum(c.values())
            return {w: 1 + scale * (c.get(w, 0) + 2) // (total + 2 * len(kept)) for w in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        for s in count:
            far = [(-sum((p[s][w] - p[o][w]) ** 2 // (p[s][w] + p[o][w]) for w in kept), o) for o in count if o != s]
            far.sort(key=lambda r: (r[0], r[1].encode()))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(far)]
            own_terms = [(-((p[s][w] - q[w]) ** 2 // (p[s][w] + q[w])), w) for w in count[s] if p[s][w] > q[w]]
            own_terms.sort(key=lambda r: (r[0], r[1].encode()))
            out += [(lang, s, "term", w, -v, k + 1) for k, (v, w) in enumerate(own_terms[:top])]
    return sorted(out)


def test_divergence_against_loops(spark):
    rng = np.random.default_rng(5)
    words = ["a", "B", "b", "ab", "éa", "ÉA", "日本語", "x" * 40, "x" * 41, "y" * 300, "y" * 300 + "z", "longerword", "longerwords", "K"]
    docs = []
    for i in range(160):
        text = " ".join(words[int(j)] for j in rng.zipf(1.4, size=int(rng.integers(0, 30))) % len(words))
        docs.append((["en", "fr", None][i % 3], [None, "s1", "s2", "s3", "s4"][int(rng.integers(5))], text + "1a-b\x7f" if i % 7 else None))
    docs += [docs[4]] * 40 + [("xx", "only", "rare words"), ("yy", "s1", "1 2 3"), ("yy", "s2", ""), ("yy", None, None)]
    df = spark.createDataFrame(docs, "lang string, source string, text string")
    df = df.selectExpr("*", "1 AS n", "2 AS term", "3 AS docs", "4 AS i", "5 AS block").repartition(5)
    for kwargs in ({}, {"sources": 2, "shard_cells": 5}):
        got = source_divergence(df, min_docs=4, top=3, **kwargs)
        assert sorted(tuple(r) for r in got.collect()) == _divergence(docs, 4, 3)
    assert source_divergence(df.limit(0)).count() == 0


def test_pointer_sort(monkeypatch):
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 100, int(rng.integers(1, 40))).astype(np.uint8)) for _ in range(3000)]
    words += [b"q" * (DEEP + k) for k in (0, 1, 8, 9, 50, 1)] * 3 + [b"12345678", b"123456789", b"12345678"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    order, fresh = pointer_sort(data, start, end)
    got = [words[i] for i in order]
    assert got == sorted(words)
    assert fresh.tolist() == [True] + [a != b for a, b in zip(got[1:], got)]


def test_words_end_at_text_borders():
    data = np.frombuffer("abcdé é".encode(), np.uint8)
    start, end, text = word_starts(data, np.array([0, 2, 2, 6, 9]))
    assert [(bytes(data[a:b]).decode(), int(t)) for a, b, t in zip(start, end, text)] == [("ab", 0), ("cdé", 2), ("é", 3)]
    word, group, n, docs, start, end = count_runs(data, np.array([0, 2, 2, 6, 9]), np.array([1, 0, 0, 0]))
    assert sorted((bytes(data[start[w] : end[w]]).decode(), int(g), int(a), int(b)) for w, g, a, b in zip(word, group, n, docs)) == [("ab", 1, 1, 1), ("cdé", 0, 1, 1), ("é", 0, 1, 1)]


def test_shares_beyond_64_bits():
    from topicflow.llm.divergence import _shares

    counts = np.array([0, 10**12])
    assert _shares(counts, 10**13, 5, 10**9).tolist() == [1 + 10**9 * (c + 2) // (10**13 + 10) for c in (0, 10**12)]
