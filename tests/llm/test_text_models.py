"""Codec, packing, language ID and toxicity: libraries, brute force and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topicflow.llm import toxicity
from topicflow.llm.language_id import UNKNOWN, codewords, fit_languages, predict_languages
from topicflow.llm.packing import Capacity, encode_words, pack, plan
from topicflow.llm.queries import op1_sentencepiece, op5_best_fit_packing, op8_toxicity, op10_language_id
from topicflow.llm.sentencepiece_codec import Codec, decode_ids, encode_texts, id_digest, round_trip_digest
from topicflow.session import ship_package

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def texts():
    rnd = random.Random(1)
    odd = ["", " ", "  a  b ", "a" * 900, "日本語のテキスト、長い文章です。" * 30, "héllo\tworld\n\n▁x", "🙂🙂 ok", "https://example.com/a/b?c=d&e=f" * 20]
    return odd + ["".join(rnd.choice("abcdefgh .,-_/:;012345é\n") for _ in range(n)) for n in (5, 50, 5000)]


def test_codec_equals_the_library():
    codec = Codec(PIECES)
    for text in texts():
        ids = codec.encode(text)
        assert ids.tolist() == codec.library.encode(text)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_codec_streams_in_a_bounded_window(monkeypatch):
    """A text without any white space is committed piece by piece long before its end."""
    codec = Codec(PIECES)
    taken = []
    source = "".join(random.Random(4).choice("etaoinsh") for _ in range(20000))
    stream = codec.pieces(source)
    for _ in range(10):
        taken.append(next(stream))
    assert stream.gi_frame.f_locals["now"] < 200 and len(stream.gi_frame.f_locals["last"]) < 100
    assert "".join(taken) + "".join(stream) == source


def test_unigram_paths_have_the_best_score():
    codec = Codec(PIECES)
    codec.kind = 1
    rnd = random.Random(2)
    for _ in range(60):
        text = "".join(rnd.choice("▁ethansi\x01") for _ in range(rnd.randrange(1, 90)))
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - codec.longest), end):
                worth = codec.score.get(text[start:end], codec.unknown_score if end - start == 1 else None)
                if worth is not None:
                    best[end] = max(best[end], best[start] + worth)
        got = list(codec.pieces(text))
        assert "".join(got) == text
        assert np.isclose(sum(codec.score.get(p, codec.unknown_score) for p in got), best[-1])


def test_codec_on_tables(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece")
    back = decode_ids(encode_texts(df, PIECES), PIECES).collect()
    lib = Codec(PIECES).library
    for r in back:
        if r.text is None:
            assert r.ids is None and r.decoded is None
        else:
            assert r.ids == lib.encode(r.text) and r.decoded == lib.decode(r.ids)
    assert encode_texts(df.limit(0), PIECES).count() == 0
    with pytest.raises(ValueError):
        encode_texts(df.selectExpr("*", "1 as ids"), PIECES)
    assert op1_sentencepiece(spark, SF).filter("n_ids > 0").count() == 200


def test_words_encoded_once_equal_the_plain_call():
    """Every ASCII mark beside letters and digits, contractions, capitals with accents, special tokens in any case."""
    path = public_tokenizers.path("word_bpe_49k.json")
    marks = [chr(c) for c in range(33, 127)] + ["\u2026", "\u201d", "\u0301", "\u0307", "\u00e9", "\u00c9", "\u0130", "\u2126"]
    texts = [f"{a}{m}{b}{e}" for m in marks for a in ("Ab", "I", "7", "it's", "\u00d1", "") for b in ("", "S", "'ll", m) for e in ("", ".", ",;", "'s!", "?:")]
    texts += ["x <|ENDOFTEXT|> Y", "a<|endoftext|>. B", "<|startoftext|>Hi!", "It'S, it's. IT'LL?", "''..", "...", "e.g., U.S.A.", "a\u00a0B, c\u2003D."]
    plain = Tokenizer.from_file(path)
    for part in ([" ".join(texts)], texts, list(reversed(texts))):
        got = encode_words(path, [t.encode() for t in part])
        assert [g.tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in part]


def filled(made):
    """Sequences of a plan as lists of (offset, length)."""
    out = {}
    for length, _, n, first, offset in made:
        for s in range(first, first + n):
            out.setdefault(s, []).append((offset, length))
    return {s: sorted(v) for s, v in out.items()}


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_plan_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 65, 3000)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    for capacity in (Capacity(64, 64, 64 * 64), Capacity(64, 3, 64 * 64), Capacity(64, 64, 4096), Capacity(100, 5, 5000)):
        made = plan(counts, capacity, rule)
        ranks = {}
        for length, rank, n, _, _ in made:
            ranks.setdefault(length, []).extend(range(rank, rank + n))
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for inside in filled(made).values():
            at = 0
            for offset, length in inside:
                assert offset == at
                at += length
            assert at <= capacity.tokens and len(inside) <= capacity.documents
            assert sum(x * x for _, x in inside) <= capacity.attention
        if capacity == Capacity(64, 64, 64 * 64):
            assert len(filled(made)) <= 1.01 * -(-int(lengths.sum()) // 64) + 1
    with pytest.raises(ValueError):
        plan({10: 1}, Capacity(9))
    assert plan({}, Capacity()) == []


def best_by_full_search(counts, capacity, rule, weights):
    """Piece by piece, longest first: the sequence of the best score of all, of equal ones the fullest."""
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    used, out = [], []
    for length in sorted(counts, reverse=True):
        need = capacity.needs(length)
        for _ in range(counts[length]):
            best = None
            for k, state in enumerate(used):
                after = [u + x for u, x in zip(state, (length, 1, length * length))]
                if any(x > limit for x, limit in zip(after, limits)):
                    continue
                left = [1 - x / limit for x, limit in zip(after, limits)]
                score = sum(w * (n * x if rule == "dot" else x * x) for w, n, x in zip(weights, need, left))
                if best is None or score < best[0] - 1e-12:
                    best = score, k, after
            if best is None:
                used.append([length, 1, length * length])
                out.append(0.0)
            else:
                used[best[1]] = best[2]
                out.append(best[0])
    return len(used), out


@pytest.mark.parametrize("rule", ["dot", "norm"])
@pytest.mark.parametrize("capacity", [Capacity(60, 3, 2600), Capacity(60, 60, 1400), Capacity(60, 4, 3600)])
def test_plan_takes_the_best_of_all_states(rule, capacity):
    """With capacities that bind, and weights under which the fullest sequences in tokens are not the best ones."""
    rng = np.random.default_rng(11)
    lengths = rng.integers(1, 38, 400)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    weights = (0.05, 1.0, 1.0)
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    used, scores, groups = {}, [], []
    for length, _, n, first, offset in plan(counts, capacity, rule, weights):
        if groups and offset and groups[-1][:3] == (length, n, first):
            groups[-1] = (length, n, first, groups[-1][3] + 1)  # new sequences, filled one after the other
        else:
            groups.append((length, n, first, 1))
    for length, n, first, times in groups:
        need = capacity.needs(length)
        for k in (k for k in range(first, first + n) for _ in range(times)):
            after = [u + x for u, x in zip(used.get(k, (0, 0, 0)), (length, 1, length * length))]
            state = [1 - x / limit for x, limit in zip(after, limits)]
            # among the sequences open before this range, none that has room scores better
            mine = sum(w * (m * x if rule == "dot" else x * x) for w, m, x in zip(weights, need, state))
            if k in used:
                for other in used.values():
                    to = [u + x for u, x in zip(other, (length, 1, length * length))]
                    if all(x <= limit for x, limit in zip(to, limits)):
                        rest = [1 - x / limit for x, limit in zip(to, limits)]
                        assert mine <= sum(w * (m * x if rule == "dot" else x * x) for w, m, x in zip(weights, need, rest)) + 1e-12
            used[k] = after
            scores.append(mine)
    assert len(scores) == 400
    assert abs(len(used) - best_by_full_search(counts, capacity, rule, weights)[0]) <= 2
    with pytest.raises(ValueError):
        plan(counts, capacity, rule, (1.0, -0.1, 0.0))


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(texts())] + [(50, None), (51, "w " * 9000), (51, "w " * 9000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'y' as piece", "0 as salt")
    out = pack(df, WORDS, with_ids=True).collect()
    plain = Tokenizer.from_file(WORDS)
    plain.encode_special_tokens = True
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, s, ids[s : s + 4096]) for k, s in enumerate(range(0, len(ids), 4096))]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.piece, r.start, r.ids) for r in out), key=key) == sorted(want, key=key)
    places = {}
    for r in out:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(df.limit(0), WORDS).count() == 0


def test_packing_keeps_special_tokens(spark):
    """Special tokens written out in a text, also inside and next to words, against the tokenizer as it is loaded."""
    from tokenizers import Tokenizer

    end, start = "<|endoftext|>", "<|startoftext|>"
    odd = [f"one {end} two", f"one{end}two", f"{end}{start}", f"a {start}\n\n{end}! é{end}é", end.upper(), "<|endoftext |>", f"<{end}>", f"x {end} " * 3000]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    plain = Tokenizer.from_file(WORDS)
    want = []
    for i, t in enumerate(odd):
        ids = plain.encode(t, add_special_tokens=False).ids + [1]
        want += [(i, k, s, ids[s : s + 4096]) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.ids) for r in pack(df, WORDS, with_ids=True).collect()) == want


def test_packing_query_wastes_little(spark):
    out = op5_best_fit_packing(spark, SF).toPandas()
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 4096) + 1


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12):
        code = codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else 2 ** (n - 2) if n <= 7 else 8)
        assert (abs(code.sum(axis=0)) < n).all()


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang")
    out = op10_language_id(spark, SF2).join(docs, "doc_id").filter("held_out").toPandas()
    assert len(out) > 250 and (out.lang_pred == out.lang).mean() > 0.98
    assert out.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34 !", "de"), (6, "le chat et le chien", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score1")
    model = fit_languages(df, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in predict_languages(df, model).collect()}
    assert {i for i, r in got.items() if r.lang_pred == UNKNOWN} == {3, 4, 5}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert fit_languages(df.limit(0), "doc_id", "text", "lang") is None
    assert {r.lang_pred for r in predict_languages(df, None).collect()} == {UNKNOWN}
    one = fit_languages(df.filter("lang = 'en'"), "doc_id", "text", "lang")
    assert {r.lang_pred for r in predict_languages(df, one).collect()} == {UNKNOWN, "en"}
    with pytest.raises(ValueError):
        predict_languages(df.selectExpr("*", "1 as score"), model)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    move = np.array([[1.0, 0.3], [0.5, 2.0]])
    first = np.array([0, 3, 3, 8, 8])
    x = np.exp(rng.normal(size=8))
    p = toxicity.marginals(x, first, move)
    for a, b in zip(first[:-1], first[1:]):
        total, marked = 0.0, np.zeros(b - a)
        for states in itertools.product((0, 1), repeat=int(b - a)):
            weight, before = 1.0, 0
            for y, potential in zip(states, x[a:b]):
                weight *= move[before, y] * (potential if y else 1)
                before = y
            total += weight
            marked += weight * np.array(states)
        assert np.allclose(marked / total, p[a:b])


def chain_log_sum(x, first, move):
    """Logarithm of the sum over all state sequences, text by text."""
    total = 0.0
    for a, b in zip(first[:-1], first[1:]):
        v = np.array([1.0, 0.0])
        for potential in x[a:b]:
            v = (v @ move) * (1, potential)
            total += np.log(v.sum())
            v /= v.sum()
    return total


def test_expected_moves_are_the_slope_of_the_log_sum():
    """Also across blocks, and for texts without tokens; a difference of the function's values gives the same."""
    rng = np.random.default_rng(2)
    move = rng.normal(size=(2, 2))
    first = np.array([0, 7, 7, 150, 151])
    x = np.exp(rng.normal(size=151))
    moves = np.zeros((2, 2))
    toxicity.marginals(x, first, np.exp(move), moves)
    assert np.isclose(moves.sum(), 151)
    for a, b in itertools.product((0, 1), repeat=2):
        step = np.zeros((2, 2))
        step[a, b] = 1e-5
        slope = (chain_log_sum(x, first, np.exp(move + step)) - chain_log_sum(x, first, np.exp(move - step))) / 2e-5
        assert np.isclose(moves[a, b], slope, rtol=1e-6)


def test_toxicity_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * 50 + ("vile" if k % 2 else "kind")) for k in range(40)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "doc_id % 2 as toxic")
    assert toxicity.fit_toxicity(docs, labels, "doc_id", "text", "toxic", max_bytes=3000) is not None
    assert toxicity.fit_toxicity(docs, labels, "doc_id", "text", "toxic", max_bytes=100) is None


def test_marginals_across_blocks():
    rng = np.random.default_rng(1)
    move = np.array([[1.0, 0.2], [0.7, 1.5]])
    x = np.exp(rng.normal(size=300))
    p = toxicity.marginals(x, np.array([0, 300]), move)
    forward, v = [], np.array([1.0, 0.0])
    for k in range(300):
        v = v @ move
        v[1] *= x[k]
        v /= v.sum()
        forward.append(v)
    v = np.ones(2)
    for k in reversed(range(300)):
        both = forward[k] * v
        assert np.isclose(both[1] / both.sum(), p[k])
        w = v.copy()
        w[1] *= x[k]
        v = move @ w
        v /= v.sum()


def test_toxicity_held_out(spark):
    labels = spark.read.parquet(f"{SF2}/labels.parquet").select("doc_id", "toxic")
    out = op8_toxicity(spark, SF2)
    assert out.count() == 1000
    held = out.filter("held_out").join(labels, "doc_id").toPandas()
    clean, toxic = held[held.toxic == 0], held[held.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.97
    # two random held-out documents of either label are in the right order
    assert np.mean([(t > clean.score).mean() for t in toxic.score]) > 0.9


def test_toxicity_spans_and_edges(spark):
    rnd = random.Random(6)
    words = [f"wort{chr(97 + k)}" for k in range(26)]
    rows = []
    for i in range(200):
        w = [rnd.choice(words) for _ in range(20)]
        if i % 2:
            w[rnd.randrange(20)] = rnd.choice(["Nasty", "vile!"])
        rows.append((i, " ".join(w), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    chain = toxicity.fit_toxicity(df, df.select("doc_id", "y"), "doc_id", "text", "y")
    more = spark.createDataFrame([(900, None), (901, ""), (902, "... !"), (903, "É nasty day " + "wortb " * 20000), (None, "vile")], "doc_id long, text string")
    out = {r.doc_id: r for r in toxicity.score_toxicity(df.select("doc_id", "text").union(more), chain).collect()}
    assert all(out[i].predicted == i % 2 for i in range(200))
    assert [out[i].predicted for i in (900, 901, 902, 903, None)] == [0, 0, 0, 1, 1]
    span = out[903].spans[0]
    assert "É nasty day".encode()[span.start : span.end] == b"nasty"
    assert toxicity.fit_toxicity(df, df.filter("y = 0").select("doc_id", "y"), "doc_id", "text", "y") is None
    assert {r.score for r in toxicity.score_toxicity(more, None).collect()} == {0.0}


def test_round_trip_in_one_pass_equals_three(spark, monkeypatch):
    monkeypatch.setattr("topicflow.llm.sentencepiece_codec.DECODED", 50)
    texts = [None, "", " ", "plain words  and\ttabs", "é\u0301 日本語 \U0001f600", "word " * 300, "x" * 2000, "<0x41> ▁ ⁇"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    one = round_trip_digest(df, PIECES)
    assert one.columns == ["doc_id", "ids", "decoded", "n_ids", "ids_crc32", "decoded_sha256"]
    three = id_digest(decode_ids(encode_texts(df.select("doc_id", "text"), PIECES).drop("text"), PIECES))
    three = three.selectExpr("doc_id", "n_ids", "ids_crc32", "sha2(decoded, 256) AS decoded_sha256")
    assert sorted(map(tuple, one.drop("ids", "decoded").collect())) == sorted(map(tuple, three.collect()))
