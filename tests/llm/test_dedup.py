"""Exact, line, near, substring and suffix-array dedup against SQL and brute force, with awkward rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from topicflow.llm import near_dedup, suffix_dedup
from topicflow.llm.components import components
from topicflow.llm.exact_dedup import exact_duplicates
from topicflow.llm.line_dedup import dedup_lines
from topicflow.llm.near_dedup import near_duplicates
from topicflow.llm.queries import ORACLE, QUERIES
from topicflow.llm.substring_dedup import remove_repeats, shortened
from topicflow.llm.suffix_dedup import remove_repeated_bytes
from topicflow.scratch import Scratch
from topicflow.session import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship_package(spark)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", ["op2_line_dedup", "op6_exact_dedup"])
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), QUERIES[name], ORACLE[name], SF) == ""


def test_exact_awkward_rows(spark):
    rows = [(1, "A b"), (2, "a B"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (None, "a b"), (None, "z")]
    out = exact_duplicates(table(spark, rows).selectExpr("*", "1 as kept", "2 as sha", "3 as group_size")).collect()
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out)
    assert got == Counter(
        [(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True)]
        + [(7, 7, 2, True)] * 2 + [(None, None, 1, True)]
    )
    assert {r.text_sha256 for r in out if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}
    assert exact_duplicates(table(spark, [])).count() == 0


def test_exact_with_a_full_filter(spark):
    """A filter far too small lets everything through and changes nothing."""
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    out = exact_duplicates(table(spark, rows), max_bits=1 << 6).collect()
    assert all(r.keep_id == (r.doc_id + 700 if r.doc_id < 300 else r.doc_id) for r in out)


def brute_lines(rows):
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text)
    return out


def test_lines_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "\n".join(rnd.choice("abcd") for _ in range(rnd.randrange(0, 12)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "\n\n\n\n"), (203, "a\nb"), (204, "long " * 20000 + "\nx\ny\nlast")]
    out = dedup_lines(table(spark, rows).selectExpr("*", "7 as at", "8 as w1", "9 as id"))
    assert out.columns == ["doc_id", "text", "at", "w1", "id", "n_lines", "n_removed"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute_lines(rows)
    # every name that the operator uses inside may be a column
    names = ["id", "of", "starts", "hit", "split", "gone", "kept", "l", "h", "z", "w2", "k", "first", "Hit_at", "hit_page", "hit_bitmap"]
    out = dedup_lines(table(spark, rows).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in out.collect()} == brute_lines(rows)
    assert out.select(names).distinct().collect() == [tuple(range(len(names)))]
    assert dedup_lines(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(table(spark, rows).selectExpr("*", "1 as n_lines"))


def shingle_set(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_near(rows, n=4):
    sets = {i: shingle_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    rows = []
    for group in range(6):
        base = [rnd.choice(words) for _ in range(rnd.choice([6, 40, 90]))]
        for _ in range(rnd.choice([2, 5, 40])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "  \n ", "One two", "one TWO", "one", "w1 w2 w3 w4", "Ä b", "ä b", "again " * 30000])]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_near_against_brute_force(spark, monkeypatch, block):
    """Also with blocks so small that regions are split at greater depth and meet block by block."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    rows = near_rows()
    out = near_duplicates(table(spark, rows).selectExpr("*", "'x' as sig", "1 as id", "2 as rep")).collect()
    want = brute_near(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


@pytest.mark.parametrize("tree, found", [(2, False), (5, True), (7, False)])
def test_near_pairs_are_judged_in_their_first_common_region(tree, found):
    """Bytes agree in trees 2, 5 and 7, but the keys that make the regions in 5 and 7 only."""
    trees = near_dedup.TREES
    sig = np.zeros((2, trees, near_dedup.DEPTH), np.uint8)
    keys = np.arange(2 * trees).reshape(2, trees)
    sig[1, [k for k in range(trees) if k not in (2, 5, 7)], 0] = 1
    keys[1, [5, 7]] = keys[0, [5, 7]]
    text = "one two three four five six"
    block = pa.table({
        "id": [10, 20], "tree": [tree] * 2, "sig": [x.tobytes() for x in sig], "keys": pa.array(keys.tolist(), pa.list_(pa.int64())),
        "comp": [10, 20], "minor": [True, False], "text": [text, text],
    })
    links = near_dedup._across(near_dedup._least_agreement(0.8), 4, 80)(block).to_pylist()
    assert links == ([{"a": 10, "b": 20}] if found else [])


def test_near_sets_and_candidates():
    texts = ["A b c d e f", "a b c d e f", "a b c d e g", None, "x", " one Two "]
    sets = near_dedup._sets(pa.array(texts), 4)
    assert [s.size for s in sets] == [3, 3, 3, 0, 1, 1]
    assert near_dedup._similar(sets[0], sets[1], 80) and not near_dedup._similar(sets[0], sets[2], 80) and near_dedup._similar(sets[0], sets[2], 50)
    sig = np.zeros((3, near_dedup.SIGNATURE), np.uint8)
    sig[2] = 1
    block = pa.table({
        "id": [1, 2, 3], "tree": [0] * 3, "sig": [x.tobytes() for x in sig], "keys": pa.array([[0] * near_dedup.TREES] * 3, pa.list_(pa.int64())),
        "comp": [1, 2, 3], "minor": [True, False, False],
    })
    assert near_dedup._candidates(near_dedup._least_agreement(0.8))(block)["id"].to_pylist() == [1, 2]


def test_near_edges(spark):
    assert near_duplicates(table(spark, [])).count() == 0
    out = near_duplicates(table(spark, [(None, "a b c d e"), (1, "a b c d e"), (2, None)])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [("1", "1", True), ("2", "2", True), ("None", "None", True)]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    got = {r.node: r.component for r in df.collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def brute_words(rows, window):
    seen, out = {}, {}
    for i, text in sorted(rows):
        w = (text or "").encode().split()
        keys = [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
        gone = bytearray(len(w))
        for k, key in enumerate(keys):
            if seen.get(key, i) < i:
                gone[k : k + window] = b"\1" * window
        for key in keys:
            seen.setdefault(key, i)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def passage_rows(sep=" "):
    rnd = random.Random(9)
    make = lambda n: [rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(n)]
    shared = [make(40) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = make(rnd.randrange(0, 40)) + rnd.choice(shared)[rnd.randrange(0, 15) : rnd.randrange(20, 40)] + make(rnd.randrange(0, 30))
        rows.append((i, sep.join(parts)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, " \t\n"), (104, "a " * 30000), (105, "a\tb\x0bc  ü")]
    return rows


@pytest.mark.parametrize("window,gram", [(12, 5), (50, 24)])
def test_substrings_against_brute_force(spark, window, gram):
    rows = passage_rows()
    df = table(spark, rows).selectExpr("*", "1 as id", "2 as spans")
    out = remove_repeats(df, window=window, gram=gram).collect()
    want = brute_words(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == want
    cut = shortened(df, window=window, gram=gram).collect()
    assert {r.doc_id for r in cut} == {i for i, (_, gone, _) in want.items() if gone}


def test_substrings_edges(spark):
    assert remove_repeats(table(spark, [])).count() == 0
    out = remove_repeats(table(spark, [(None, "a " * 60), (None, "a " * 60), (3, "b")])).collect()
    assert all(r.n_removed == 0 for r in out) and len(out) == 3


def test_collection_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = rng.integers(0, 30, rng.integers(1, 8))
        data = rng.integers(1, 4, int(lengths.sum())).astype(np.uint8)
        limits = np.concatenate([[0], np.cumsum(lengths)])
        place, lcp = suffix_dedup.collection_order(data, limits[1:], lengths)
        end = {p: limits[k + 1] for k in range(lengths.size) for p in range(limits[k], limits[k + 1])}
        suffixes = [b""] * lengths.size + [data[p : end[p]].tobytes() for p in place[lengths.size :].tolist()]
        assert suffixes == sorted(suffixes)
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1 : k + 1]
            assert lcp[k] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))


def brute_bytes(rows, window):
    texts = {i: (t or "").encode() for i, t in rows}
    count = Counter(b[k : k + window] for b in texts.values() for k in range(len(b) - window + 1))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out[i] = (len(b), sum(gone), spans, kept)
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 0])
def test_bytes_against_brute_force(spark, monkeypatch, hot):
    """Both the buckets and, with the bound at 0, the counted windows."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", 2000)
    rows = [(i, t if i != 104 else "ab" * 900) for i, t in passage_rows()]
    scratch_hot = suffix_dedup.repeated_spans.__defaults__
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (hot,))
    out = remove_repeated_bytes(table(spark, rows).selectExpr("*", "1 as id", "2 as spans"), window=30, gram=15).collect()
    assert scratch_hot == (suffix_dedup.HOT,)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in out} == brute_bytes(rows, 30)


def test_bytes_edges(spark):
    assert remove_repeated_bytes(table(spark, [])).count() == 0
    out = remove_repeated_bytes(table(spark, [(None, "a" * 900), (1, "b" * 401), (2, None)])).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in out) == [(0, 0, 0), (401, 401, 1), (900, 0, 0)]
