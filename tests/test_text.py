"""Tokens, vocabulary, packing, mail cleaning."""

import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.functions.text import ENGLISH_STOP_WORDS
from topicflow.operators import vocabulary as vo
from topicflow.sources import corpus as co

TEXTS = [
    (0, "The cat sat; the CAT ran. naïve Ünïcode_x 42 a I"),
    (1, ""),
    (2, "the and of"),
    (3, "dog dog cat bird_bird"),
    (4, "bird bird dog 7 77 777"),
]


@pytest.fixture()
def corpus(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def expected_tokens(text):
    return re.findall(r"(?u)\b\w\w+\b", text.lower())


def test_tokens_match_word_pattern(spark, corpus):
    got = rows(vo.token_table(corpus))
    want = sorted((d, i, t) for d, text in TEXTS for i, t in enumerate(expected_tokens(text)))
    assert got == want


def test_doc_term_counts_without_shuffle(corpus):
    counts = vo.doc_term_counts(corpus)
    want = sorted(
        (d, t, n)
        for d, text in TEXTS
        for t, n in Counter(expected_tokens(text)).items()
        if t not in ENGLISH_STOP_WORDS
    )
    assert rows(counts) == want
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vocabulary_ranks_by_total_count_and_numbers_alphabetically(corpus):
    # dog 3, bird 2, cat 3 -> the three most frequent, ties by term
    got = rows(vo.fit_vocabulary(corpus, 3))
    assert got == [(0, "bird", 2), (1, "cat", 3), (2, "dog", 3)]


def test_vocabulary_limits(corpus):
    with pytest.raises(ValueError):
        vo.fit_vocabulary(corpus, 0)
    stop_only = corpus.filter("doc_id = 2")
    with pytest.raises(ValueError, match="empty vocabulary"):
        vo.check_vocabulary(vo.fit_vocabulary(stop_only, 5))


@pytest.mark.parametrize("terms", [4_000_000, 1])
def test_pack_keeps_empty_documents(corpus, terms, monkeypatch):
    monkeypatch.setattr(vo, "TABLE_TERMS", terms)
    vocab = vo.fit_vocabulary(corpus, 3)
    packed = {r["doc_id"]: (r["terms"], r["cnts"]) for r in vo.pack_documents(corpus, vocab).collect()}
    assert packed == {
        0: ([1], [2.0]),
        1: ([], []),
        2: ([], []),
        3: ([1, 2], [1.0, 2.0]),
        4: ([0, 2], [2.0, 1.0]),
    }


def test_pack_is_narrow(corpus):
    vocab = vo.fit_vocabulary(corpus, 3).cache()
    vocab.count()
    plan = vo.pack_documents(corpus, vocab)._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_probe_tells_terms_of_one_first_hash_apart():
    high = np.array([5, 5, 5, 9], np.int64)
    table = (high, np.array([1, 2, 3, 1], np.int64), np.array([10, 11, 12, 13], np.int32))
    got = vo._probe(table, np.array([5, 5, 5, 9, 9, 4, 10, 5], np.int64), np.array([3, 1, 4, 1, 2, 1, 1, 2], np.int64))
    assert got.tolist() == [12, 10, -1, 13, -1, -1, -1, 11]


def test_large_vocabulary_on_a_stream(spark, tmp_path, monkeypatch):
    """100,000 terms in two tables, looked up in a stream as in a batch."""
    monkeypatch.setattr(vo, "TABLE_TERMS", 60_000)
    number = F.row_number().over(Window.orderBy("id")) - 1
    vocab = spark.range(100_000).select(number.cast("int").alias("term_id"), F.concat(F.lit("w"), F.lpad("id", 6, "0")).alias("term")).cache()
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.lpad(((F.col("id") * 37 + k * 997) % 110_000).cast("string"), 6, "0")) for k in range(5)], F.lit("other"))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), text.alias("text"))
    docs.write.parquet(str(tmp_path / "in"))
    want = {i: sorted({n for k in range(5) if (n := (i * 37 + k * 997) % 110_000) < 100_000}) for i in range(4000)}
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    query = (
        vo.pack_documents(stream, vocab).writeStream.format("memory").queryName("packed")
        .option("checkpointLocation", str(tmp_path / "state")).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["doc_id"]: r["terms"] for r in spark.table("packed").collect()} == want
    assert {r["doc_id"]: r["terms"] for r in vo.pack_documents(docs, vocab).collect()} == want


def test_long_form_and_presence(corpus):
    packed = vo.pack_documents(corpus, vo.fit_vocabulary(corpus, 3))
    assert rows(vo.doc_term_matrix(packed)) == [(0, 1, 2), (3, 1, 1), (3, 2, 2), (4, 0, 2), (4, 2, 1)]
    assert rows(vo.presence(packed)) == [(0, 1), (3, 1), (3, 2), (4, 0), (4, 2)]


def test_vocabulary_with_one_term(corpus):
    vocab = vo.fit_vocabulary(corpus, 1)
    packed = vo.doc_term_matrix(vo.pack_documents(corpus, vocab))
    assert rows(packed) == [(0, 0, 2), (3, 0, 1)]


def plain_strip(text):
    """The cleaning rules, said again in plain Python."""
    text = text.partition("\n\n")[2]
    lines = text.strip().split("\n")
    rule = max((i for i, x in enumerate(lines) if x.strip().strip("-") == ""), default=0)
    if rule > 0:
        text = "\n".join(lines[:rule])
    quote = r"(writes in|writes:|wrote:|says:|said:|^In article|^Quoted from|^\||^>)"
    return "\n".join(x for x in text.split("\n") if not re.search(quote, x))


@pytest.mark.parametrize(
    "text",
    [
        "From: a\nSubject: b\n\nbody\n> quoted\nmore\n\n--\nsignature",
        "no header at all",
        "",
        "h\n\n",
        "h\n\nonly body",
        "h\n\nIn article 5\nBob wrote: hi\n| bar\ntext says: x\nkeep",
        "h\n\n\n\nbody after blanks\n---\nfoot\n",
        "h\n\n---\nsingle rule first",
        "h\n\n  padded  \n --- \ntail  ",
        "h\n\na\n\nb\n\nc",
    ],
)
def test_strip_mail(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert co.strip_mail(df).first()["text"] == plain_strip(text)


def test_strip_mail_parts(spark):
    df = spark.createDataFrame([(1, "h\n\n> q\nbody")], "doc_id long, text string")
    assert co.strip_mail(df, ("quotes",)).first()["text"] == "h\n\nbody"
    with pytest.raises(ValueError):
        co.strip_mail(df, ("signatures",))


def test_read_corpus_fails_loudly(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "k long, t string").write.json(str(tmp_path / "j"))
    got = co.read_corpus(spark, str(tmp_path / "j"), "json", "k", "t")
    assert rows(got) == [(1, "x")]
    with pytest.raises(ValueError, match="columns not in"):
        co.read_corpus(spark, str(tmp_path / "j"), "json")


def test_scan_reads_only_needed_columns(spark):
    df = co.read_corpus(spark, "/root/testdata/sf0.001/documents.parquet")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
