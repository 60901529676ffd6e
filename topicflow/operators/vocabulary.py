"""Bag of words: tokens, vocabulary, document-term matrix.

Arrays are exploded with the ``_outer`` forms and NULLs filtered afterwards: for a
plain ``explode`` the optimizer infers a filter on the size of the array and
pushes it to the scan, which would evaluate the tokeniser a second time.

The whole path from text to packed term counts is narrow, for any vocabulary and on
streams too.  Only the vocabulary itself needs a shuffle, of one partial count per task and term.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from topicflow.batches import pieces
from topicflow.functions.text import ENGLISH_STOP_WORDS, tokens, with_run_lengths

# Terms of one look-up table: 20 bytes each, so a table has at most 80 MB.  Larger vocabularies are
# looked up in several tables, one narrow stage after another.
TABLE_TERMS = 4_000_000

PACKED_SCHEMA = "terms array<int>, cnts array<double>"


def token_table(corpus: DataFrame) -> DataFrame:
    """``(doc_id, idx, token)``: every token of every document, in order."""
    out = corpus.select("doc_id", F.posexplode_outer(tokens(F.col("text"))).alias("idx", "token"))
    return out.filter(F.col("token").isNotNull())


def remove_stop_words(
    df: DataFrame, column: str = "token", stop_words: Iterable[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    """Filter by membership in a constant set (a hash probe inside codegen)."""
    words = sorted(set(stop_words))
    return df.filter(~F.col(column).isin(words)) if words else df


def count_documents(corpus: DataFrame) -> DataFrame:
    """The corpus with ``counted array<struct<term, cnt>>`` in place of its text; narrow.

    Saved once, it serves the vocabulary and packing, so each text is tokenised once.
    A corpus that is counted already is returned as it is.
    """
    if "counted" in corpus.columns:
        return corpus
    keys = [c for c in corpus.columns if c != "text"]
    return with_run_lengths(corpus.select(*keys, tokens(F.col("text")).alias("_tokens")), "_tokens", "counted", "term").drop("_tokens")


def doc_term_counts(corpus: DataFrame, stop_words: Iterable[str] = ENGLISH_STOP_WORDS) -> DataFrame:
    """``(doc_id, term, cnt)`` without a shuffle: counting happens inside the row."""
    rows = count_documents(corpus).select("doc_id", F.inline_outer("counted")).filter(F.col("term").isNotNull())
    return remove_stop_words(rows, "term", stop_words)


def term_frequencies(
    corpus: DataFrame, stop_words: Iterable[str] = ENGLISH_STOP_WORDS
) -> DataFrame:
    """``(term, tf)`` over the whole corpus, partially counted before its one shuffle."""
    rows = count_documents(corpus).select(F.inline_outer("counted")).filter(F.col("term").isNotNull())
    return remove_stop_words(rows, "term", stop_words).groupBy("term").agg(F.sum("cnt").alias("tf"))


def fit_vocabulary(
    corpus: DataFrame,
    max_features: int = 2000,
    stop_words: Iterable[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """The ``max_features`` most frequent terms as ``(term_id, term, tf)``, ids alphabetical.

    The numbering window sees only the kept rows, so its single partition is
    bounded by ``max_features``.
    """
    if max_features < 1:
        raise ValueError("max_features must be at least 1")
    top = (
        term_frequencies(corpus, stop_words)
        .orderBy(F.desc("tf"), F.asc("term"))
        .limit(max_features)
    )
    number = F.row_number().over(Window.orderBy("term")) - 1
    return top.select(number.cast("int").alias("term_id"), "term", "tf")


def check_vocabulary(vocab: DataFrame) -> int:
    """Number of terms; an empty vocabulary is an error."""
    size = vocab.count()
    if size == 0:
        raise ValueError("empty vocabulary; perhaps the documents only contain stop words")
    return size


# --- look-up ---------------------------------------------------------------------


def _hashes(term: Column) -> tuple[Column, Column]:
    """128 bits that stand for a term: a vocabulary of 10^9 terms has two equal ones with a probability below 10^-20."""
    return F.xxhash64(term), F.xxhash64(F.lit(1), term)


def _table(vocab: DataFrame, tables: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and ids of the terms of one table, sorted by hash."""
    high, low = _hashes(F.col("term"))
    rows = vocab.select(high.alias("high"), low.alias("low"), F.col("term_id").cast("int").alias("id"))
    if tables > 1:
        rows = rows.filter(F.pmod("high", F.lit(tables)) == number)
    found = rows.toArrow()
    high, low, ids = (found[c].to_numpy() for c in ("high", "low", "id"))
    order = np.lexsort((low, high))
    return high[order], low[order], ids[order]


def _probe(table: tuple[np.ndarray, np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Ids of hashed terms, -1 for terms that the table does not have."""
    keys, second, ids = table
    out = np.full(high.size, -1, np.int32)
    if not keys.size:
        return out
    at = np.searchsorted(keys, high)
    # terms that share the first hash stand side by side
    open_ = np.flatnonzero(at < keys.size)
    while open_.size:
        place = at[open_]
        same = keys[place] == high[open_]
        hit = same & (second[place] == low[open_])
        out[open_[hit]] = ids[place[hit]]
        at[open_] += 1
        open_ = open_[same & ~hit]
        open_ = open_[at[open_] < keys.size]
    return out


def _list_values(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten())


def _look_up(shared, last: bool):
    """A stage that adds the ids of one table; the last one keeps and sorts what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_high"):
            offsets = np.asarray(batch.column("_high").offsets)
            high, low, count = (_list_values(batch.column(c)) for c in ("_high", "_low", "_cnt"))
            found = _probe(shared.value, high, low)
            if "_id" in batch.schema.names:
                found = np.maximum(found, _list_values(batch.column("_id")))
            keys = [c for c in batch.schema.names if c not in ("_high", "_low", "_cnt", "_id")]
            columns = [batch.column(c) for c in keys]
            offsets = offsets - offsets[0]
            if last:
                row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
                known = np.flatnonzero(found >= 0)
                order = known[np.lexsort((found[known], row[known]))]
                bounds = np.concatenate([[0], np.cumsum(np.bincount(row[known], minlength=batch.num_rows))])
                lists = {"terms": found[order], "cnts": count[order].astype(np.float64)}
            else:
                bounds, lists = offsets, {"_high": high, "_low": low, "_cnt": count, "_id": found}
            at = pa.array(bounds, pa.int32())
            columns += [pa.ListArray.from_arrays(at, pa.array(v)) for v in lists.values()]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, *lists])

    return run


def pack_documents(
    corpus: DataFrame, vocab: DataFrame, vocab_size: int | None = None
) -> DataFrame:
    """One row per document: its columns but ``text`` (or ``counted``), plus sorted ``terms`` and ``cnts``.

    Documents without a known term stay, with empty arrays.  Terms travel as hashes and are looked up in
    sorted tables that the tasks share, whatever the size of the vocabulary: no shuffle, and the
    same on a stream.  Column names ``_high``, ``_low``, ``_cnt`` and ``_id`` are taken.
    """
    vocab = vocab.select("term", "term_id")
    size = check_vocabulary(vocab) if vocab_size is None else vocab_size
    keys = [c for c in corpus.columns if c not in ("text", "counted")]
    counted = count_documents(corpus)
    runs = F.coalesce("counted", F.array().cast(counted.schema["counted"].dataType))
    rows = counted.select(
        *keys,
        F.transform(runs, lambda r: _hashes(r["term"])[0]).alias("_high"),
        F.transform(runs, lambda r: _hashes(r["term"])[1]).alias("_low"),
        F.transform(runs, lambda r: r["cnt"].cast("long")).alias("_cnt"),
    )
    own = [rows.schema[c] for c in keys]
    middle = StructType(own + [StructField(c, ArrayType(k())) for c, k in (("_high", LongType), ("_low", LongType), ("_cnt", LongType), ("_id", IntegerType))])
    done = StructType(own + [StructField("terms", ArrayType(IntegerType())), StructField("cnts", ArrayType(DoubleType()))])
    tables = max(1, -(-size // TABLE_TERMS))
    context = corpus.sparkSession.sparkContext
    for number in range(tables):
        last = number == tables - 1
        rows = rows.mapInArrow(_look_up(context.broadcast(_table(vocab, tables, number)), last), done if last else middle)
    return rows


def doc_term_matrix(packed: DataFrame) -> DataFrame:
    """Packed documents -> long form ``(..., term_id, cnt)``; one row per non-zero cell."""
    keys = [c for c in packed.columns if c not in ("terms", "cnts")]
    return packed.select(*keys, F.explode_outer(F.arrays_zip("terms", "cnts")).alias("e")).select(
        *keys, F.col("e.terms").alias("term_id"), F.col("e.cnts").cast("long").alias("cnt")
    ).filter(F.col("term_id").isNotNull())


def presence(packed: DataFrame) -> DataFrame:
    """The binary matrix: cells of the counts, without the counts."""
    keys = [c for c in packed.columns if c not in ("terms", "cnts")]
    return packed.select(*keys, F.explode_outer("terms").alias("term_id")).filter(
        F.col("term_id").isNotNull()
    )
