"""Substring dedup by seeds and extension.

Seeds are winnowed anchors: every window of ``window`` words selects its smallest n-gram, so equal
windows meet at equal anchors.  Documents join on anchors through counts, never pairwise:

1. Anchors seen in two documents go into a bounded Bloom filter.
2. The text is read again.  An anchor in the filter gives one segment: all windows that select
   it, hashed as a whole to 128 bits.  Of equal segments the smallest document's stands for all;
   the same stretch is covered in every other document.
3. Where an anchor still has different segments, each class's first segment is extended: with
   ``k`` words to the left of the anchor and the rest to the right, for every ``k``, that is by its windows.
   Classes of equal extensions are aggregates with partial sums, so a passage in a
   third of all documents costs a row per document and window at most.
4. Covered windows merge to maximal repeats per document.

Only texts that lose words are shuffled, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicflow.llm import bloom, words
from topicflow.llm.batches import small_batches
from topicflow.llm.spans import anchors, merged
from topicflow.scratch import Scratch

_KEY = np.uint64(0x9FB21C651E98DF25)


def _pieces(batches: Iterator[pa.RecordBatch], skip: bloom.TaskFilter | None = None):
    """``(ids, word hashes, first word of each text)`` piece by piece; rows without an id are left out."""
    for batch in batches:
        if skip is not None:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(skip.maybe(words.mix(ids.astype(np.int64).view(np.uint64)))))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, data, offsets in words.pieces(batch.column(1)):
            start, end, first = words.word_spans(data, offsets)
            yield ids[row : row + offsets.size - 1], words.word_hashes(data, start, end), first


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(words.signed(c) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names.split()
    )


def _find_anchors(batches, window: int, gram: int):
    for ids, hashes, first in _pieces(batches):
        doc, _, _, _, value = anchors(hashes, first, window, gram)
        both = np.unique(np.stack([doc.astype(np.uint64), value]), axis=1) if doc.size else np.zeros((2, 0), np.uint64)
        yield _batch("anchor id", both[1], ids[both[0].astype(np.int64)])


def _segments(batches, window: int, gram: int, repeated: bloom.TaskFilter):
    for ids, hashes, first in _pieces(batches):
        doc, start, count, _, value = anchors(hashes, first, window, gram)
        keep = repeated.maybe(value)
        doc, start, count, value = doc[keep], start[keep], count[keep], value[keep]
        s1, s2 = (words.runs_hash(hashes, start, start + count + window - 1, k) for k in (0, 1))
        key = words.mix(s1 ^ (ids[doc].view(np.uint64) * _KEY))
        yield _batch("anchor s1 s2 key id at n", value, s1, s2, key, ids[doc], start - first[doc], count)


def _extend(batches, window: int, gram: int, wanted: bloom.TaskFilter, holders: bloom.TaskFilter):
    for ids, hashes, first in _pieces(batches, holders):
        doc, start, count, _, value = anchors(hashes, first, window, gram)
        s1 = words.runs_hash(hashes, start, start + count + window - 1, 0)
        keep = wanted.maybe(words.mix(s1 ^ (ids[doc].view(np.uint64) * _KEY)))
        doc, start, count = doc[keep], start[keep], count[keep]
        each = np.repeat(np.arange(doc.size), count)
        at = start[each] + np.arange(each.size) - np.repeat(np.cumsum(count) - count, count)
        w1, w2 = (words.runs_hash(hashes, at, at + window, k) for k in (0, 1))
        yield _batch("w1 w2 id at", w1, w2, ids[doc[each]], at - first[doc[each]])


def repeats(docs: DataFrame, window: int, gram: int, scratch: Scratch) -> DataFrame:
    """``(id, spans)``: word intervals ``(s, e)`` of ``docs(id, text)`` whose windows start in a smaller id, too."""
    spark = docs.sparkSession
    seeds = docs.mapInArrow(lambda it: _find_anchors(it, window, gram), "anchor long, id long")
    repeated = scratch.save(
        seeds.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("anchor"), "anchors"
    )
    bits = bloom.filter_bits(repeated.count())
    seen = bloom.share(spark, bloom.build(repeated, "anchor", bits), bits)
    segments = scratch.save(
        docs.mapInArrow(
            lambda it: _segments(it, window, gram, seen),
            "anchor long, s1 long, s2 long, key long, id long, at long, n long",
        ),
        "segments",
    )
    classes = scratch.save(
        segments.groupBy("s1", "s2").agg(F.min("id").alias("first"), F.min("anchor").alias("anchor")), "classes"
    )
    contested = classes.groupBy("anchor").count().filter("count > 1").select("anchor")
    judged = segments.drop("anchor").join(classes, ["s1", "s2"])
    copied = judged.filter("id > first").select("id", F.col("at").alias("s"), F.expr(f"at + n + {window - 1}").alias("e"))
    heads = scratch.save(judged.filter("id = first").join(contested, "anchor").select("key", "id").distinct(), "heads")
    bits = bloom.filter_bits(heads.count())
    wanted = bloom.share(spark, bloom.build(heads, "key", bits), bits)
    holder = heads.select("id").distinct().mapInArrow(_mixed_ids, "id long")
    holders = bloom.share(spark, bloom.build(holder, "id", bits), bits)
    windows = scratch.save(
        docs.mapInArrow(lambda it: _extend(it, window, gram, wanted, holders), "w1 long, w2 long, id long, at long"), "windows"
    )
    first = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    first = scratch.save(first.drop("last"), "shared")
    bits = bloom.filter_bits(first.count())
    pages = bloom.build(first, "w1", bits)
    maybe = bloom.probe(windows, F.col("w1"), pages, bits, "hit").filter("hit")
    met = maybe.join(first, ["w1", "w2"]).filter("id > first").select("id", F.col("at").alias("s"), F.expr(f"at + {window}").alias("e"))
    spans = scratch.save(copied.union(met).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    scratch.forget(repeated, segments, classes, heads, windows, first)
    return spans


def _mixed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy().astype(np.int64)
        yield _batch("id", words.mix(ids.view(np.uint64)))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            have = (text.as_py() or b"").split()
            n_words.append(len(have))
            gone = 0
            if spans.is_valid:
                flat = spans.values.flatten()
                starts, ends = merged(flat[0].to_numpy(), flat[1].to_numpy())
                gone = int((ends - starts).sum())
                stay, last = [], 0
                for s, e in zip(starts.tolist(), ends.tolist()):
                    stay += have[last:s]
                    last = e
                have = stay + have[last:]
            n_removed.append(gone)
            kept.append(b" ".join(have).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["id", "n_words", "n_removed", "kept_text"],
        )


def _split(docs: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Texts ``(id, text, spans)`` that certainly keep all words, and those that may lose some."""
    scratch = Scratch(docs.sparkSession, "substring")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        spans = repeats(texts.filter("id is not null"), window, gram, scratch)
    bits = bloom.filter_bits(spans.count())
    pages = scratch.save(bloom.build(spans.select(F.xxhash64("id").alias("k")), "k", bits), "holders")
    looked = bloom.probe(texts, F.xxhash64("id"), pages, bits, "hit")
    same = looked.filter("not hit").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return same, looked.filter("hit").join(spans, "id", "left").select("id", "text", "spans")


_RESULT = "id long, n_words long, n_removed long, kept_text string"


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 24
) -> DataFrame:
    """``(id, n_words, n_removed, kept_text)`` for every row of ``docs``.

    A word goes if a window of ``window`` words covers it whose sequence also starts in a document
    with a smaller id; all windows are those of the input.  ``kept_text`` joins the other words by one
    space.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Null, empty and blank texts have no words and
    give an empty ``kept_text``.  Ids must be unique integers; a row with a null id neither
    loses words nor makes others lose any.  Other columns are not read.
    """
    same, cut = _split(docs, id_col, text_col, window, gram)
    return same.mapInArrow(_cut, _RESULT).union(cut.mapInArrow(_cut, _RESULT)).withColumnRenamed("id", id_col)


def shortened(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 24
) -> DataFrame:
    """The rows of ``remove_repeats`` that lose words."""
    _, cut = _split(docs, id_col, text_col, window, gram)
    return cut.mapInArrow(_cut, _RESULT).filter("n_removed > 0").withColumnRenamed("id", id_col)
