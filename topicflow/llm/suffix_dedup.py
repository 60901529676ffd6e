"""Suffix-array dedup by column-wise construction over many strings.

A byte goes if a string of ``window`` bytes covers it that also starts elsewhere, in any text.
That is a question of common prefixes of neighbours in the suffix order of the collection.
``collection_order`` builds that order for many strings at once, column by column from the
right: each round puts one symbol of every string before its suffix, finds the new suffixes' ranks from
the Burrows-Wheeler transform so far (whose rows by symbol are kept in order between rounds), and updates the common prefixes next to them.  A round is one
sequential pass over flat arrays; the strings of one call are bounded (``BUCKET`` bytes), so the arrays
stay in memory where a single machine would use files.

What one call sees is chosen by content, so that equal windows always meet: every window selects an
anchor (its smallest n-gram), and

1. anchors seen twice go into a bounded Bloom filter;
2. an anchor in the filter gives one segment, the bytes of all windows that select it.  Equal segments
   are covered whole and one of them stands for all;
3. where an anchor has different segments, and more than the anchor is shared to one side, one of each goes, by
   anchor, into a bucket.
   Rounds are at most ``2 * window - gram``, whatever the texts' lengths;
4. an anchor with more than ``HOT`` bytes of segments is not put into one task: its windows are counted
   by 128-bit hashes with partial sums, which finds the same strings.
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

#: Bytes of segments in a bucket: small enough for the processor's cache.
BUCKET = 1 << 18
HOT = 8 << 20
_KEY, _AT = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def _range_minimum(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Smallest of ``values[start:end]`` for each pair; ``values`` has one entry more than ``end`` needs."""
    if not start.size:
        return values[:0]
    order = np.argsort(start)  # else the stretches between intervals would be reduced over and over
    out = np.empty(start.size, values.dtype)
    out[order] = np.minimum.reduceat(values, np.stack([start[order], end[order]], axis=1).ravel())[::2]
    return out


def _insertion(order: np.ndarray, count: np.ndarray, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where rows ``at``, sorted by symbol and row, go into ``order``; ``count[1:]`` are its rows by symbol."""
    limits = np.cumsum(count)
    found, first = np.unique(symbol, return_index=True)
    out = np.empty(at.size, np.int64)
    for s, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), at.size]):
        out[a:b] = limits[s] + np.searchsorted(order[limits[s] : limits[s + 1]], at[a:b])
    return out


def collection_order(data: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (places in ``data``) and common prefixes of strings ``data[end - length : end]``.

    Symbols are 1 to 255.  Entry ``k`` of the prefixes is shared by suffixes ``k - 1`` and ``k``; the first
    ``len(ends)`` entries are the empty suffixes.
    """
    by_length = np.argsort(-lengths, kind="stable")
    ends, lengths = ends[by_length], lengths[by_length]
    m = ends.size
    bwt = np.zeros(m, np.uint8)
    lcp = np.zeros(m + 1, np.int16)
    place = ends.astype(np.int32)
    rank = np.arange(m)
    order = np.zeros(0, np.int64)  # rows with a symbol before them, by symbol, then row
    count = np.zeros(257, np.int64)  # of them, by symbol + 1
    active = m
    for column in range(1, int(lengths[0]) + 1 if m else 0):
        while active and lengths[active - 1] < column:
            active -= 1
        symbol = data[ends[:active] - column]
        at = rank[:active]
        bwt[at] = symbol
        by_turn = np.lexsort((at, symbol))
        at, symbol = at[by_turn], symbol[by_turn]
        t = _insertion(order, count, symbol, at) + np.arange(active)
        kept = np.ones(order.size + active, bool)
        kept[t] = False
        merged = np.empty(kept.size, np.int64)
        merged[kept] = order
        merged[t] = at
        order = merged
        count += np.bincount(symbol.astype(np.int64) + 1, minlength=257)
        before, after = np.zeros(active, np.int16), np.zeros(active, np.int16)
        has = t > 0
        previous = order[np.where(has, t - 1, 0)]
        has &= bwt[previous] == symbol
        before[has] = _range_minimum(lcp, previous[has] + 1, at[has] + 1) + 1
        has = t < order.size - 1
        following = order[np.where(has, t + 1, 0)]
        has &= bwt[following] == symbol
        after[has] = _range_minimum(lcp, at[has] + 1, following[has] + 1) + 1
        size = bwt.size + active
        new = m + t
        old = np.ones(size, bool)
        old[new] = False
        grown = np.zeros(size, np.uint8)
        grown[old] = bwt
        wider = np.zeros(size + 1, np.int16)
        wider[:-1][old] = lcp[:-1]
        wider[new] = before
        inner = new + 1 < size
        wider[new[inner] + 1] = after[inner]
        longer = np.empty(size, np.int32)
        longer[old] = place
        longer[new] = ends[:active][by_turn] - column
        bwt, lcp, place = grown, wider, longer
        rank[by_turn] = new
        order = np.flatnonzero(old)[order]  # where the rows stand now
    return place, lcp[:-1]


def repeated_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Places of ``data`` where a ``window`` starts, inside its string, that starts at another place, too."""
    place, lcp = collection_order(data, ends, ends - starts)
    high = lcp >= window
    high[:-1] |= high[1:]
    return np.sort(place[high])


def _pieces(batches: Iterator[pa.RecordBatch], skip: bloom.TaskFilter | None = None):
    for batch in batches:
        if skip is not None:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(skip.maybe(words.mix(ids.astype(np.int64).view(np.uint64)))))
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, data, offsets in words.pieces(batch.column(1), 1 << 20):
            yield ids[row : row + offsets.size - 1], data, offsets


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(words.signed(c) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names.split()
    )


def _find_anchors(batches, window: int, gram: int):
    for _, data, offsets in _pieces(batches):
        yield _batch("anchor", anchors(data, offsets, window, gram)[4])


def _key(s1: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words.mix(s1 ^ (ids.view(np.uint64) * _KEY) ^ (at.astype(np.uint64) * _AT))


def _segments(batches, window: int, gram: int, repeated: bloom.TaskFilter):
    for ids, data, offsets in _pieces(batches):
        doc, start, count, place, value = anchors(data, offsets, window, gram)
        keep = repeated.maybe(value)
        doc, start, count, place, value = doc[keep], start[keep], count[keep], place[keep], value[keep]
        s1, s2 = (words.runs_hash(data, start, start + count + window - 1, k) for k in (0, 1))
        at = start - offsets[doc]
        key = _key(s1, ids[doc], at)
        # a window reaches at least half of the rest to the left of its anchor, or at least half to the right
        half = (window - gram) // 2
        left = words.runs_hash(data, np.maximum(place - half, start), place + gram)
        left = np.where(start <= place - half, left, key)
        right = words.runs_hash(data, place, np.minimum(place + window - half, data.size)) ^ _AT
        right = np.where(start + count > place - half, right, key ^ _KEY)
        yield _batch("anchor s1 s2 key id at n left right", value, s1, s2, key, ids[doc], at, count, left, right)


def _heads(batches, window: int, gram: int, wanted: bloom.TaskFilter, holders: bloom.TaskFilter):
    for ids, data, offsets in _pieces(batches, holders):
        doc, start, count, _, value = anchors(data, offsets, window, gram)
        s1 = words.runs_hash(data, start, start + count + window - 1, 0)
        key = _key(s1, ids[doc], start - offsets[doc])
        keep = wanted.maybe(key)
        doc, start, count, value, key = doc[keep], start[keep], count[keep], value[keep], key[keep]
        whole = data.tobytes()
        segment = [whole[s : s + c + window - 1] for s, c in zip(start.tolist(), count.tolist())]
        numbers = _batch("anchor key id at", value, key, ids[doc], start - offsets[doc])
        yield pa.RecordBatch.from_arrays([*numbers.columns, pa.array(segment, pa.binary())], ["anchor", "key", "id", "at", "segment"])


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all segments as symbols 1 to 255 (UTF-8 has no 255), and their limits."""
    segments = column.to_pylist()
    limits = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    return np.frombuffer(b"".join(segments), np.uint8) + np.uint8(1), limits


def _bucket_spans(window: int):
    def solve(table: pa.Table) -> pa.Table:
        data, limits = _joined(table["segment"])
        places = repeated_places(data, limits[:-1], limits[1:], window)
        segment = np.searchsorted(limits, places, "right") - 1
        # consecutive places of one segment are one run
        new = np.ones(places.size, bool)
        new[1:] = (np.diff(places) > 1) | (np.diff(segment) > 0)
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, places.size))
        owner = segment[first]
        s = table["at"].to_numpy()[owner] + places[first] - limits[owner]
        return pa.table({"id": table["id"].to_numpy()[owner], "s": s, "e": s + run - 1 + window})

    return solve


def _windows(batches, window: int):
    for batch in batches:
        data, limits = _joined(batch.column("segment"))
        count = np.diff(limits) - window + 1
        each = np.repeat(np.arange(count.size), count)
        at = limits[each] + np.arange(each.size) - np.repeat(np.cumsum(count) - count, count)
        w1, w2 = (words.runs_hash(data, at, at + window, k) for k in (0, 1))
        ids, base = (batch.column(c).to_numpy() for c in ("id", "at"))
        yield _batch("w1 w2 id at", w1, w2, ids[each], base[each] + at - limits[each])


def _mixed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch("id", words.mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)))


def repeated_spans(docs: DataFrame, window: int, gram: int, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """``(id, spans)``: byte intervals ``(s, e)`` of ``docs(id, text)`` made of windows that start elsewhere, too."""
    spark = docs.sparkSession
    seeds = docs.mapInArrow(lambda it: _find_anchors(it, window, gram), "anchor long")
    repeated = scratch.save(seeds.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    bits = bloom.filter_bits(repeated.count())
    seen = bloom.share(spark, bloom.build(repeated, "anchor", bits), bits)
    segments = scratch.save(
        docs.mapInArrow(
            lambda it: _segments(it, window, gram, seen),
            "anchor long, s1 long, s2 long, key long, id long, at long, n long, left long, right long",
        ),
        "segments",
    )
    classes = scratch.save(
        segments.groupBy("s1", "s2").agg(
            F.count(F.lit(1)).alias("size"), F.min("anchor").alias("anchor"), F.min(F.struct("id", "at", "key", "n", "left", "right")).alias("head")
        ),
        "classes",
    )
    many = classes.filter("size > 1").select("s1", "s2")
    copied = segments.join(many, ["s1", "s2"], "left_semi").select("id", F.col("at").alias("s"), F.expr(f"at + n + {window - 1}").alias("e"))
    halves = classes.select("anchor", "head", F.explode(F.array("head.left", "head.right")).alias("half"))
    shared = halves.groupBy("half").count().filter("count > 1").select("half")
    alive = halves.join(shared, "half", "left_semi").select("anchor", "head").distinct()
    alive = scratch.save(alive.select("anchor", "head.key", "head.id", "head.n"), "alive")
    contested = alive.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum(F.expr(f"n + {window - 1}")).alias("bytes")).filter("m > 1")
    contested = scratch.save(contested.drop("m"), "contested")
    heads = scratch.save(alive.join(contested, "anchor").select("key", "id"), "heads")
    bits = bloom.filter_bits(heads.count())
    wanted = bloom.share(spark, bloom.build(heads, "key", bits), bits)
    holder = heads.select("id").distinct().mapInArrow(_mixed_ids, "id long")
    holders = bloom.share(spark, bloom.build(holder, "id", bits), bits)
    found = docs.mapInArrow(
        lambda it: _heads(it, window, gram, wanted, holders), "anchor long, key long, id long, at long, segment binary"
    )
    # the filter lets strangers through: exact joins on the segment's key and the anchor's size
    found = scratch.save(found.join(heads.select("key", "id").distinct(), ["key", "id"], "left_semi").join(contested, "anchor"), "found")
    total = found.filter(f"bytes <= {hot}").agg(F.sum(F.length("segment"))).first()[0] or 0
    buckets = int(total) // BUCKET + 1
    ordinary = (
        found.filter(f"bytes <= {hot}")
        .select(F.expr(f"pmod(xxhash64(anchor), {buckets})").alias("bucket"), "id", "at", "segment")
        .repartition(buckets // 8 + 1, "bucket")  # few bytes but much work: not to be joined into fewer tasks
        .groupBy("bucket").applyInArrow(_bucket_spans(window), "id long, s long, e long")
    )
    crowded = scratch.save(
        found.filter(f"bytes > {hot}").select("id", "at", "segment").mapInArrow(lambda it: _windows(it, window), "w1 long, w2 long, id long, at long"),
        "crowded",
    )
    twice = crowded.groupBy("w1", "w2").count().filter("count > 1")
    met = crowded.join(twice, ["w1", "w2"], "left_semi").select("id", F.col("at").alias("s"), F.expr(f"at + {window}").alias("e"))
    spans = copied.union(ordinary).union(met).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = scratch.save(spans, "spans")
    scratch.forget(repeated, segments, classes, alive, contested, heads, found, crowded)
    return spans


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(batch.column(1).cast(pa.binary()), batch.column(2)):
            have = text.as_py() or b""
            n_bytes.append(len(have))
            gone = runs = 0
            if spans.is_valid:
                flat = spans.values.flatten()
                starts, ends = merged(flat[0].to_numpy(), flat[1].to_numpy())
                gone, runs = int((ends - starts).sum()), starts.size
                borders = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(have)]
                have = b"".join(have[a:b] for a, b in zip(borders[::2], borders[1::2]))
            n_removed.append(gone)
            n_spans.append(runs)
            kept.append(have)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_bytes"],
        )


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 400, gram: int = 300
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_bytes)`` for every row of ``docs``.

    A byte of the UTF-8 text goes if a string of ``window`` bytes covers it that also starts at another place of
    any text, the same one included; strings are those of the input.  ``n_spans`` counts maximal
    removed runs.  ``kept_bytes`` may end inside a character.  Null counts as empty.  Ids must be
    unique integers; a row with a null id neither loses bytes nor makes others lose any.  Other
    columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        spans = repeated_spans(texts.filter("id is not null"), window, gram, scratch)
    bits = bloom.filter_bits(spans.count())
    pages = scratch.save(bloom.build(spans.select(F.xxhash64("id").alias("k")), "k", bits), "holders")
    looked = bloom.probe(texts, F.xxhash64("id"), pages, bits, "hit")
    same = looked.filter("not hit").select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    cut = looked.filter("hit").join(spans, "id", "left").select("id", "text", "spans")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary"
    return same.mapInArrow(_cut, schema).union(cut.mapInArrow(_cut, schema)).withColumnRenamed("id", id_col)
