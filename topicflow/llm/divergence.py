"""Which sources of a language write differently: words counted by sorting pointers to their starts.

A task holds the words of some texts as pointers into the Arrow buffer and sorts the pointers, not the words: a multikey
quicksort whose "character" is eight bytes.  A slice is sorted by the eight bytes at its depth; of the result, runs that
are still equal and go on are slices of the next depth.  Equal runs of the final order are the terms of the shard; the
texts that their pointers lie in give occurrences and numbers of documents per source.  Shards meet in one aggregate.

A term is kept in a language if ``min_docs`` of the language's documents have it.  With N occurrences of V kept terms in a
group (a source of a language, or the language), a term's share is ``p = 1 + floor(scale * (count + 2) / (N + 2 V))``, and two
groups differ on it by ``floor((p - q)^2 / (p + q))``.  All of it is whole numbers.

* ``pair`` rows: every other source of the language, by the difference summed over all kept terms.
* ``term`` rows: the ``top`` terms that the source uses more than its language.

Summing over pairs costs (counted cells) x (sources), not terms x sources^2: where both counts are zero the difference is
one number per pair, which is multiplied by the number of such terms.  Work is cut into (block of sources, block of
sources, shard of terms), so no task holds a language or a source.

Defined results.  Null text, language and source count as empty strings, and an empty source is a source like others.  A
group without terms takes part with counts of zero; without kept terms all pairs have the value 0.  Equal values go by
the item's UTF-8 bytes.  A language of one source has no pairs.  Repeated rows are repeated documents.  An empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicflow.llm.words import pieces
from topicflow.scratch import Scratch, broadcast_checked

#: Bytes of text whose pointers are sorted together (a longer text is a shard of its own).
SHARD = 8 << 20
#: Depth, in bytes, at which slices of very long words are left to a comparison of the rest.
DEEP = 128
#: Sources of a block, on average, and counted cells of a shard of terms.
SOURCES, CELLS = 128, 1 << 18
#: Numbers of a dense piece of (terms x sources).
DENSE = 1 << 20

# fixed values: terms are [^\x00-\x40\x5B-\x60\x7B-\x7F]+
_TERM = np.zeros(256, bool)
_TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def word_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every term in the buffer, and the text that it lies in."""
    inside = np.zeros(data.size + 2, bool)
    inside[1:-1] = _TERM[data]
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # a text border inside a run of term bytes cuts it
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < data.size)])
    cut = cut[inside[cut] & inside[cut + 1]]
    if cut.size:
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _symbols(text: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes from every pointer as one number; zeros stand behind the end of the word."""
    rest = np.clip(end - at, 0, 8)
    symbol = text[np.minimum(at, text.size - 1)].astype(np.uint64)
    drop = ((8 - np.maximum(rest, 1)) * 8).astype(np.uint64)
    return np.where(rest > 0, (symbol >> drop) << drop, np.uint64(0))


def pointer_sort(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the words by their bytes, and for every place of it whether a new word begins there."""
    n = start.size
    padded = np.zeros(data.size + 8, np.uint8)
    padded[: data.size] = data
    # every place of the buffer as the big-endian number of its eight bytes
    text = np.ndarray(data.size + 1, ">u8", padded, strides=(1,))
    order = np.argsort(_symbols(text, start, end))
    symbol = _symbols(text, start[order], end[order])
    fresh = np.ones(n, bool)
    fresh[1:] = symbol[1:] != symbol[:-1]
    places, depth = np.arange(n), 8
    while places.size:
        # slices: runs of equal words so far, of which some go on
        first = np.flatnonzero(fresh[places])
        size = np.diff(np.append(first, places.size))
        longer = np.maximum.reduceat(end[order[places]] - start[order[places]], first) > depth
        places = places[np.repeat((size > 1) & longer, size)]
        if not places.size:
            break
        which = np.cumsum(fresh[places])
        words = order[places]
        if depth >= DEEP:
            _compare(data, start, end, order, fresh, places, depth)
            break
        symbol = _symbols(text, start[words] + depth, end[words])
        by = np.lexsort((symbol, which))
        order[places] = words[by]
        symbol = symbol[by]
        fresh[places[1:]] |= symbol[1:] != symbol[:-1]
        depth += 8
    return order, fresh


def _compare(data, start, end, order, fresh, places, depth) -> None:
    """Slices whose words agree in their first ``depth`` bytes, sorted by what follows."""
    first = np.flatnonzero(fresh[places])
    for a, b in zip(first, np.append(first[1:], places.size)):
        rest = sorted((data[start[w] + depth : end[w]].tobytes(), w) for w in order[places[a:b]])
        order[places[a:b]] = [w for _, w in rest]
        fresh[places[a + 1 : b]] = [x[0] != y[0] for x, y in zip(rest[1:], rest)]


def count_runs(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per (term, group): the term's number, the group, occurrences, documents; then start and end of every term."""
    start, end, text = word_starts(data, offsets)
    if not start.size:
        none = np.zeros(0, np.int64)
        return none, none, none, none, start, end
    order, fresh = pointer_sort(data, start, end)
    # texts numbered group by group, so that one sort of (run, text) also brings a run's groups together
    by_group = np.argsort(group, kind="stable")
    rank = np.empty_like(by_group)
    rank[by_group] = np.arange(by_group.size)
    run = np.cumsum(fresh) - 1
    n_texts = group.size
    key = np.sort(run * n_texts + rank[text[order]])
    opens = np.append(True, key[1:] != key[:-1])
    document = np.flatnonzero(opens)
    run_of, group_of = key[document] // n_texts, group[by_group[key[document] % n_texts]]
    cell = np.append(True, (run_of[1:] != run_of[:-1]) | (group_of[1:] != group_of[:-1]))
    at = np.flatnonzero(cell)
    documents = np.diff(np.append(at, document.size))
    occurrences = np.diff(np.append(document[at], key.size))
    word = order[np.flatnonzero(fresh)]
    return run_of[at], group_of[at], occurrences, documents, start[word], end[word]


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The words as an Arrow array."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.LargeStringArray.from_buffers(size.size, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[places]))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        code = lang.indices.to_numpy() * np.int64(len(source.dictionary)) + source.indices.to_numpy()
        for row, data, offsets in pieces(batch.column("text"), SHARD):
            texts = slice(row, row + offsets.size - 1)
            data = _LOWER[data]
            term, group, n, docs, start, end = count_runs(data, offsets, code[texts])
            if term.size:
                yield pa.RecordBatch.from_arrays(
                    [
                        lang.dictionary.take(pa.array(group // len(source.dictionary))),
                        source.dictionary.take(pa.array(group % len(source.dictionary))),
                        _strings(data, start, end).cast(pa.string()).take(pa.array(term)),
                        pa.array(n, pa.int64()),
                        pa.array(docs, pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )


def count_terms(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Occurrences ``n`` and documents ``docs`` of every term per (lang, source), one row for each shard that has it."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(to) for c, to in ((lang, "lang"), (source, "source"), (text, "text"))])
    return rows.mapInArrow(_count_batches, "lang string, source string, term string, n long, docs long")


def kept_cells(counted: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, term, source, n, n_lang)`` of the terms that ``min_docs`` documents of their language have."""
    # one exchange, by term; the sums per source need no other
    cells = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumn("n_docs", F.sum("docs").over(term)).withColumn("n_lang", F.sum("n").over(term))
    return cells.filter(F.col("n_docs") >= min_docs).select("lang", "term", "source", "n", "n_lang")


def _share(count: str, total: str, terms: str, scale: int) -> Column:
    """``1 + floor(scale * (count + 2) / (total + 2 * terms))`` of columns; the product may need more than 64 bits."""
    product = f"cast({count} + 2 AS decimal(20,0)) * cast({scale} AS decimal(18,0))"
    return F.expr(f"1 + ({product}) div cast({total} + 2 * {terms} AS decimal(20,0))")


def _shares(count: np.ndarray, total: int, terms: int, scale: int) -> np.ndarray:
    """The same of an array."""
    if count.size and int(count.max()) + 2 > (2**63 - 1) // scale:
        return np.array([1 + scale * (int(c) + 2) // (total + 2 * terms) for c in count], np.int64)
    return 1 + scale * (count + 2) // (total + 2 * terms)


def _difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


def _tile_sums(counts: np.ndarray, zero: np.ndarray, shares: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differences of every left and right source summed over the terms of ``counts``, less those of both being zero."""
    some = counts > 0

    def from_side(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Over the terms that a source of ``own`` has: all differences, those where both have it, and how many both have."""
        total, both, common = (np.zeros((own.size, other.size), np.int64) for _ in range(3))
        for k, source in enumerate(own):
            rows = np.flatnonzero(some[:, source])
            if rows.size:
                d = _difference(shares[rows, source][:, None], shares[np.ix_(rows, other)])
                shared = some[np.ix_(rows, other)]
                total[k], both[k], common[k] = d.sum(axis=0), (d * shared).sum(axis=0), shared.sum(axis=0)
        return total, both, common

    forth, both, common = from_side(left, right)
    back = forth if left is right else from_side(right, left)[0]
    either = some[:, left].sum(axis=0)[:, None] + some[:, right].sum(axis=0)[None, :] - common
    return forth + back.T - both - either * _difference(zero[left][:, None], zero[right][None, :])


def _tile(scale: int):
    """Differences between the sources of two blocks over one shard of terms."""

    def run(key: tuple, groups: pa.Table, cells: pa.Table) -> pa.Table:
        lang, i, j, shard = (k.as_py() for k in key)
        if not groups.num_rows:
            return _PAIRS.empty_table()
        names = groups["source"].combine_chunks()
        block = groups["block"].to_numpy()
        totals, terms = groups["total"].to_pylist(), groups["terms"][0].as_py()
        zero = np.array([_shares(np.zeros(1, np.int64), t, terms, scale)[0] if terms else 1 for t in totals], np.int64)
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        # terms without a count on either side differ by the same number; it is counted once, with the first shard
        sums = _difference(zero[left][:, None], zero[right][None, :]) * (terms if shard == 0 else 0)
        if cells.num_rows:
            source = pc.index_in(cells["source"], names).to_numpy()
            count = cells["n"].to_numpy()
            share = np.empty_like(count)
            for s in np.unique(source):
                share[source == s] = _shares(count[source == s], totals[s], terms, scale)
            term = cells["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            by = np.argsort(term, kind="stable")
            step = max(1, DENSE // len(names))
            for low in range(0, int(term.max()) + 1, step):
                part = by[slice(*np.searchsorted(term[by], (low, low + step)))]
                at = (term[part] - low, source[part])
                counts = np.zeros((int(at[0].max()) + 1, len(names)), np.int64)
                counts[at] = count[part]
                shares = np.broadcast_to(zero, counts.shape).copy()
                shares[at] = share[part]
                sums = sums + _tile_sums(counts, zero, shares, left, right)
        a, b = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        value = sums.ravel()
        if i != j:
            a, b, value = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([value, value])
        other = a != b
        a, b, value = a[other], b[other], value[other]
        return pa.table([pa.array([lang] * a.size, pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(value)], schema=_PAIRS)

    return run


_PAIRS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).cast("int").alias("rank"))


def source_divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = 10,
    top: int = 10,
    scale: int = 1_000_000_000,
    sources: int = SOURCES,
    shard_cells: int = CELLS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: other sources (``pair``) and typical terms (``term``) of every source."""
    scratch = Scratch(docs.sparkSession, "divergence")
    cells = scratch.save(kept_cells(count_terms(docs, lang, source, text), min_docs), "cells")
    groups = docs.select(F.coalesce(F.col(lang), F.lit("")).alias("lang"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    per_source = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a language's terms: each is counted at its first source
    per_lang = cells.groupBy("lang").agg(
        F.count_distinct("term").alias("terms"), F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("cells")
    )
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(per_lang, "lang", "left").fillna(0)
    langs = scratch.save(
        langs.select(
            "lang", "terms", "lang_total",
            F.ceil(F.col("sources") / sources).alias("blocks"),
            F.greatest(F.ceil(F.col("cells") / shard_cells), F.lit(1)).alias("shards"),
        ),
        "langs",
    )
    groups = groups.join(per_source, ["lang", "source"], "left").fillna(0, ["total"])
    groups = scratch.save(groups.join(broadcast_checked(langs), "lang"), "groups")
    return _typical(cells, groups, top, scale).unionByName(_pairs(cells, langs, groups, scale))


def _typical(cells: DataFrame, groups: DataFrame, top: int, scale: int) -> DataFrame:
    known = cells.join(broadcast_checked(groups.drop("blocks", "shards")), ["lang", "source"])
    shares = known.select(
        "lang", "source", F.col("term").alias("item"),
        _share("n", "total", "terms", scale).alias("p"), _share("n_lang", "lang_total", "terms", scale).alias("q"),
    )
    more = shares.filter("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    return _ranked(more, "term").filter(F.col("rank") <= top)


def _pairs(cells: DataFrame, langs: DataFrame, groups: DataFrame, scale: int) -> DataFrame:
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    keys = ["lang", "i", "j", "shard"]

    def tiled(df: DataFrame) -> DataFrame:
        """A copy of every row for each block that its own meets; one block, one copy."""
        other = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return other.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    cells = cells.join(broadcast_checked(langs.select("lang", "blocks", "shards")), "lang")
    cells = cells.withColumns({"block": block, "shard": F.pmod(F.xxhash64("term"), F.col("shards"))})
    left = tiled(groups.withColumn("block", block)).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    left = left.select(*keys, "source", "block", "total", "terms")
    right = tiled(cells).select(*keys, "term", "source", "n")
    sums = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(_tile(scale), "lang string, source string, item string, value long")
    return _ranked(sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair")
