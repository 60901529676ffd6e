"""Best-fit packing of tokenised documents into sequences of bounded length.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths).  Each
piece goes to the open sequence in which it fits under every one of them and whose residual
vector suits it best: by weighted dot product with the piece's needs (the least leftover
in the direction that the piece uses), or by the smallest weighted residual norm.

A piece's needs depend on its length alone, so the plan is made on counts per length, of which there
are at most ``tokens``: sequences in the same state are planned together as ranges.  Tokenising,
counting, ranking and placing are Spark jobs over all pieces; the planner sees the bounded
histogram only.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicflow.llm.batches import small_batches
from topicflow.scratch import Scratch

#: Different words whose ids a Python worker remembers: at most about 120 MB.
REMEMBERED = 800_000
SALTS = 64
_tokenizers: dict = {}


def _encoder(path: str):
    """The tokenizer and this worker's ids of words seen so far."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path), {}
    return _tokenizers[path]


#: Marks that the tokenizer always parts from a letter or digit before them; none of them begins a contraction.
_TAIL = b".,;:!?"
#: Begins the tokenizer's special tokens, which are found before letters are lower-cased.
_SPECIAL = b"<|"


def _parts(word: bytes) -> tuple[bytes, bytes]:
    """A word and the marks at its end, where the tokenizer parts them for certain."""
    core = word.rstrip(_TAIL)
    return (core, word[len(core) :]) if core[-1:].isalnum() and _SPECIAL not in word else (word, b"")


def _remember(tokenizer, known: dict[bytes, bytes], new: set[bytes]) -> None:
    """Encode new words as one text and tell their ids apart by where they lie in it.  Words that differ in the marks
    at their end are encoded once."""
    parts = {w: _parts(w) for w in new}
    units = sorted({p for pair in parts.values() for p in pair if p and p not in known})
    ids_of = {b"": b""}
    if units:
        split = [w.decode() for w in units]
        starts = np.cumsum([0] + [len(w) + 1 for w in split[:-1]])
        code = tokenizer.encode(" ".join(split), add_special_tokens=False)
        ids = np.array(code.ids, "<u4")
        border = np.searchsorted(np.fromiter((o[0] for o in code.offsets), np.int64, ids.size), starts)
        whole, at = ids.tobytes(), (4 * np.append(border, ids.size)).tolist()
        ids_of.update((w, whole[x:y]) for w, x, y in zip(units, at, at[1:]))
    for word, pair in parts.items():
        core, tail = (known[p] if p in known else ids_of[p] for p in pair)
        known[word] = core + tail


def encode_words(path: str, texts: list[bytes]) -> list[np.ndarray]:
    """Ids of each text, as the tokenizer's own call gives them: special tokens written out in a text are special tokens.

    The tokenizer drops white space and never joins across it, and its special tokens hold none, so words are
    encoded once each.  It lower-cases, so A-Z are lower-cased first, but for texts that may hold a special token.
    """
    tokenizer, known = _encoder(path)
    split = [(text if _SPECIAL in text else text.lower()).split() for text in texts]
    words = set().union(*split) if split else set()
    new = words.difference(known)
    if len(known) + len(new) > REMEMBERED:
        # frequent words are among these texts' words: they stay
        kept = {w: known[w] for w in words if w in known}
        known.clear()
        known.update(kept)
    if new:
        _remember(tokenizer, known, new)
    return [np.frombuffer(b"".join(map(known.__getitem__, w)), "<u4") for w in split]


@dataclass(frozen=True)
class Capacity:
    tokens: int = 4096
    documents: int = 4096
    #: sum of squared piece lengths
    attention: int = 4096 * 4096

    def needs(self, length: int) -> tuple[float, float, float]:
        return length / self.tokens, 1 / self.documents, length * length / self.attention


def plan(
    counts: dict[int, int],
    capacity: Capacity,
    rule: str = "dot",
    weights: tuple[float, ...] = (1.0, 0.05, 0.05),
) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, how many, first sequence, offset)`` for every length and range of its pieces.

    Longer pieces go first.  Open sequences in one state (tokens, documents and attention used) are ranges of numbers.
    Of all states that a piece fits under every capacity the best by the rule is taken, of equal ones the fullest in tokens.
    No part of a score is negative, so states are left out whose share of tokens alone is no better than the best score.
    A length beyond any capacity and a negative weight raise ``ValueError``.
    """
    if min(weights) < 0:
        raise ValueError("weights must not be negative")
    limits = (capacity.tokens, capacity.documents, capacity.attention)
    opened: dict[int, dict[tuple[int, int], list[tuple[int, int]]]] = {}  # tokens -> (documents, attention) -> ranges
    levels: list[int] = []  # the tokens in use, sorted
    out, next_sequence = [], 0

    def put(tokens: int, documents: int, attention: int, span: tuple[int, int]) -> None:
        if tokens >= limits[0] or documents >= limits[1]:
            return  # nothing fits any more
        if tokens not in opened:
            opened[tokens] = {}
            insort(levels, tokens)
        opened[tokens].setdefault((documents, attention), []).append(span)

    def best_fit(length: int, square: int) -> tuple[int, int, int] | None:
        """The state with room for the piece that suits it best."""
        if rule == "dot":
            wt, wd, wa = (w * n for w, n in zip(weights, capacity.needs(length)))
        else:
            wt, wd, wa = weights
        found, least = None, float("inf")
        for k in range(bisect_right(levels, limits[0] - length) - 1, -1, -1):
            tokens = levels[k]
            left = 1 - (tokens + length) / limits[0]
            part = wt * (left if rule == "dot" else left * left)
            if part >= least:
                break  # emptier sequences only score worse
            for documents, attention in opened[tokens]:
                if documents < limits[1] and attention + square <= limits[2]:
                    d, a = 1 - (documents + 1) / limits[1], 1 - (attention + square) / limits[2]
                    score = part + (wd * d + wa * a if rule == "dot" else wd * d * d + wa * a * a)
                    if score < least:
                        found, least = (tokens, documents, attention), score
        return found

    for length in sorted(counts, reverse=True):
        square = length * length
        if length > limits[0] or limits[1] < 1 or square > limits[2]:
            raise ValueError(f"a piece of {length} tokens passes a capacity")
        rank, left = 0, counts[length]
        while left:
            best = best_fit(length, square)
            if best is None:
                # new sequences hold as many of this length as fit
                per = min(limits[0] // length, limits[1], limits[2] // square, left)
                n = left // per
                for k in range(per):
                    out.append((length, rank, n, next_sequence, k * length))
                    rank += n
                put(per * length, per, per * square, (next_sequence, n))
                next_sequence += n
                left -= n * per
                continue
            tokens, documents, attention = best
            spans = opened[tokens][documents, attention]
            first, n = spans.pop()
            take = min(n, left)
            if take < n:
                spans.append((first + take, n - take))
            elif not spans:
                del opened[tokens][documents, attention]
                if not opened[tokens]:
                    del opened[tokens]
                    levels.pop(bisect_left(levels, tokens))
            out.append((length, rank, take, first, tokens))
            put(tokens + length, documents + 1, attention + square, (first, take))
            rank += take
            left -= take
    return out


def tokenised_pieces(docs: DataFrame, tokenizer: str, tokens: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])``: documents as ids, cut where longer than a sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = [[] for _ in range(5)]
            texts = [text or b"" for text in batch.column(1).cast(pa.binary()).to_pylist()]
            for doc, found in zip(batch.column(0).to_pylist(), encode_words(tokenizer, texts)):
                ids = np.concatenate([found, end])
                for piece, start in enumerate(range(0, ids.size, tokens)):
                    part = ids[start : start + tokens]
                    for column, value in zip(rows, (doc, piece, start, part.size, zlib.crc32(part.tobytes()))):
                        column.append(value)
                    if with_ids:
                        rows[5:] = [[*(rows[5] if len(rows) > 5 else []), part.astype(np.int32)]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(r, k) for r, k in zip(rows, kinds)]
            if with_ids:
                arrays.append(pa.array(rows[5] if len(rows) > 5 else [], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(
        cut, "id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: Capacity = Capacity(),
    rule: str = "dot",
    weights: tuple[float, ...] = (1.0, 0.05, 0.05),
    end_id: int = 1,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, a row per piece of every document.

    A document is its token ids and ``end_id``; null and empty texts are ``end_id`` alone.  Longer documents are cut
    every ``capacity.tokens``.  Within a sequence pieces lie without gaps from 0.  Rows that repeat an id or
    have none are packed like others.  Other columns are not read.  ``with_ids`` adds the ids themselves.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = tokenised_pieces(docs, tokenizer, capacity.tokens, end_id, with_ids, id_col, text_col)
    # a length that very many pieces share is ranked in parts
    salt = F.expr(f"cast(pmod(xxhash64(id, piece), {SALTS}) as int)")
    with small_batches(spark):
        pieces = scratch.save(pieces.withColumn("salt", salt), "pieces")
    salted = pieces.groupBy("length", "salt").count()
    base = scratch.save(
        salted.withColumn("base", F.sum("count").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))), "counts"
    )
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    made = plan(counts, capacity, rule, weights)
    table = pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("length", "first", "n", "sequence", "offset"), zip(*made) if made else [[]] * 5)})
    slots = spark.createDataFrame(table).select(
        "length", "offset", F.explode(F.expr("sequence(0L, n - 1)")).alias("k"), "first", "sequence"
    ).select("length", F.expr("first + k").alias("rank"), F.expr("sequence + k").alias("sequence_id"), "offset")
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    offsets = base.select("length", "salt", F.coalesce("base", F.lit(0)).alias("base"))
    ranked = pieces.withColumn("local", local).join(F.broadcast(offsets) if len(counts) * SALTS <= 300_000 else offsets, ["length", "salt"])
    placed = ranked.withColumn("rank", F.expr("base + local")).join(slots, ["length", "rank"])
    return placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])
    )
