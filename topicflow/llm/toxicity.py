"""Toxicity by a linear-chain conditional random field over tokens.

Labels are per document, so token labels are derived first: word and prefix features are chosen one after
the other, each the one that explains most toxic documents not yet explained at the least
cost in clean ones.  Tokens of toxic documents that carry a chosen feature are labelled toxic.
A two-state chain with hashed word, prefix and suffix features is fitted to them by
maximum likelihood, and a small logistic layer turns token marginals to a document score.

Fitting reads a bounded sample: at most ``per_label`` different texts of either label, those with the
smallest id hashes.  Scoring is one narrow pass over all texts: exact forward-backward marginals, in blocks of
``BLOCK`` tokens whose transfer matrices are chained, so very long texts cost no more per token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicflow.llm import words

BITS = 18
BLOCK = 64
PREFIXES, SUFFIX = (4, 5, 6), 3

# letters, digits and all bytes of other characters make tokens
_TOKEN = np.zeros(256, bool)
_TOKEN[128:] = True
_TOKEN[[b for b in range(128) if chr(b).isalnum()]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def folded(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case; the number of bytes stays."""
    out = _FOLD[data]
    if data.size > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 32
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every token, and where each text's tokens begin."""
    inside = _TOKEN[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def token_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of word, prefixes and suffix: a row per token."""
    columns = [words.runs_hash(data, start, end)]
    columns += [words.runs_hash(data, start, np.minimum(start + k, end)) ^ np.uint64(k * 0x9E37) for k in PREFIXES]
    columns.append(words.runs_hash(data, np.maximum(end - SUFFIX, start), end) ^ np.uint64(0x5F5F))
    return np.stack(columns, axis=1)


def _slots(features: np.ndarray) -> np.ndarray:
    return (words.mix(features) >> np.uint64(64 - BITS)).astype(np.int32)


def explaining(features: list[np.ndarray], toxic: np.ndarray, cost: float = 3.0, share: float = 0.01, fewest: int = 6, most: int = 4) -> set[int]:
    """Features that together explain the toxic documents, chosen greedily by newly explained less ``cost`` times clean.

    A document weighs as often as it has the feature, up to ``most`` times, for what makes it toxic tends to recur.  Each
    choice must gain ``share`` of the number of toxic documents, and ``fewest`` at least.  Features that only repeat what others
    explain come in, too, if three in a hundred toxic documents have them (ten at least), and fifty times as many as clean ones.
    """
    n_toxic = int(toxic.sum())
    least = max(fewest, int(share * n_toxic))
    clean_docs: Counter = Counter()
    clean: Counter = Counter()
    left: dict[int, dict[int, int]] = {}
    for i, (f, t) in enumerate(zip(features, toxic)):
        kinds, often = np.unique(f[:, :-1], return_counts=True)
        weighed = dict(zip(kinds.tolist(), np.minimum(often, most).tolist()))
        if t:
            left[i] = weighed
        else:
            clean.update(weighed)
            clean_docs.update(weighed.keys())
    gain: Counter = Counter()
    holders: dict[int, list[int]] = {}
    for i, weighed in left.items():
        gain.update(weighed)
        for x in weighed:
            holders.setdefault(x, []).append(i)
    gain = Counter({x: n for x, n in gain.items() if n >= least and n > cost * clean[x]})
    often = max(10, 0.03 * n_toxic)
    chosen = {x for x, h in holders.items() if len(h) >= often and len(h) > 50 * clean_docs[x]}
    while gain:
        best = max(gain, key=lambda x: (gain[x] - cost * clean[x], -x))
        if gain[best] < least or gain[best] <= cost * clean[best]:
            break
        chosen.add(best)
        for i in holders[best]:
            for x, n in left.pop(i, {}).items():
                if x in gain:
                    gain[x] -= n
        gain.pop(best)
    return chosen


@dataclass
class Chain:
    """Emission of the toxic state by feature slot, and the transition factors from (row) to (column)."""

    emission: np.ndarray
    bias: float
    move: np.ndarray
    layer: np.ndarray  # of the document score: bias, two highest marginals, sum of marginals

    def potentials(self, features: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.emission[_slots(features)].sum(axis=1) + self.bias, -30, 30))


def _grid(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of each text in rows of ``BLOCK`` (the rest -1), the text of each row, and where each value went."""
    size = np.diff(first)
    rows = -(-size // BLOCK)
    owner = np.repeat(np.arange(size.size), rows)
    start = np.concatenate([[0], np.cumsum(rows)])[:-1] * BLOCK
    at = np.repeat(start, size) + np.arange(values.size) - np.repeat(first[:-1], size)
    grid = np.full(int(rows.sum()) * BLOCK, -1.0)
    grid[at] = values
    return grid.reshape(-1, BLOCK), owner, at


def _normal(v: np.ndarray) -> np.ndarray:
    return v / v.sum(axis=-1, keepdims=True)


def _step(v: np.ndarray, x: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Messages ``v`` (..., state) moved over a token of potential ``x``; blank tokens change nothing."""
    w = v @ move
    w[..., 1] *= x if v.ndim == 2 else x[:, None]
    keep = (x < 0) if v.ndim == 2 else (x < 0)[:, None]
    return np.where(keep[..., None], v, w)


def marginals(x: np.ndarray, first: np.ndarray, move: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
    """Marginal of the toxic state per token; each text starts after a clean state.

    To ``moves``, if given, the expected numbers of moves from each state (row) to each (column) are added.
    """
    if not x.size:
        return np.zeros(0)
    grid, owner, at = _grid(x, first)
    n = len(grid)
    # transfer matrix of each block, up to a factor
    whole = np.tile(np.eye(2), (n, 1, 1))
    for k in range(BLOCK):
        whole = _step(whole, grid[:, k], move)
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    # chain the blocks of each text, the k-th blocks of all texts together
    head = np.searchsorted(owner, np.arange(owner[-1] + 1))
    nth = np.arange(n) - head[owner]
    enter, leave = np.zeros((n, 2)), np.ones((n, 2))
    enter[nth == 0] = (1.0, 0.0)
    by_nth = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])
    for rows in by_nth[1:]:
        enter[rows] = _normal((enter[rows - 1][:, None, :] @ whole[rows - 1])[:, 0])
    last = np.append(owner[1:] != owner[:-1], True)
    for rows in reversed(by_nth):
        inner = rows[~last[rows]]
        leave[inner] = _normal((whole[inner + 1] @ leave[inner + 1][:, :, None])[:, :, 0])
    forward = np.empty((n, BLOCK, 2))
    v = enter
    for k in range(BLOCK):
        v = _normal(_step(v, grid[:, k], move))
        forward[:, k] = v
    toxic = np.empty((n, BLOCK))
    v = leave
    for k in reversed(range(BLOCK)):
        both = forward[:, k] * v
        toxic[:, k] = both[:, 1] / both.sum(axis=1)
        xk = grid[:, k]
        w = v.copy()
        w[:, 1] *= np.abs(xk)
        if moves is not None:
            before = forward[:, k - 1] if k else enter
            joint = (before[:, :, None] * move * w[:, None, :])[xk >= 0]
            moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = np.where((xk < 0)[:, None], v, _normal(w @ move.T))
    return toxic.ravel()[at]


def _fit_chain(slots: np.ndarray, labels: np.ndarray, first: np.ndarray, rounds: int = 80, ridge: float = 1e-3) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood with a ridge, by Adam on all sequences at once."""
    weight, bias, move = np.zeros(1 << BITS), -3.0, np.zeros((2, 2))
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros(5), np.zeros(5)]
    inner = np.ones(labels.size, bool)
    inner[first[:-1][first[:-1] < labels.size]] = False
    before = np.zeros(labels.size, int)
    before[1:] = labels[:-1]
    before[~inner] = 0
    seen = np.zeros((2, 2))
    np.add.at(seen, (before, labels), 1)
    for k in range(1, rounds + 1):
        x = np.exp(np.clip(weight[slots].sum(axis=1) + bias, -30, 30))
        moves = np.zeros((2, 2))
        p = marginals(x, first, np.exp(move), moves)
        gap = p - labels
        slope = np.bincount(slots.ravel(), np.repeat(gap, slots.shape[1]), 1 << BITS) + ridge * labels.size / 1000 * weight
        small = np.append((moves - seen).ravel() + ridge * labels.size * move.ravel(), gap.sum())
        scale = 1 / max(1, labels.sum())
        for slot, g, rate in ((0, slope * scale, 0.15), (2, small * scale, 0.05)):
            moments[slot] = 0.9 * moments[slot] + 0.1 * g
            moments[slot + 1] = 0.99 * moments[slot + 1] + 0.01 * g**2
            change = rate * (moments[slot] / (1 - 0.9**k)) / (np.sqrt(moments[slot + 1] / (1 - 0.99**k)) + 1e-8)
            if slot == 0:
                weight -= change
            else:
                move -= change[:4].reshape(2, 2)
                bias -= change[4]
    return weight, bias, np.exp(move)


def _summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: 1, log-odds of the two highest marginals, logarithm of the marginals' sum; texts without tokens have none."""
    n = first.size - 1
    top, next_, total = np.zeros(n), np.zeros(n), np.zeros(n)
    some = np.flatnonzero(np.diff(first))
    if some.size:
        top[some] = np.maximum.reduceat(p, first[some])
        total[some] = np.add.reduceat(p, first[some])
        owner = np.repeat(np.arange(n), np.diff(first))
        highest = np.flatnonzero(p == top[owner])
        rest = p.copy()
        rest[highest[np.unique(owner[highest], return_index=True)[1]]] = 0
        next_[some] = np.maximum.reduceat(rest, first[some])
    odds = [np.log(x / (1 - x)) for x in (np.clip(top, 1e-6, 1 - 1e-6), np.clip(next_, 1e-6, 1 - 1e-6))]
    return np.stack([np.ones(n), *odds, np.log1p(total)], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
    return w


def fit_chain(texts: list[bytes], toxic: np.ndarray) -> Chain | None:
    """A chain from labelled texts; None if one of the labels is missing."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return None
    data = folded(np.frombuffer(b"".join(texts), np.uint8))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    start, end, first = tokens(data, offsets)
    features = token_features(data, start, end)
    chosen = explaining([features[a:b] for a, b in zip(first[:-1], first[1:])], toxic)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    marked = np.isin(features[:, :-1], np.array(sorted(chosen), np.uint64)).any(axis=1)
    labels = (marked & toxic[doc]).astype(int)
    if not labels.any():
        return None
    weight, bias, move = _fit_chain(_slots(features), labels, first)
    chain = Chain(weight.astype(np.float32), bias, move, np.zeros(4))
    chain.layer = _logistic(_summary(marginals(chain.potentials(features), first, move), first), toxic.astype(float))
    return chain


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int = 800, max_bytes: int = 32 << 20
) -> Chain | None:
    """A chain from at most ``per_label`` different texts of either label; null labels and texts are left out.

    Ids are taken in the order of their hashes, and texts as long as those before them in that order and they
    themselves have at most ``max_bytes`` bytes for the label.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    known = known.select("id", (F.col("y") != 0).cast("int").alias("y"), F.xxhash64("id").alias("hash"))
    # twice as many ids, since copies of a text count once; the first of each label are merged from the tasks' first ones
    first = [known.filter(F.col("y") == y).orderBy("hash", "id").limit(2 * per_label) for y in (0, 1)]
    picked = F.broadcast(first[0].union(first[1]))
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked, "id")
    once = rows.groupBy("text").agg(F.max("y").alias("y"), F.min(F.struct("hash", "id")).alias("nth"))
    before = W.partitionBy("y").orderBy("nth").rowsBetween(W.unboundedPreceding, 0)
    bounded = (
        once.filter(F.octet_length("text") <= max_bytes)
        .withColumn("n", F.count(F.lit(1)).over(before)).withColumn("bytes", F.sum(F.octet_length("text")).over(before))
        .filter((F.col("n") <= per_label) & (F.col("bytes") <= max_bytes))
    )
    got = sorted((r["y"], r["n"], r["text"]) for r in bounded.select("y", "n", "text").collect())
    return fit_chain([t.encode() for _, _, t in got], np.array([y for y, _, _ in got])) if got else None


def score_toxicity(docs: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(id, score, predicted, spans)`` for every row of ``docs``.

    ``spans`` lists offending runs of tokens as byte offsets ``(start, end)`` into the UTF-8 text with their highest
    marginal.  Null and empty texts, and texts without tokens, get the score of no evidence and no
    spans.  Without a chain (no usable labels) every score is 0.  Only id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for row, raw, offsets in words.pieces(batch.column(1)):
                n = offsets.size - 1
                out, spans = np.zeros(n), [[] for _ in range(n)]
                if known is not None:
                    data = folded(raw)
                    start, end, first = tokens(data, offsets)
                    p = marginals(known.potentials(token_features(data, start, end)), first, known.move)
                    out = 1 / (1 + np.exp(-np.clip(_summary(p, first) @ known.layer, -30, 30)))
                    high = np.flatnonzero(p >= threshold)
                    doc = np.searchsorted(first, high, "right") - 1
                    for t, d in zip(high.tolist(), doc.tolist()):
                        a, b = int(start[t] - offsets[d]), int(end[t] - offsets[d])
                        if spans[d] and spans[d][-1]["token"] == t - 1:
                            spans[d][-1].update(end=b, token=t, p=max(spans[d][-1]["p"], float(p[t])))
                        else:
                            spans[d].append({"start": a, "end": b, "p": float(p[t]), "token": t})
                plain = [[{k: s[k] for k in ("start", "end", "p")} for s in one] for one in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(out), pa.array((out >= 0.5).astype(np.int32)), pa.array(plain, span)],
                    ["id", "score", "predicted", "spans"],
                )

    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, score double, predicted int, spans array<struct<start:bigint,end:bigint,p:double>>"
    return source.mapInArrow(score, schema).withColumnRenamed("id", id_col)
