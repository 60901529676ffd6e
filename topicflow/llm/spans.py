"""Seeds shared by the two substring dedups: winnowed anchors and the windows that select them.

A window of fixed length selects its smallest n-gram (leftmost of equals), so equal
windows select the same n-gram at the same place: two documents that share a window share its
anchor.  The windows that select one anchor occurrence are consecutive.
"""

from __future__ import annotations

import numpy as np

from topicflow.llm import words


def anchors(values: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(doc, start, count, place, hash)`` per anchor occurrence.

    ``values`` are symbols of several documents, ``first`` where each document starts (one entry more).
    Windows ``start .. start + count - 1`` of document ``doc`` select the n-gram at ``place``.
    """
    size = np.diff(first)
    n = values.size - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not (size >= window).any():
        return none, none, none, none, none.astype(np.uint64)
    at = np.arange(values.size - gram + 1)
    grams = words.runs_hash(values, at, at + gram, 1)
    place = words.window_minimum(grams, window - gram + 1)[:n]
    doc = np.repeat(np.arange(size.size), size)
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :])
    place, owner = place[whole], doc[whole]
    # a document's windows are consecutive; a new anchor or document starts a new run
    new = np.ones(whole.size, bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, whole.size))
    return owner[start], whole[start], count, place[start], grams[place[start]]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as maximal disjoint runs; touching ones join."""
    if not starts.size:
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > reach[:-1])
    return starts[np.append(0, cut + 1)], reach[np.append(cut, starts.size - 1)]
