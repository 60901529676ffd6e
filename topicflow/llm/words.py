"""Words of many texts at once: NumPy helpers used inside tasks.

Words are ``[^\\x20\\x09-\\x0D]+`` over UTF-8 bytes.  A word's 64-bit hash is a polynomial of its
bytes, taken from prefix sums over the whole buffer, then mixed with its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in pieces of about this many bytes (a longer text is a piece of its own).
PIECE = 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of each."""
    have = _powers.get(which)
    if have is None or have[0].size < n:
        base = _BASES[which]
        inverse = pow(base, -1, 1 << 64)
        size = max(n, 1 << 16)
        have = tuple(
            np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)])) for b in (base, inverse)
        )
        if size <= 4 << 20:
            _powers[which] = have
    return have


def runs_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of ``values[start:end]`` for every pair, whatever place it has."""
    power, inverse = powers(values.size + 1, which)
    total = np.empty(values.size + 1, np.uint64)
    total[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: values.size], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def pieces(texts: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` for runs of texts of about ``limit`` bytes; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each text's words begin (one more entry than texts)."""
    inside = ~_SPACE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A hash per word; ``lower`` lower-cases A-Z only."""
    return runs_hash(_LOWER[data] if lower else data, start, end)


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of every window of ``width`` values."""
    best, place, have = values, np.arange(values.size), 1
    while have < width:
        step = min(have, width - have)
        right, left = best[step:], best[: best.size - step]
        take = right < left
        place = np.where(take, place[step:], place[: place.size - step])
        best = np.where(take, right, left)
        have += step
    return place


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
