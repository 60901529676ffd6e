"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search walks over the normalised text and keeps, for the last ``longest`` characters only (no piece is
longer), the best path that ends at each place.  Whenever the backpointers of all these places run through
one boundary, the pieces before it are certain: their ids are committed and forgotten.  So memory is
bounded by the piece length, whatever the text's.

* Unigram models: the path of the highest total score, ties to the earliest start.
* BPE models: a token sequence is the merge result exactly if every two neighbours are (merging their joint text
  gives the same two).  Each place therefore has one valid last piece, which the search finds; the pair rule is
  cached.

White space becomes the leading mark of a piece.  Where no piece of the vocabulary reaches across the border before a
mark, all paths converge there, so chunks between marks are searched apart and remembered per worker.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: Chunks, and pairs of pieces, that a Python worker remembers: some 250 MB each at most; one stage of a query has them.
REMEMBERED, REMEMBERED_PAIRS = 1_000_000, 1_000_000
#: Ids whose texts are put together at once.
DECODED = 1 << 18
_UNIGRAM, _BPE = 1, 2
_loaded: dict = {}


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield tag >> 3, data[at : at + n]
            at += n


class Codec:
    """A model's vocabulary and the search over it; one per Python worker."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        import ahocorasick
        import sentencepiece

        model = model if model is not None else open(path, "rb").read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        trainer = next((v for k, v in _fields(model) if k == 2), b"")
        self.kind = next((v for k, v in _fields(trainer) if k == 3), _UNIGRAM)
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("word and character models are not supported")
        lib = self.library
        n = lib.get_piece_size()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)}
        self.ids = {lib.id_to_piece(i): i for i in range(n) if i not in special}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.matches = ahocorasick.Automaton()
        for piece in self.ids:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = lib.is_byte(self.bytes[0])
        self.unknown = lib.unk_id()
        self.unknown_score = min(self.score.values()) - 10.0
        self.reaches_across = any(MARK in p.lstrip(MARK) for p in self.ids)
        self.chunks: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        output = [self._out(i) for i in range(n)]
        self.output_size = np.array([len(b) for b in output], np.int64)
        self.output_start = np.cumsum(self.output_size) - self.output_size
        self.output_bytes = np.frombuffer(b"".join(output), np.uint8)

    def _out(self, i: int) -> bytes:
        lib = self.library
        if lib.is_control(i):
            return b""
        if lib.is_unknown(i):
            return " ⁇ ".encode()
        if lib.is_byte(i):
            return bytes([int(lib.id_to_piece(i)[3:5], 16)])
        return lib.id_to_piece(i).replace(MARK, " ").encode()

    def _merged(self, text: str) -> list[str]:
        """Plain BPE of a short text: best-scored neighbour pair first, leftmost of equals."""
        parts, score = list(text), self.score.get
        joined = [score(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, k = None, -1
            for j, worth in enumerate(joined):
                if worth is not None and (best is None or worth > best):
                    best, k = worth, j
            if k < 0:
                return parts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del joined[k]
            if k:
                joined[k - 1] = score(parts[k - 1] + parts[k])
            if k < len(joined):
                joined[k] = score(parts[k] + parts[k + 1])

    def _fit(self, left: str, right: str) -> bool:
        """Whether ``right`` may follow ``left`` (empty: stand first) in a merge result; remembered."""
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        found = self.pairs[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return found

    def pieces(self, text: str) -> Iterator[str]:
        """Pieces of normalised text, committed as soon as all surviving paths agree on them."""
        longest, bpe, score, pairs = self.longest, self.kind == _BPE, self.score, self.pairs
        # of places base .. now: last piece of the best path that ends there (None: no path), and its score
        base, last, total = 0, [""], [0.0]
        found = self.matches.iter(text)
        end, piece = next(found, (len(text), ""))
        for now in range(1, len(text) + 1):
            best, best_score, single = None, -math.inf, False
            while end < now:  # pieces that end here, the longest first
                single = len(piece) == 1
                at = now - len(piece) - base
                before = last[at] if at >= 0 else None
                if before is not None:
                    if bpe:
                        if best is None:
                            fits = pairs.get((before, piece))
                            if self._fit(before, piece) if fits is None else fits:
                                best, best_score = piece, 0.0
                    elif total[at] + score[piece] > best_score:
                        best, best_score = piece, total[at] + score[piece]
                end, piece = next(found, (len(text), ""))
            if not single and last[-1] is not None:  # a character that is no piece stands for itself
                alone = text[now - 1]
                if bpe:
                    if best is None and self._fit(last[-1], alone):
                        best, best_score = alone, 0.0
                elif total[-1] + self.unknown_score > best_score:
                    best, best_score = alone, total[-1] + self.unknown_score
            last.append(best)
            total.append(best_score)
            if now - base >= 4 * longest:
                # every later piece starts at one of these places; walk all of them back to where they meet
                places = {p for p in range(now - longest + 1, now + 1) if last[p - base] is not None}
                while len(places) > 1:
                    far = max(places)
                    places.remove(far)
                    places.add(far - len(last[far - base]))
                meet = places.pop()
                out, at = [], meet
                while at > base:
                    out.append(last[at - base])
                    at -= len(out[-1])
                yield from reversed(out)
                last, total = last[meet - base :], [t - total[meet - base] for t in total[meet - base :]]
                base = meet
        out, at = [], len(text)
        while at > base:
            out.append(last[at - base])
            at -= len(out[-1])
        yield from reversed(out)

    def _ids(self, text: str) -> bytes:
        out: list[int] = []
        for piece in self.pieces(text):
            found = self.ids.get(piece)
            if found is not None:
                out.append(found)
            elif self.has_bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        plain = self.library.normalize(text)
        if self.reaches_across:
            return np.frombuffer(self._ids(plain), "<u4")
        chunks = re.findall(f"{MARK}*[^{MARK}]*", plain)
        known = self.chunks
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, chunks)), "<u4")
        except KeyError:
            if len(known) > REMEMBERED:
                # frequent chunks come again in this text: they stay
                kept = {c: known[c] for c in chunks if c in known}
                known.clear()
                known.update(kept)
            for chunk in chunks:
                if chunk not in known:
                    # a very long chunk is not worth remembering, but its bytes are needed once
                    known[chunk] = self._ids(chunk)
            found = b"".join(map(known.__getitem__, chunks))
            for chunk in chunks:
                if len(chunk) > 64:
                    known.pop(chunk, None)
            return np.frombuffer(found, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD, and the mark that encoding puts first goes."""
        return next(self.decode_all([ids]))

    def decode_all(self, lists: list[np.ndarray]) -> Iterator[str]:
        """The texts of several id arrays, whose bytes are gathered together."""
        done = 0
        while done < len(lists):
            stop, n = done + 1, lists[done].size
            while stop < len(lists) and n + lists[stop].size <= DECODED:
                n += lists[stop].size
                stop += 1
            own = lists[done:stop]
            ids = np.concatenate(own).astype(np.int64)
            size = self.output_size[ids]
            ends = np.concatenate([[0], np.cumsum(size)])
            data = self.output_bytes[np.arange(ends[-1]) + np.repeat(self.output_start[ids] - ends[:-1], size)].tobytes()
            borders = ends[np.concatenate([[0], np.cumsum([x.size for x in own])])]
            for a, b in zip(borders, borders[1:]):
                text = data[a:b].decode("utf-8", "replace")
                yield text[1:] if text[:1] == " " else text
            done = stop


def _codec(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _carried(df: DataFrame, out: str) -> str:
    if out in df.columns:
        raise ValueError(f"column {out} exists; name the result otherwise")
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def encode_texts(df: DataFrame, model: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the text's ids added as ``array<int>``.

    Null text gives null, empty text an empty array.  All other columns are carried along.  ``model`` is a
    path that every worker can open.  No shuffle.
    """
    at = df.columns.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts = batch.column(at).to_pylist()
                found = [None if t is None else codec.encode(t).astype(np.int32) for t in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return df.mapInArrow(encode, f"{_carried(df, out)}, `{out}` array<int>")


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids added.  Null gives null, null ids within an array are skipped, an id beyond the vocabulary raises."""
    at = df.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            none = np.zeros(0, np.int64)
            rows = [row.values.drop_null().to_numpy(zero_copy_only=False) if row.is_valid else None for row in batch.column(at)]
            texts = [t if r is not None else None for r, t in zip(rows, codec.decode_all([none if r is None else r for r in rows]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(decode, f"{_carried(df, out)}, `{out}` string")


def round_trip_digest(df: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_ids``, ``ids_crc32`` and ``decoded_sha256`` in place of the text, in one pass: the same as
    encoding, decoding and digesting in three, but ids and texts stay in the worker.  Null text gives nulls."""
    columns = [c for c in df.columns if c != text_col]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                valid = np.asarray(batch.column(at).is_valid())
                found = [codec.encode(t.as_py()) for t, ok in zip(batch.column(at), valid) if ok]
                digests = iter([hashlib.sha256(t.encode()).hexdigest() for t in codec.decode_all(found)])
                sizes, sums = iter([x.size for x in found]), iter([zlib.crc32(x.tobytes()) for x in found])
                filled = lambda values: [next(values) if ok else None for ok in valid]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in columns),
                        pa.array(filled(sizes), pa.int64()), pa.array(filled(sums), pa.int64()), pa.array(filled(digests), pa.string()),
                    ],
                    [*columns, "n_ids", "ids_crc32", "decoded_sha256"],
                )

    kinds = "".join(f"`{c}` {t}, " for c, t in df.dtypes if c != text_col)
    return df.mapInArrow(run, f"{kinds}n_ids long, ids_crc32 long, decoded_sha256 string")


def id_digest(df: DataFrame, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``n_ids`` and ``ids_crc32`` (little-endian unsigned 32-bit) in place of the ids; null ids give nulls."""
    columns = [c for c in df.columns if c != ids_col]
    at = df.columns.index(ids_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row.values.to_numpy(zero_copy_only=False).astype("<u4") if row.is_valid else None for row in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array([None if r is None else r.size for r in rows], pa.int64()),
                    pa.array([None if r is None else zlib.crc32(r.tobytes()) for r in rows], pa.int64()),
                ],
                [*columns, "n_ids", "ids_crc32"],
            )

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != ids_col)
    return df.mapInArrow(digest, f"{kinds}, n_ids long, ids_crc32 long")
