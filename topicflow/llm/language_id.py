"""Language ID by error-correcting output codes.

Every language has a codeword of +1 and -1.  One binary classifier per bit, logistic on hashed byte n-grams,
predicts that bit; loss-weighted decoding takes the codeword with the least total loss, bits weighing
as much as their classifiers deserve.  A text whose two nearest codewords are close is ambiguous.

Classifiers are fitted on at most ``per_lang`` labelled texts of each language, those with
the smallest id hashes; everything else reads all rows.  No row is shuffled but the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from topicflow.llm import words

#: Hashed 2-grams and 3-grams.
BINS = (1 << 10, 1 << 12)
WIDTH = sum(BINS)
#: Texts whose features a task holds at once: some 30 MB with what counting them takes.
ROWS = 400
UNKNOWN = "und"

# ASCII without letters counts as one kind of gap; bytes of other characters stay
_GAP = np.arange(256, dtype=np.uint32)
_GAP[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def features(texts: pa.Array) -> np.ndarray:
    """One row of n-gram shares (square roots, so that its length is 1 per n) for each text."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    out = np.zeros((len(lower), WIDTH), np.float32)
    for row, data, offsets in words.pieces(lower):
        n = offsets.size - 1
        letters = _GAP[data]
        doc = np.repeat(np.arange(n), np.diff(offsets))
        first = 0
        for size, bins in zip((2, 3), BINS):
            m = max(0, letters.size - size + 1)
            code = np.zeros(m, np.uint32)
            blank = np.ones(m, bool)
            for k in range(size):
                part = letters[k : k + m]
                code = (code ^ part) * np.uint32(0x01000193)
                blank &= part == 32
            code ^= code >> np.uint32(15)
            good = (doc[:m] == doc[size - 1 :]) & ~blank if m else blank
            at = doc[:m][good] * bins + (code[good] & np.uint32(bins - 1))
            count = np.bincount(at, minlength=n * bins).reshape(n, bins)
            total = np.maximum(count.sum(axis=1, keepdims=True), 1)
            out[row : row + n, first : first + bins] = np.sqrt(count / total)
            first += bins
    return out


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 per class: all splits in two for up to 7 classes, else random dense codes kept far apart."""
    if n <= 7:
        splits = [[1 if (s >> k) & 1 else -1 for k in range(n - 1)] for s in range(2 ** max(0, n - 1) - 1)]
        return np.array([[*s, 1] for s in splits], dtype=np.float64).reshape(-1, n).T
    rng = np.random.default_rng(seed)
    bits = 10 * int(np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, bits))
        if (abs(code.sum(axis=0)) == n).any():
            continue
        near = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        if near > apart:
            best, apart = code, near
    return best


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword, per text."""
        margin = x @ self.weight + self.bias
        return np.stack([np.logaddexp(0, -margin * word) @ self.trust for word in self.code], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, langs: list[str], rounds: int = 250, ridge: float = 1e-4) -> LanguageModel:
    code = codewords(len(langs))
    target = code[y]
    weight, bias = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1])
    share = 1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1)[y]
    share /= share.sum()
    first, second = np.zeros_like(weight), np.zeros_like(weight)
    for k in range(1, rounds + 1):
        margin = x @ weight + bias
        push = -target / (1 + np.exp(np.clip(margin * target, -30, 30))) * share[:, None]
        slope = x.T @ push.astype(np.float32) + ridge * weight
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        weight -= 0.05 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-8)
        bias -= 2.0 * push.sum(axis=0)
    right = ((x @ weight + bias) * target > 0).T @ share
    trust = np.maximum(np.log((right + 1e-3) / (1 - right + 1e-3)), 0.05)
    return LanguageModel(langs, code, weight, bias, trust / trust.sum())


def fit_languages(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = 500) -> LanguageModel | None:
    """Classifiers from labelled rows with a text; None if there is no such row."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.select("id", "lang").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= per_lang)
    # at most per_lang rows of each language, so the ids are few enough to broadcast
    chosen = rows.join(F.broadcast(picked.drop("nth").distinct()), ["id", "lang"], "left_semi").select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = features(batch.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in flat], pa.binary())], ["lang", "x"]
            )

    got = chosen.mapInArrow(counted, "lang string, x binary").toArrow()
    if not got.num_rows:
        return None
    lang = got["lang"].to_pylist()
    langs = sorted(set(lang))
    x = np.frombuffer(b"".join(got["x"].to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    order = np.lexsort((x[:, 0], np.array(lang)))  # rows arrive in any order
    y = np.searchsorted(langs, lang)
    if len(langs) == 1:
        return LanguageModel(langs, np.ones((1, 0)), np.zeros((WIDTH, 0), np.float32), np.zeros(0), np.zeros(0))
    return _fit(x[order], y[order], langs)


def predict_languages(
    docs: DataFrame, model: LanguageModel | None, text_col: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "ambiguous"), margin: float = 0.05
) -> DataFrame:
    """``docs`` with a language, a score from 0 to 1 and an ambiguity flag added.

    Text that is null or has no letter gets ``und``, score 0, not ambiguous; so does all text without a
    model.  The score is the share of the nearest codeword in a softmax of the negative losses
    (their sharpness fixed); a lead of less than ``margin`` in loss over the next is ambiguous.
    All columns are carried; ``out`` names the new ones, which must not exist yet.
    """
    clash = set(out) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; name the results otherwise")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                text = batch.column(at)
                n = batch.num_rows
                letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                lang, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.zeros(n, bool)
                if known is not None and letter.any():
                    loss = known.losses(features(text.filter(pa.array(letter))))
                    best = loss.argmin(axis=1)
                    least = loss.min(axis=1)
                    chance = np.exp(-20 * (loss - least[:, None]))
                    lang[letter] = np.array(known.langs, object)[best]
                    score[letter] = 1 / chance.sum(axis=1)
                    if len(known.langs) > 1:
                        unsure[letter] = np.partition(loss, 1, axis=1)[:, 1] - least < margin
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], [*batch.schema.names, *out]
                )

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(predict, f"{fields}, `{out[0]}` string, `{out[1]}` double, `{out[2]}` boolean")
