"""Language identification with error-correcting output codes.

Each language has a codeword of bits. One binary classifier over hashed
character n-grams predicts each bit. Loss-weighted decoding sums, for each
codeword, the logistic loss of every bit's margin, weighted by how reliable
that classifier was on that language, and takes the codeword of least loss.
A decision is flagged ambiguous where the two best codewords lie close together
or the predicted bits lie farther from every codeword than the code corrects.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.llm.common import Tables, extended, pieces_of, ship, texts_of

#: Buckets of hashed 1-, 2- and 3-grams.
BUCKETS = 4096

#: Different labelled texts of one language that training reads, and most languages that it learns.
ROWS_PER_LANGUAGE, MOST_LANGUAGES = 400, 256

#: Codes of up to this many languages hold every distinct column.
EXHAUSTIVE = 5

UNDETERMINED = "und"

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)
_SALTS = np.array([0x27D4EB2F, 0x165667B1, 0x2545F491], np.uint32)
_SHIFT = np.uint32(32 - BUCKETS.bit_length() + 1)

_tables: tuple[np.ndarray, np.ndarray] | None = None


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself if it is a letter or mark, else a space; and whether it is a letter."""
    global _tables
    if _tables is None:
        table, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LM":
                table[c], letter[c] = c, kind == "L"
        _tables = table, letter
    return _tables


def histogram(text: str) -> np.ndarray | None:
    """Unit-length square roots of n-gram counts of a whole text, or None without a letter (marks alone are none)."""
    table, letter = _letter_tables()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return None
    codes = table[points]
    space = codes == 32
    keep = ~space
    keep[1:] |= ~space[:-1]
    codes = codes[keep]
    counts = np.zeros(BUCKETS)
    for n in (1, 2, 3):
        if len(codes) < n:
            break
        mixed = np.full(len(codes) - n + 1, _SALTS[n - 1], np.uint32)
        for k in range(n):
            mixed += codes[k : len(codes) - n + 1 + k] * _MULTIPLIERS[k]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        counts += np.bincount(mixed >> _SHIFT, minlength=BUCKETS)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each of n languages.

    Up to :data:`EXHAUSTIVE` languages get all distinct, non-constant columns;
    more get the best of many random codes, by least distance of two rows.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        columns = [(1, *bits) for bits in itertools.product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(columns, float).T
    rng, width, best, most = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, width))
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray

    @property
    def corrects(self) -> int:
        """Bit errors that the code corrects."""
        apart = [int((a != b).sum()) for a, b in itertools.combinations(self.code, 2)]
        return (min(apart) - 1) // 2 if apart else 0

    def decode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score from 0 to 1, and ambiguity of each row."""
        if len(self.languages) == 1:
            return np.zeros(len(rows), int), np.ones(len(rows)), np.zeros(len(rows), bool)
        margins = rows @ self.weights + self.bias
        losses = np.stack([(np.logaddexp(0, -margins * word) * w).sum(1) for word, w in zip(self.code, self.reliability, strict=True)], 1)
        likely = np.exp(-(losses - losses.min(1, keepdims=True)) * self.code.shape[1])
        likely /= likely.sum(1, keepdims=True)
        best = losses.argmin(1)
        score = likely[np.arange(len(rows)), best]
        second = np.partition(likely, -2, axis=1)[:, -2]
        bits = np.where(margins >= 0, 1.0, -1.0)
        off = (bits != self.code[best]).sum(1)
        return best, score, (score - second < 0.2) | (off > self.corrects)


def fit(rows: np.ndarray, labels: list[str], rounds: int = 120, rate: float = 40.0, decay: float = 1e-5) -> Model:
    """One logistic classifier for each bit, by gradient descent with momentum."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) <= 1:
        return Model(languages, code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), np.ones_like(code))
    number = np.array([languages.index(x) for x in labels])
    bits = code[number].astype(np.float32)
    share = (1.0 / np.bincount(number)[number] / len(languages)).astype(np.float32)[:, None]
    weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    speed, speed_b = np.zeros_like(weights), np.zeros_like(bias)
    for _ in range(rounds):
        margins = rows @ weights + bias
        pull = share * bits / (1 + np.exp(np.clip(bits * margins, -30, 30)))
        speed = 0.9 * speed + rows.T @ pull - decay * weights
        speed_b = 0.9 * speed_b + pull.sum(0)
        weights += rate * speed * 0.1
        bias += rate * speed_b * 0.01
    right = (np.sign(rows @ weights + bias) == bits).astype(float)
    reliability = np.stack([right[number == i].mean(0) + 1e-6 for i in range(len(languages))])
    return Model(languages, code, weights, bias, reliability / reliability.sum(1, keepdims=True))


def train(docs: DataFrame, usable: Column, rows_per_language: int = ROWS_PER_LANGUAGE, text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on a bounded sample of the labelled rows for which ``usable`` holds.

    The sample takes ``rows_per_language`` different texts of each language,
    those of the least hashes, so it is the same for any partitioning and
    copies of a text count once, however many there are: a language keeps its
    texts beside one that is copied without end. Languages beyond
    MOST_LANGUAGES, by their number of different texts, ties alphabetically,
    are taken for dirty labels and not learned. Only n-gram histograms reach the
    driver: languages x rows x 8 KB at most. None without a usable row.
    """
    ship(docs.sparkSession)
    labelled = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    labelled = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text, F.lit(11)).alias("place"))
    texts = labelled.groupBy("lang", "place").agg(F.lit(1).alias("one"))
    common = texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).select("lang")
    least = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = texts.join(common, "lang", "left_semi").withColumn("nth", least).where(F.col("nth") <= rows_per_language).select("lang", "place")
    tables = Tables(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                out = [(language, h.astype(np.float16).tobytes()) for language, t in zip(texts_of(piece, "lang"), texts_of(piece), strict=True) if (h := histogram(t)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], names=["lang", "h"])

    try:
        sample = labelled.join(tables.cut(chosen, "chosen-texts"), ["lang", "place"], "left_semi").dropDuplicates(["lang", "place"])
        found = sample.select("lang", "text").mapInArrow(run, "lang string, h binary").dropDuplicates()
        got = sorted((r["lang"], bytes(r["h"])) for r in found.collect())
    finally:
        tables.clear()
    if not got:
        return None
    return fit(np.stack([np.frombuffer(h, np.float16).astype(np.float32) for _, h in got]), [language for language, _ in got])


def predict(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous from each whole text.

    A null text, a text without a letter, and every text under no model give
    ``und`` with score 0, not ambiguous. Equal texts get equal results. At
    equal losses the codeword of the language first in alphabetical order wins,
    and the two are flagged ambiguous. Columns of ``docs`` with the added names
    are replaced, all others kept (the text only with ``keep_text``). An empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x bits floats

    def make(piece: pa.RecordBatch) -> dict:
        held, texts = shared.value, texts_of(piece, text)
        n = len(texts)
        languages, scores, unclear = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n, bool)
        for at in range(0, n if held is not None else 0, 512):
            found = [(i, h) for i in range(at, min(n, at + 512)) if texts[i] and (h := histogram(texts[i])) is not None]
            if found:
                where = np.array([i for i, _ in found])
                best, score, ambiguous = held.decode(np.stack([h for _, h in found]))
                languages[where], scores[where], unclear[where] = np.array(held.languages, object)[best], score, ambiguous
        return {"lang_pred": languages.tolist(), "score": scores, "ambiguous": unclear}

    return extended(docs, {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}, make, text, () if keep_text else (text,))
