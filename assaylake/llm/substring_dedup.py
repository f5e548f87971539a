"""Substring dedup by sliding sentence spans.

A sentence ends after a newline, or after ``.``, ``!`` or ``?`` before white
space. Every run of SPAN consecutive sentences is hashed. All runs of the
corpus meet by hash; a run that occurs more than once keeps its first
occurrence, by document and place, and every sentence that a later occurrence
covers is removed, within a document as well as across documents.

With ``every_length`` sentences of more than LONG words are cut into pieces at
words that their hashes choose, so the same passage is cut alike in whatever
sentence it lies. Beside the runs of SPAN sentences, the shortest runs of
MIN_WORDS words from each piece on, and up to each piece, are hashed: one
piece, or many short lines. Every piece of a repeated passage lies in one.

Only hashes and places are exchanged. Counts and first places are aggregated
on the map side before the exchange, so a passage that a third of all documents
share arrives as one row from each task. The repeated hashes are written as a
table; the join of all runs with it has an exchange of its own on both sides,
so that Spark splits its skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import cut, extended, pieces_of, ship, texts_of

#: Consecutive sentences in a run, and the words that a run must have to count.
SPAN = 2
MIN_WORDS = 12

#: Sentences of more words are cut into pieces of LEAST_PIECE to LONG words, after one word in CUT_EVERY.
LONG, LEAST_PIECE, CUT_EVERY = 24, 4, 8

#: A row is known by 128 bits of its id and text.
ROW = ("row_key", "row_check")

RUNS = "row_key long, row_check long, doc_id long, at int, size int, hash long, check int"

#: Characters of texts that are cut at once.
CHARS = 500_000

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)

_tables: tuple[np.ndarray, np.ndarray] | None = None
_powers: dict[int, np.ndarray] = {}


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case, where that is one code point, and whether it is white space."""
    global _tables
    if _tables is None:
        lower, space = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
        for c in map(chr, range(0x110000)):
            if c != (low := c.lower()) and len(low) == 1:
                lower[ord(c)] = ord(low)
            space[ord(c)] = c.isspace()
        _tables = lower, space
    return _tables


def _grown(base: int, n: int) -> np.ndarray:
    """Powers of an odd base, modulo 2**64, at least n of them."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = _powers[base] = np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64).cumprod(dtype=np.uint64)])
    return held


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Cut:
    """Texts cut into words, sentences and units, as arrays over all of them.

    ``hashes``: two 64-bit hashes of each word in lower case. ``first``: the
    first word of each unit, and the number of words at the end. ``starts``: the
    code point of its text where each unit begins. ``owners``: the sentence of
    each unit, numbered through all texts. ``places``: the first unit of each
    text, and the number of units at the end. A unit is a sentence, or with
    ``every_length`` a piece of one; null texts have none.
    """

    def __init__(self, texts: list[str | None], every_length: bool):
        lower, space = _char_tables()
        self.texts = [t or "" for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in self.texts])])  # a newline parts two texts
        points = np.frombuffer("\n".join([*self.texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = ~space[points]
        turns = np.flatnonzero(np.concatenate([inside[:1], inside[1:] != inside[:-1]]))
        starts, ends = turns[::2], turns[1::2]
        n, size = len(starts), ends - starts
        at = np.cumsum(size) - size
        letters = lower[points[inside]].astype(np.uint64) + np.uint64(1)
        place = np.arange(len(letters)) - at.repeat(size)
        longest = int(size.max(initial=0))
        if n:
            self.hashes = [_mixed(np.add.reduceat(letters * _grown(int(base), longest)[place], at) + size.astype(np.uint64)) for base in (_P, _Q)]
        else:
            self.hashes = [np.zeros(0, np.uint64)] * 2
        # a sentence ends before white space with a newline in it, or that follows an end mark
        lines, mark = np.concatenate([[0], np.cumsum(points == 10)]), points[ends[:-1] - 1]
        stops = (mark == 33) | (mark == 46) | (mark == 63) | (lines[starts[1:]] > lines[ends[:-1]])
        sentence = np.concatenate([[0], np.flatnonzero(stops) + 1]) if n else np.zeros(0, np.int64)
        counts = np.diff(np.append(sentence, n))
        first, self.owners = sentence, np.arange(len(sentence))
        if every_length and (counts > LONG).any():
            marked = np.flatnonzero(self.hashes[0] % np.uint64(CUT_EVERY) == 0) + 1
            cuts = [c for i in np.flatnonzero(counts > LONG) for c in _cuts(int(sentence[i]), int(sentence[i] + counts[i]), marked)]
            first = np.sort(np.concatenate([sentence, np.array(cuts, np.int64)]))
            self.owners = np.searchsorted(sentence, first, side="right") - 1
        self.first = np.append(first, n)
        number = np.searchsorted(offsets, starts[first], side="right") - 1
        self.places = np.searchsorted(number, np.arange(len(self.texts) + 1))
        self.starts = starts[first] - offsets[number]
        self.starts[self.places[:-1][np.diff(self.places) > 0]] = 0

    def edges(self, number: int) -> np.ndarray:
        """Where the units of one text begin, and its end."""
        return np.append(self.starts[self.places[number] : self.places[number + 1]], len(self.texts[number]))

    def own(self, number: int) -> np.ndarray:
        """The sentence of each unit of one text, from 0."""
        owners = self.owners[self.places[number] : self.places[number + 1]]
        return owners - owners[:1]


def _cuts(at: int, end: int, marked: np.ndarray) -> list[int]:
    """Words before which a long sentence of the words ``at`` to ``end`` is cut: after marked words, LEAST_PIECE to LONG words apart."""
    out = []
    low, high = np.searchsorted(marked, [at + 1, end])
    for c in [*marked[low:high].tolist(), end]:
        while c - at > LONG or (c - at == LONG and c < end):
            at += LONG
            out.append(at)
        if LEAST_PIECE <= c - at and c < end:
            at = c
            out.append(at)
    return out


def _described(text: str, every_length: bool) -> tuple[list[tuple[int, int, list[str]]], list[int]]:
    cut = Cut([text], every_length)
    edges = cut.edges(0).tolist()
    return [(a, b, text[a:b].lower().split()) for a, b in zip(edges, edges[1:])], cut.own(0).tolist()


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of each sentence; the ends are the next starts, so the spans tile the text."""
    return _described(text, False)[0]


def pieces(text: str) -> tuple[list[tuple[int, int, list[str]]], list[int]]:
    """Pieces of all sentences like ``sentences``, and the number of its sentence for each."""
    return _described(text, True)


def run_places(cut: Cut, span: int, min_words: int, every_length: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and end units of each run that has enough words, in the order of the texts, each run once."""
    n, sums, owners = len(cut.owners), cut.first, cut.owners
    number = np.arange(len(cut.texts)).repeat(np.diff(cut.places))
    edges = np.append(np.flatnonzero(np.diff(owners, prepend=-1)), n)
    firsts, ends = edges[: max(0, len(edges) - span)], edges[span:]
    enough = (sums[ends] - sums[firsts] >= min_words) & (number[firsts] == number[ends - 1])
    firsts, ends = firsts[enough], ends[enough]
    if every_length:
        after = np.maximum(np.searchsorted(sums, sums[:-1] + min_words), np.arange(1, n + 1))
        before = np.minimum(np.searchsorted(sums, sums[1:] - min_words, side="right") - 1, np.arange(n))
        on, back = np.flatnonzero(after <= cut.places[1:][number]), np.flatnonzero(before >= cut.places[:-1][number])
        firsts, ends = np.concatenate([firsts, on, before[back]]), np.concatenate([ends, after[on], back + 1])
    both = np.sort(firsts * (n + 1) + ends)
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    return both // (n + 1), both % (n + 1)


def run_hashes(texts: list[str | None], span: int, min_words: int, every_length: bool = False) -> tuple[np.ndarray, ...]:
    """Text, first unit there, units, 64-bit hash and 32-bit check of each run that has enough words.

    A run's hash is a sum of its words' hashes under powers of an odd base, so
    that all runs come from one running sum.
    """
    cut = Cut(texts, every_length)
    firsts, ends = run_places(cut, span, min_words, every_length)
    a, b, number = cut.first[firsts], cut.first[ends], np.searchsorted(cut.places, firsts, side="right") - 1
    out = []
    for base, words in zip((_P, _Q), cut.hashes, strict=True):
        n = len(words)
        words[cut.first[1:] - 1] ^= _P  # equal runs are cut into equal units
        sums = np.concatenate([np.zeros(1, np.uint64), (words * _grown(int(base), n + 1)[:n]).cumsum(dtype=np.uint64)])
        out.append(_mixed((sums[b] - sums[a]) * _grown(pow(int(base), -1, 1 << 64), n + 1)[a] + (b - a).astype(np.uint64)))
    check = (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return number, (firsts - cut.places[number]).astype(np.int32), (ends - firsts).astype(np.int32), out[0].view(np.int64), check


def runs(keyed: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, every_length: bool = False) -> DataFrame:
    """Every run of (row_key, row_check, doc_id, text); ``at`` is its first unit, ``size`` its number of units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, "text", CHARS):
                number, *found = run_hashes(texts_of(piece), span, min_words, every_length)
                rows = pa.array(number)
                columns = {name: piece.column(name).take(rows) for name in (*ROW, "doc_id")}
                columns |= {name: pa.array(values) for name, values in zip(("at", "size", "hash", "check"), found, strict=True)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return keyed.mapInArrow(run, RUNS)


def later_runs(keyed: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, every_length: bool = False) -> DataFrame:
    """(row_key, row_check, starts): places (at, size) of runs that are not the first of their kind."""
    first = (
        runs(keyed, span, min_words, every_length)
        .groupBy("hash", "check")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", *ROW, "at")).alias("first"))
        .where("n > 1")
        .select("hash", "check", *(F.col(f"first.{c}").alias(f"first_{c}") for c in (*ROW, "at")))
    )
    later = runs(keyed, span, min_words, every_length).join(cut(first, "repeated-runs"), ["hash", "check"])
    later = later.where("not (row_key = first_row_key and row_check = first_row_check and at = first_at)")
    return later.groupBy(*ROW).agg(F.collect_set(F.struct("at", "size")).alias("starts"))


_SPANS = ("array<struct<start:bigint,end:bigint>>", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))


def dedup(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, every_length: bool = False) -> DataFrame:
    """``docs`` with repeated sentence spans removed from the text.

    Adds n_sentences, n_removed (sentences of which a piece or all is taken
    out) and removed, the (start, end) code points of the stretches taken out.
    The first occurrence is the one of the smallest doc_id (null first), then
    of a hash of doc_id and text, then of the earliest place; rows equal in both
    are one text and keep the same. A null text stays null and has no
    sentences. A text without a later repeat is returned character for
    character. Columns of ``docs`` with the added names are replaced; all others
    come back as they were. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    added = ("n_sentences", "n_removed", "removed")
    names = [c for c in docs.columns if c not in (*added, *ROW, "starts")]
    keyed = docs.select(*names, F.xxhash64("doc_id", "text").alias("row_key"), F.xxhash64(F.lit(97), "text", "doc_id").alias("row_check"))
    starts = later_runs(keyed.select(*ROW, F.col("doc_id").cast("long").alias("doc_id"), "text"), span, min_words, every_length)
    joined = keyed.join(starts.hint("shuffle_hash"), list(ROW), "left").select(*names, "starts")

    def make(piece: pa.RecordBatch) -> dict:
        given = texts_of(piece)
        cut = Cut(given, every_length)
        texts, counts, gone, cuts = [], [], [], []
        for number, (text, at) in enumerate(zip(given, piece.column("starts").to_pylist(), strict=True)):
            own = cut.own(number)
            n = len(own)
            counts.append(int(own[-1]) + 1 if n else 0)
            dead = np.zeros(n + 1, bool)
            for r in at or ():
                dead[r["at"] : min(r["at"] + r["size"], n)] = True
            if not dead.any():
                texts.append(text)
                gone.append(0)
                cuts.append([])
                continue
            edges = cut.edges(number)[np.flatnonzero(np.diff(dead, prepend=False))].tolist()
            stretches, left, upto = list(zip(edges[::2], edges[1::2], strict=True)), [], 0
            for a, b in stretches:
                left.append(text[upto:a])
                upto = b
            texts.append("".join([*left, text[upto:]]))
            gone.append(len(np.unique(own[dead[:n]])))
            cuts.append([{"start": a, "end": b} for a, b in stretches])
        return {"text": texts, "n_sentences": counts, "n_removed": gone, "removed": cuts}

    return extended(joined, {"text": "string", "n_sentences": "long", "n_removed": "long", "removed": _SPANS}, make, drop=("starts",), chars=CHARS)


def dedup_documents(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, every_length: bool = True) -> DataFrame:
    """The columns of ``docs`` only, n_chars counted anew; documents left without a word go.

    Null texts, repeated rows, other columns and empty tables as in ``dedup``:
    documents from which nothing is removed stay as they were, null or empty
    ones too.
    """
    out = dedup(docs, span, min_words, every_length).where("n_removed = 0 or text rlike '\\\\S'")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
