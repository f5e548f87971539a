"""Secret scans: three fixed rules, and a character convolutional network.

The rules find assignments, access keys and long hexadecimal runs. Beside them,
every long token is a candidate. A small convolutional network in
numpy reads each candidate, whole, with the characters before and after it. It
is trained here on labelled findings: all findings of the rules and all tokens
of a known plain form in the corpus, and generated ones of known label. Tokens
that no rule finds and that have no plain form may be keys; they stay unlabelled
and are left out of training. The labelled windows are dealt into blocks of a
table. In each round every block takes the network through its windows, and the
networks that come out are averaged (parameter mixing), so the driver holds one
network, never the windows. The scores are calibrated on all findings held out
from training, and the threshold is the largest that still keeps the wanted
recall there; ``recall`` and ``false_rate`` tell what it reaches. Candidates
above it that no rule has found are added under the kind ``model``.
"""

from __future__ import annotations

import hashlib
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import Tables, extended, pieces_of, ship, texts_of

#: Patterns of the base rules (fixed values), their kinds and least lengths.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "model")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: What the network is asked about: a token of 16 or more characters, or of 12 or more with a digit and a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
LONG_CANDIDATE = 16
_digit, _letter = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

#: Forms of tokens that are no keys: numbers, dates, words of one case or title case joined or with a short number
#: behind. A key of letters in one case has the form of a long word, so a long one must also be spelled like a word.
LONGEST_WORD = 12
_part = rf"(?:[a-z]{{1,{LONGEST_WORD}}}|[A-Z]{{1,{LONGEST_WORD}}}|[A-Z][a-z]{{1,{LONGEST_WORD - 1}}})"
_PLAIN = re.compile(rf"[0-9/_+=-]+|[/_+=-]*(?:{_part}[/_+=-]+)+(?:{_part})?[0-9]{{0,4}}[/_+=-]*|(?:[A-Z][a-z]{{2,{LONGEST_WORD - 1}}}){{2,}}[0-9]{{0,2}}")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A word has at least this share of vowels and at most this share of rare letters. Under one in a hundred random keys do.
VOWELS, RARE = 0.28, 0.1

#: Characters before, in and after one window. A longer candidate has several windows.
LEFT, BODY, RIGHT = 24, 48, 12
SPAN = LEFT + BODY + RIGHT

#: Generated findings of each label, beside those of the corpus.
GENERATED = 1_500

#: Windows of a block, and windows that one step of Adam reads. ROUNDS is how often every block is gone through.
BLOCK, BATCH, ROUNDS = 4_096, 128, 12

#: Length of a step in the first half of the rounds; in the second it falls evenly.
RATE = 0.02

#: Of ten tokens, so many are held out from training.
HELD_OUT = 3

#: Averages of networks are sums of whole numbers of this unit, and margins are whole numbers of that one, so neither
#: depends on the order of blocks, and all margins of a corpus are counts of at most 2 * MOST_MARGIN / MARGIN values.
UNIT, MARGIN, MOST_MARGIN = 2.0**-42, 2.0**-10, 64

#: Recall that the threshold keeps on held-out findings.
RECALL = 0.97

_PAD, _OTHER = 0, 1
_CODES = np.full(0x80, _OTHER, np.uint8)
_CODES[32:127] = np.arange(95) + 2
SYMBOLS = 97

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Findings of the rules, by start and then by kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if len(m[0]) >= LONG_CANDIDATE or (_digit.search(m[0]) and _letter.search(m[0]))]


def is_plain(token: str) -> bool:
    """A token of a known form: at most two different characters, numbers, joined words, or one long word."""
    if len(set(token)) <= 2 or _PLAIN.fullmatch(token):
        return True
    low = token.lower()
    return _WORD.fullmatch(token) is not None and sum(map(low.count, "aeiou")) >= VOWELS * len(low) and sum(map(low.count, "jkqvwxyz")) <= RARE * len(low)


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the windows over one candidate: a row for each BODY characters of it."""
    out = np.zeros((max(1, -(-(end - start) // BODY)), SPAN), np.uint8)
    for row, at in enumerate(range(start, max(end, start + 1), BODY)):
        left, stop = text[max(0, at - LEFT) : at], min(end, at + BODY)
        for place, part in ((LEFT - len(left), left), (LEFT, text[at:stop]), (LEFT + BODY, text[stop : stop + RIGHT])):
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            out[row, place : place + len(codes)] = np.where(codes < 0x80, _CODES[np.minimum(codes, 0x7F)], _OTHER)
    return out


class Network:
    """One convolution over characters, pooled before, in and after the candidate, and one output."""

    WIDTH, FILTERS = 5, 20
    REGIONS = ((0, LEFT), (LEFT, LEFT + BODY), (LEFT + BODY, SPAN))
    NAMES = ("conv", "shift", "out", "bias")

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.conv = rng.normal(0, 0.2, (self.WIDTH, SYMBOLS, self.FILTERS)).astype(np.float32)
        self.shift = np.zeros(self.FILTERS, np.float32)
        self.out = rng.normal(0, 0.2, self.FILTERS * 4).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5
        self.recall, self.false_rate = float("nan"), float("nan")

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        half = self.WIDTH // 2
        padded = np.pad(x, ((0, 0), (half, half)))
        h = self.shift + sum(self.conv[k][padded[:, k : k + SPAN]] for k in range(self.WIDTH))
        active = np.maximum(h, 0)
        best = [active[:, a:b].argmax(1) + a for a, b in self.REGIONS]
        rows, filters = np.arange(len(x))[:, None], np.arange(self.FILTERS)
        body = (x[:, LEFT : LEFT + BODY] != _PAD).astype(np.float32)[:, :, None]
        mean = (active[:, LEFT : LEFT + BODY] * body).sum(1) / np.maximum(body.sum(1), 1)
        pooled = np.concatenate([*(active[rows, b, filters] for b in best), mean], 1)
        return padded, h, best, body, pooled, pooled @ self.out + self.bias

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Margins of the windows, in whole units of MARGIN."""
        found = np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return np.rint(np.clip(found.astype(float), -MOST_MARGIN, MOST_MARGIN) / MARGIN) * MARGIN

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability for each window."""
        return self._calibrated(self.margins(x))

    def _calibrated(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))

    def parameters(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(float)

    def assign(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            old = getattr(self, n)
            setattr(self, n, flat[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size

    def _gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        padded, h, best, body, pooled, margin = self._forward(x)
        n, f = len(x), self.FILTERS
        d = (weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n).astype(np.float32)
        d_pool = d[:, None] * self.out
        d_h = np.zeros_like(h)
        rows, filters = np.arange(n)[:, None], np.arange(f)
        for r, b in enumerate(best):
            d_h[rows, b, filters] += d_pool[:, r * f : (r + 1) * f]
        d_h[:, LEFT : LEFT + BODY] += body * (d_pool[:, 3 * f :] / np.maximum(body.sum(1), 1))[:, None, :]
        d_h *= h > 0
        at, place, which = np.nonzero(d_h)
        pull, conv = d_h[at, place, which], np.zeros_like(self.conv)
        for k in range(self.WIDTH):
            conv[k] = np.bincount(padded[at, place + k].astype(np.int64) * f + which, pull, SYMBOLS * f).reshape(SYMBOLS, f)
        return {"conv": conv + 1e-5 * self.conv, "shift": d_h.sum((0, 1)), "out": d @ pooled, "bias": d.sum(keepdims=True)}

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings, then the largest threshold of that recall."""
        self.settle(self.margins(x), y, np.ones(len(x)), np.zeros(len(x), bool), recall)

    def settle(self, m: np.ndarray, y: np.ndarray, weight: np.ndarray, made: np.ndarray, recall: float) -> None:
        """The same from margins that each stand for ``weight`` findings; the recall is kept on all and on the ``made`` ones alone."""
        good, bad, a, b = float(weight[y == 1].sum()), float(weight[y == 0].sum()), 1.0, 0.0
        target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        for _ in range(300):
            pull = weight * (1 / (1 + np.exp(-np.clip(a * m + b, -30, 30))) - target) / (good + bad)
            a, b = a - 0.1 * (pull * m).sum(), b - 0.1 * pull.sum()
        self.slope, self.offset = float(max(a, 1e-3)), float(b)
        p = self._calibrated(m)
        kept = []
        for part in filter(np.any, (y == 1, (y == 1) & made)):
            order = np.argsort(p[part], kind="stable")
            found, below = p[part][order], np.cumsum(weight[part][order]) - weight[part][order]
            kept.append((part, found[(below <= (1 - recall) * weight[part].sum()).sum() - 1]))
        self.threshold = float(min((t for _, t in kept), default=0.5))
        if kept:
            self.recall = float(min(weight[part & (p >= self.threshold)].sum() / weight[part].sum() for part, _ in kept))
        if bad:
            self.false_rate = float(weight[(y == 0) & (p >= self.threshold)].sum() / bad)


def generated(n: int, seed: int = 17) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """n findings of each label as (text, start, end): random keys, and tokens that only look long."""
    rng = np.random.default_rng(seed)

    def pick(letters: str, k: int) -> str:
        return "".join(rng.choice(list(letters), k))

    def word() -> str:
        return pick("etaoinshrdlucm", int(rng.integers(2, 9)))

    def long_word() -> str:
        made = "".join(pick("ttnnsshhrrddlcmbfgpvz", int(rng.integers(1, 5))) + pick("eeaiou", int(rng.integers(1, 3))) for _ in range(int(rng.integers(5, 9))))
        return (made, made.title(), made.upper(), made.upper())[rng.integers(4)]

    alnum, base64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    keys = (
        lambda: pick("0123456789abcdef", int(rng.integers(20, 65))),
        lambda: pick(base64, int(rng.integers(22, 70))) + pick("=", int(rng.integers(0, 3))),
        lambda: pick(alnum, int(rng.integers(18, 50))),
        lambda: pick(alnum, int(rng.integers(11, 18))) + pick(string.digits, 1),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: word()[:3] + "_" + pick(alnum, int(rng.integers(20, 40))),
        lambda: pick(string.ascii_uppercase + string.digits, int(rng.integers(18, 40))),
        lambda: pick(string.ascii_letters, int(rng.integers(18, 50))),
    )
    plain = (
        lambda: pick(string.digits, int(rng.integers(16, 24))),
        lambda: "/".join(word() for _ in range(5)) + "/" + pick(string.digits, 4),
        lambda: "_".join(word() for _ in range(4)) + pick(string.digits, 1),
        lambda: "-".join(word() for _ in range(4)) + "-" + pick(string.digits, 4),
        lambda: "".join(word().title() for _ in range(4)) + pick(string.digits, 2),
        lambda: f"20{pick('012', 1)}{pick(string.digits, 1)}-0{pick('123456789', 1)}-1{pick(string.digits, 1)}_{word()}{word()}",
        lambda: (pick("0123456789abc-", 2) * 14)[: int(rng.integers(18, 28))] + "1",
        lambda: "".join(word() for _ in range(4)) + pick(string.digits, 1),
        lambda: "".join(word() for _ in range(2)) + pick(string.digits, int(rng.integers(3, 7))),
        lambda: "-".join(word() for _ in range(2)) + "-" + pick(string.digits, int(rng.integers(3, 7))),
        lambda: pick(string.digits, int(rng.integers(11, 16))) + pick("kmgxvb", 1),
        lambda: "=" * int(rng.integers(16, 40)) + pick(string.digits, 1),
        lambda: "".join(word() for _ in range(5)),
        long_word,
        long_word,
        lambda: "".join(word().title() for _ in range(4)),
        lambda: "-".join(word() for _ in range(5)),
        lambda: pick("=-_x", 1) * int(rng.integers(16, 40)),
    )
    before_key = ("", "", "key: ", 'token = "', "password=", "secret: ", "Authorization: Bearer ", "auth=", "credential ")
    before_plain = ("", "", "see ", "path ", "file=", "id ", "number ", "https://", "order: ")

    def placed(makers, before) -> list[tuple[str, int, int]]:
        out = []
        for _ in range(n):
            left = " ".join(word() for _ in range(5)) + " " + before[rng.integers(len(before))]
            token = makers[rng.integers(len(makers))]()
            out.append((f"{left}{token} {word()} {word()} {word()}", len(left), len(left) + len(token)))
        return out

    return placed(keys, before_key), placed(plain, before_plain)


@dataclass
class Descent:
    """A network in training: Adam's two moments of its parameters, and the steps so far."""

    network: Network
    first: np.ndarray
    second: np.ndarray
    steps: int = 0

    @classmethod
    def start(cls) -> Descent:
        network = Network()
        return cls(network, np.zeros(network.parameters().size), np.zeros(network.parameters().size))

    def state(self) -> np.ndarray:
        return np.concatenate([self.network.parameters(), self.first, self.second])

    def take(self, state: np.ndarray, steps: int) -> None:
        values, self.first, self.second = np.split(state, 3)
        self.network.assign(values)
        self.steps = steps

    def walk(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int, rate: float) -> None:
        """Adam once over shuffled batches."""
        order, values = np.random.default_rng(seed).permutation(len(x)), self.network.parameters()
        for i in range(0, len(x), BATCH):
            part = order[i : i + BATCH]
            self.steps += 1
            found = self.network._gradient(x[part], y[part], weight[part])
            slope = np.concatenate([found[n].ravel() for n in Network.NAMES])
            self.first = 0.9 * self.first + 0.1 * slope
            self.second = 0.999 * self.second + 0.001 * slope * slope
            values = values - rate * (self.first / (1 - 0.9**self.steps)) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + 1e-8)
            self.network.assign(values)


def is_held_out(token: str) -> bool:
    """By the token alone: copies of a finding and all its windows lie on one side."""
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % 10 < HELD_OUT


def labelled(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every window of the rules' findings (label 1) and of candidates of plain form (0), once each, with ``held``.

    Null and empty texts have none, equal windows of one label are one row, and
    one that lies on both sides is not held out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                out = set()
                for t in filter(None, texts_of(piece)):
                    sure = [(a, b) for kind, a, b in base_spans(t) if kind != "hex" or not t[a:b].isdigit()]
                    plain = [(a, b) for a, b in candidates(t) if is_plain(t[a:b]) and not any(s < b and a < e for s, e in sure)]
                    for label, spans in ((1, sure), (0, plain)):
                        for a, b in spans:
                            held = is_held_out(t[a:b])
                            out.update((label, held, w.tobytes()) for w in windows(t, a, b))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["label", "held", "window"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "label int, held boolean, window binary")
    return found.groupBy("label", "window").agg(F.min("held").alias("held"))


def _rows(block: pa.StructScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and sides of one block."""
    rows = block.values
    x = np.frombuffer(b"".join(rows.field("window").to_pylist()), np.uint8).reshape(-1, SPAN)
    return x, rows.field("label").to_numpy().astype(float), rows.field("held").to_numpy(zero_copy_only=False).astype(bool)


def _made(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and sides of the generated findings."""
    keys, plain = generated(most)
    x = np.concatenate([windows(*f)[:1] for f in (*keys, *plain)])
    return x, np.repeat([1.0, 0.0], [len(keys), len(plain)]), np.array([is_held_out(t[a:b]) for t, a, b in (*keys, *plain)])


def train(docs: DataFrame, text: str = "text", recall: float = RECALL, most: int = GENERATED, block: int = BLOCK, rounds: int = ROUNDS) -> Network:
    """Train and calibrate the network on every labelled window of ``docs`` and ``most`` generated findings of each label.

    In a round each block goes through its own windows and all generated ones.
    Both labels weigh alike, and so do all findings of a label, but where the
    corpus has more of them than there are generated ones, all of the corpus
    weigh as much together as all generated ones. The recall is kept on all
    held-out findings and on the generated ones alone. The result is the same
    for any partitioning and order of ``docs``, and copies of a document count
    once. An empty corpus leaves the generated findings.
    """
    spark = docs.sparkSession
    ship(spark)
    tables, descent, margins = Tables(spark), Descent.start(), np.zeros((0, 3))
    made_x, made_y, made_held = _made(most)
    walked = made_x[~made_held], made_y[~made_held]
    try:
        found = tables.cut(labelled(docs, text), "labelled-windows")
        counts = {(r["label"], r["held"]): r["count"] for r in found.groupBy("label", "held").count().collect()}
        if counts:
            blocks = -(-sum(counts.values()) // block)
            dealt = found.withColumn("block", F.pmod(F.xxhash64("window", F.lit(9)), F.lit(blocks))).repartition(min(blocks, 4_096), "block")
            dealt = tables.cut(dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("label", "held", "window"))).alias("rows")), "window-blocks")
            shared = spark.sparkContext.broadcast(walked)
            for number in range(rounds):
                _round(dealt, descent, shared, counts, blocks, number, RATE * min(1, 2 - 2 * number / rounds))
            shared.unpersist()
            margins = _margins(dealt, descent.network)
        else:
            for number in range(rounds):
                _through(descent, walked, made_x[:0], made_y[:0], counts, 1, number, RATE * min(1, 2 - 2 * number / rounds))
    finally:
        tables.clear()
    y = made_y[made_held]
    weight = np.array([max(1.0, counts.get((label, True), 0) / (y == label).sum()) for label in y])
    own = np.stack([descent.network.margins(made_x[made_held]), y, weight], 1)
    descent.network.settle(*np.concatenate([margins, own]).T, np.arange(len(margins) + len(own)) >= len(margins), recall)
    return descent.network


def _through(descent: Descent, made: tuple[np.ndarray, np.ndarray], x: np.ndarray, y: np.ndarray, counts: dict, blocks: int, seed: int, rate: float) -> None:
    """One block's windows and the generated ones, once. Each label has the same weight over all blocks."""
    made_x, made_y = made
    weight, made_weight = np.zeros(len(x)), np.zeros(len(made_x))
    for label in (0, 1):
        theirs, ours = counts.get((label, False), 0), int((made_y == label).sum())
        share = 0.5 * min(theirs, ours) / max(1, min(theirs, ours) + ours)
        weight[y == label] = share * blocks / max(1, theirs)
        made_weight[made_y == label] = (0.5 - share) / max(1, ours)
    descent.walk(np.concatenate([x, made_x]), np.concatenate([y, made_y]), np.concatenate([weight, made_weight]) * (len(x) + len(made_x)), seed, rate)


def _round(dealt: DataFrame, descent: Descent, made: Broadcast, counts: dict, blocks: int, number: int, rate: float) -> None:
    """Take the network through every block, and go on from the average of what comes out."""
    given = dealt.sparkSession.sparkContext.broadcast(descent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = given.value.state()
        total, seen = np.zeros(len(start), np.int64), 0
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows"), strict=True):
                x, y, held = _rows(rows)
                mine = Descent.start()
                mine.take(start, given.value.steps)
                _through(mine, made.value, x[~held], y[~held], counts, blocks, number * blocks + block, rate)
                total += np.rint(mine.state() / UNIT).astype(np.int64)
                seen += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) + 1, dtype=np.int32)), pa.array([*total.tolist(), seen])], names=["place", "value"])

    sums = dealt.mapInArrow(run, "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toArrow()["value"].to_numpy()
    given.unpersist()
    steps = -(-(sum(n for (_, held), n in counts.items() if not held) // blocks + len(made.value[0])) // BATCH)
    descent.take(sums[:-1] * UNIT / sums[-1], descent.steps + steps)


def _margins(dealt: DataFrame, network: Network) -> np.ndarray:
    """Margins of the held-out windows of all blocks: margin, label and how many have it."""
    shared = dealt.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batch.column("rows"):
                x, y, held = _rows(rows)
                units = np.rint(shared.value.margins(x[held]) / MARGIN).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(units), pa.array(y[held].astype(np.int32))], names=["margin", "label"])

    counted = dealt.mapInArrow(run, "margin long, label int").groupBy("margin", "label").count().toArrow()
    shared.unpersist()
    found = np.stack([counted.column(n).to_numpy().astype(float) for n in ("margin", "label", "count")], 1) * (MARGIN, 1, 1)
    return found[np.lexsort(found.T)]


def added_spans(network: Network, texts: list[str], bases: list[list[Span]]) -> tuple[list[list[Span]], list[dict[tuple[int, int], float]]]:
    """Candidates of each text that the network accepts and no rule overlaps, and all scores."""
    owners, parts = [], []
    for number, text in enumerate(texts):
        for a, b in {*candidates(text), *((a, b) for _, a, b in bases[number])}:
            w = windows(text, a, b)
            owners += [(number, a, b)] * len(w)
            parts.append(w)
    added: list[list[Span]] = [[] for _ in texts]
    scores: list[dict[tuple[int, int], float]] = [{} for _ in texts]
    if owners:
        for (number, a, b), p in zip(owners, network.probability(np.concatenate(parts)).tolist(), strict=True):
            scores[number][a, b] = max(p, scores[number].get((a, b), 0.0))
        for number, found in enumerate(scores):
            for (a, b), p in sorted(found.items()):
                if p >= network.threshold and not any(s < b and a < e for _, s, e in bases[number]):
                    added[number].append(("model", a, b))
    return added, scores


SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame, network: Network, text: str = "text", to: str = "secrets", keep_text: bool = True) -> DataFrame:
    """``docs`` with an array of findings (kind, start, end, score) in each whole text.

    Offsets count code points, the end excluded; findings are in order of start
    and kind. A null or empty text has none; repeated rows give repeated
    results; an empty table gives no rows. A column of ``docs`` with the same
    name is replaced, all others come back as they were (the text only with
    ``keep_text``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)  # about 10,000 floats

    def make(piece: pa.RecordBatch) -> dict:
        texts = [t or "" for t in texts_of(piece, text)]
        bases = [base_spans(t) for t in texts]
        added, scores = added_spans(shared.value, texts, bases)
        out = []
        for base, more, score in zip(bases, added, scores, strict=True):
            spans = sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0])))
            out.append([{"kind": k, "start": a, "end": b, "score": score.get((a, b), 0.0)} for k, a, b in spans])
        return {to: out}

    return extended(docs, {to: (SPANS, _SPANS)}, make, text, () if keep_text else (text,))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def digest(docs: DataFrame, network: Network) -> DataFrame:
    """Counts by rule, a digest of the rules' findings and all findings, for every row of ``docs``.

    A null or empty text has no finding and the digest of an empty string.
    Repeated rows give repeated results, columns beside doc_id and text are left
    out, and an empty table gives no rows.
    """
    found = scan(docs.select("doc_id", "text"), network, keep_text=False)
    base = F.filter("secrets", lambda s: s["kind"] != "model")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in KINDS[:3]),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
        count("model").alias("n_model"),
    )


def redact(docs: DataFrame, network: Network, mask: str = "[secret]") -> DataFrame:
    """``docs`` with each stretch of findings replaced by ``mask`` and n_chars counted anew.

    Findings that overlap are one stretch. A null text stays null; a text
    without a finding, repeated rows and all other columns come back as they
    were; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def make(piece: pa.RecordBatch) -> dict:
        given = texts_of(piece)
        texts = [t or "" for t in given]
        bases = [base_spans(t) for t in texts]
        added, _ = added_spans(shared.value, texts, bases)
        out = []
        for old, text, base, more in zip(given, texts, bases, added, strict=True):
            pieces, at = [], 0
            for _, a, b in sorted([*base, *more], key=lambda s: (s[1], -s[2])):
                if a >= at:
                    pieces += [text[at:a], mask]
                at = max(at, b)
            out.append("".join([*pieces, text[at:]]) if pieces else old)
        return {"text": out}

    masked = extended(docs, {"text": "string"}, make)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(docs.columns)


def sha256(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
