"""Byte-level BPE encoding and decoding with a contiguous rank array.

A pre-tokenised word is short, so its parts are kept in three small arrays
that lie side by side: the part boundaries, the part ids, and the rank of each
adjacent pair. The array of ranks is scanned for its minimum again and again;
the boundary between the two parts is deleted and only the two neighbouring
ranks are looked up anew. Words longer than :data:`LONG` parts (base64 blobs,
text without spaces) take the same merges from a heap, as a scan would be
quadratic there.

Tokenizers are never trained here; the vocabulary file is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from assaylake.llm.common import extended, texts_of

#: Pre-tokenisation pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Parts beyond which merges come from a heap.
LONG = 128

#: Words whose ids one Python worker keeps, and the characters that a kept word may have. The store is emptied when it is full.
KEPT_WORDS, KEPT_CHARS = 300_000, 64

_NONE = 1 << 29


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file.

    Printable bytes stand for themselves, the others for the code points from
    256 upwards in order of the byte.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [], 256
    for byte in range(256):
        if byte in printable:
            out.append(chr(byte))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class ByteBPE:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.byte_ids = [vocab[letter] for letter in byte_letters()]
        #: (left id << 20 | right id) -> rank, and the id of the joined part by rank
        self.pairs: dict[int, int] = {}
        self.joined: list[int] = []
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.pairs[vocab[left] << 20 | vocab[right]] = rank
            self.joined.append(vocab[left + right])
        back = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.token_bytes: dict[int, bytes] = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes.update({i: content.encode() for content, i in self.added.items()})
        self.split_added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pattern = regex.compile(PATTERN)
        self.words = _Words(self)
        self.stretches = _Stretches(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Apply all merges to the byte ids of one word."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        get, joined = self.pairs.get, self.joined
        ranks = [get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        bounds = list(range(len(ids)))
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            ids[at] = new = joined[low]
            del ids[at + 1], bounds[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(new << 20 | ids[at + 1], _NONE)
            if at:
                ranks[at - 1] = get(ids[at - 1] << 20 | new, _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for a long word: a heap of (rank, place) over linked parts."""
        get, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := get(ids[i] << 20 | ids[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 20 | ids[j], _NONE) != rank:
                continue
            ids[i], ids[j] = self.joined[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (rank := get(ids[i] << 20 | ids[after[i]], _NONE)) != _NONE:
                    heapq.heappush(heap, (rank, i))
            if (b := before[i]) >= 0 and (rank := get(ids[b] << 20 | ids[i], _NONE)) != _NONE:
                heapq.heappush(heap, (rank, b))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if not any(content in text for content in self.added):
            return self._plain(text)
        out, at = [], 0
        for found in self.split_added.finditer(text):
            out.append(self._plain(text[at : found.start()]))
            out.append(self.added[found[0]].to_bytes(4, "little"))
            at = found.end()
        out.append(self._plain(text[at:]))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """The ids of a text without added tokens.

        Where each space and each newline stands alone between two words, the
        pattern never joins what lies on either side of one, so the stretches
        between them are encoded, and kept, one by one.
        """
        if not text or " ".join(text.split()) != text.replace("\n", " "):
            return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([*map(self.words.__getitem__, self.pattern.findall(first)), *map(self.stretches.__getitem__, rest)])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Packed ids of words seen so far; a miss merges the word."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        byte_ids = self.bpe.byte_ids
        ids = self.bpe.merge([byte_ids[b] for b in word.encode("utf-8", "surrogatepass")])
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KEPT_CHARS:
            self[word] = packed
        return packed


class _Stretches(dict):
    """Packed ids of what follows one space, or of a newline and what follows it."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, stretch: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        written = stretch if stretch[0] == "\n" else f" {stretch}"
        if stretch.isalpha():
            packed = self.bpe.words[written]
        else:
            packed = b"".join(map(self.bpe.words.__getitem__, self.bpe.pattern.findall(written)))
        if len(stretch) <= KEPT_CHARS:
            self[stretch] = packed
        return packed


_loaded: dict[str, ByteBPE] = {}


def load(path: str) -> ByteBPE:
    """One encoder a vocabulary file and Python process."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with a binary column of packed ids of each whole text.

    A null text has no ids. A column of ``docs`` named ``to`` is replaced, all
    others come back as they were; repeated rows give repeated results; an
    empty table gives no rows.
    """

    def make(piece: pa.RecordBatch) -> dict:
        bpe = load(path)
        return {to: [bpe.encode(t) if t else b"" for t in texts_of(piece, text)]}

    return extended(docs, {to: "binary"}, make, text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the text of packed ids; null ids give an empty text. Other columns as in ``encode``."""

    def make(piece: pa.RecordBatch) -> dict:
        bpe = load(path)
        return {to: [bpe.decode(p) if p else "" for p in texts_of(piece, ids)]}

    return extended(encoded, {to: "string"}, make, ids)


def round_trip_digest(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text and return digests of both.

    One row for each row of ``docs``: doc_id, n_tokens, ids_sha256 (ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (UTF-8). A null
    text counts as empty; repeated rows give repeated results; other columns
    of ``docs`` are not read, whatever their names; an empty table gives no
    rows. Ids and text stay in one pass, so that neither travels between
    processes.
    """

    def make(piece: pa.RecordBatch) -> dict:
        bpe, rows = load(path), []
        for text in texts_of(piece):
            packed = bpe.encode(text) if text else b""
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed).encode("utf-8")).hexdigest()))
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), map(list, zip(*rows, strict=True)), strict=True))

    return extended(docs.select("doc_id", "text"), {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, make, drop=("text",))
