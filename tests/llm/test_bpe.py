import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assaylake.llm import bpe

PATH = "/opt/tokenizers/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


ours = bpe.load(PATH)


def ids(text):
    return np.frombuffer(ours.encode(text), "<u4").tolist()


@pytest.mark.parametrize(
    "text",
    ["", " ", "a", "<|endoftext|>", "x<|endoftext|> y", "a  b\n\n c", "don't I'LL we've", "日本語 😀 é́", "ab" * 3000, "\x1c \x85x　", "12,345 ½ ²", " lead", "trail ", "a\n b", "a \nb"],
)
def test_same_as_library(theirs, text):
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert ours.decode(ours.encode(text)) == theirs.decode(want, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80))
def test_round_trip(text):
    assert ours.decode(ours.encode(text)) == text


def test_long_words_merge_alike():
    rng = random.Random(1)
    for _ in range(20):
        word = [ours.byte_ids[b] for b in "".join(rng.choice("etaoin shr") for _ in range(100)).encode()]
        assert ours.merge(list(word)) == ours._merge_long(list(word))


def test_digest(odd_docs, no_docs, theirs):
    rows = bpe.round_trip_digest(odd_docs, PATH).collect()
    assert len(rows) == 12
    want = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    for r in rows:
        found = theirs.encode(want[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(found)
        assert r.ids_sha256 == hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip_digest(no_docs, PATH).count() == 0


def test_encode_decode_columns(odd_docs):
    back = bpe.decode(bpe.encode(odd_docs, PATH, to="score"), PATH, ids="score", to="label").collect()
    assert all((r.text or "") == r.label for r in back)
