"""Ids above 2**53 beside a null id come back as they were, from every operator and stage."""

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from assaylake.llm import bpe, language_id, near_dup, packing, repetition, secrets, sharding, substring_dedup

BIG = [2**60 + 1, 2**60 + 3, 2**62 + 7]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the text of number {n} says something of its own about {'abcdefg'[n]} and more words follow", "en", "s", 2**55 + 1, 1.0) for n, i in enumerate([*BIG, None])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, other double").coalesce(1)


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))


OPERATORS = {
    "language_id": lambda d: language_id.predict(d, language_id.train(d, F.lit(True))),
    "repetition": repetition.judge,
    "substring_dedup": lambda d: substring_dedup.dedup(d, every_length=True),
    "packing": packing.pack,
    "near_dup": near_dup.near_duplicates,
    "near_dup_stage": near_dup.dedup_documents,
    "bpe": lambda d: bpe.round_trip_digest(d, public_tokenizers.path("byte_bpe_50k.json")),
    "sharding": sharding.shard,
    "secrets": lambda d: secrets.digest(d, secrets.train(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators(docs, name):
    assert ids(OPERATORS[name](docs)) == [*BIG, None]


def test_stages(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        assert ids(docs) == [*BIG, None]
        if "other" in docs.columns:
            assert {r.other for r in docs.collect()} == {1.0}
