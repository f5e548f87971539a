import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaylake.llm import sharding


def check(docs, rows, shards):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, None if r.text is None else zlib.crc32(r.text.encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    held = [sum(r.size for r in rows if r.shard == k) for k in range(shards)]
    total, largest = sum(held), max(r.size for r in rows)
    assert all(abs(b - total / shards) <= largest + 0.001 * total for b in held)


@pytest.mark.parametrize("cells", [8, 1024])
def test_real_table(spark, monkeypatch, cells):
    monkeypatch.setattr(sharding, "CELLS", cells)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, sharding.shard(docs).collect(), 24)


def test_one_text_holds_most_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = sharding.shard(docs).collect()
    check(docs, rows, 24)
    shards = sorted({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"the same")})
    assert shards == list(range(shards[0], shards[-1] + 1)) and len(shards) >= 15


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.withColumn("shard", F.lit("x"))
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == 12 and {r.size for r in rows if r.text_crc32 is None} == {8}
    check(docs, rows, 3)
    assert sharding.shard(no_docs).count() == 0


def test_equal_texts_stay_together(spark):
    """600 groups of a dozen copies, each far smaller than a share: no group is cut."""
    docs = spark.range(7200).select(F.col("id").alias("doc_id"), F.format_string("text number %d of the groups", F.col("id") % 600).alias("text"))
    rows = sharding.shard(docs).collect()
    check(docs, rows, 24)
    held = defaultdict(set)
    for r in rows:
        held[r.text_crc32].add(r.shard)
    assert len(held) == 600 and all(len(s) == 1 for s in held.values())
