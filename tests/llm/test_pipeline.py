import corpus_pipeline
from assaylake.llm import language_id, near_dup, packing, secrets, substring_dedup
from assaylake.llm.common import cut

DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], DIR), name))
    for frame in kept[:-1]:
        assert frame.columns == docs.columns and frame.schema == docs.schema
    first, by_language, unique, cut_down, masked, packed = kept
    assert by_language.count() <= first.count()
    assert {r.doc_id for r in unique.collect()} == {r.doc_id for r in near_dup.near_duplicates(by_language, near_dup.PERCENT).where("kept").collect()}
    assert substring_dedup.dedup(cut_down).where("n_removed > 0").count() <= substring_dedup.dedup(unique).where("n_removed > 0").count()
    assert not any(secrets.base_spans(r.text) for r in masked.collect())
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in masked.collect()}
    assert packed.agg({"bin_fill": "max"}).first()[0] <= packing.CAPACITY
    assert language_id.UNDETERMINED == "und"


def test_empty_table(spark, tmp_path):
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, DIR), name)
    assert empty.count() == 0
