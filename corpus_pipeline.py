"""From raw documents to packed training sequences, one stage after another.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run``
writes each stage's result as Parquet in the folder that the cluster shares and
reads it again, so a lost executor never repeats an earlier stage. All but the
last stage return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: An ambiguous language goes only where the nearest codeword is less likely than this.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter at all (null and empty texts too), or no codeword near enough.

    All others stay as they were, repeated rows and rows without an id too.
    """
    from assaylake.llm import language_id
    from assaylake.llm.common import is_held_out

    model = language_id.train(docs, ~is_held_out(F.col("doc_id")))
    found = language_id.predict(docs, model)
    undecided = (F.col("lang_pred") == language_id.UNDETERMINED) | (F.col("ambiguous") & (F.col("score") < LEAST_SCORE))
    return found.where(~undecided).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, linked at a similarity of 0.8 or more.

    It is the one of the least doc_id; rows without a word, without an id and
    repeated rows are treated as ``near_dup.dedup_documents`` states.
    """
    from assaylake.llm import near_dup

    return near_dup.dedup_documents(docs, near_dup.PERCENT)


def cut_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove sentences under a repeated span; a document left without a word goes.

    Null and empty texts stay; of repeated rows, which are one text, all keep the same.
    """
    from assaylake.llm import substring_dedup

    return substring_dedup.dedup_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found; null texts, repeated rows and other columns come back as they were."""
    from assaylake.llm import secrets

    return secrets.redact(docs, secrets.train(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into bins, one row for each piece; null and empty texts have a piece without a bin."""
    from assaylake.llm import packing

    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_spans),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages hold trained models and graph closures that SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table passes through all of them."""
    from assaylake.llm.common import cut, documents

    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
