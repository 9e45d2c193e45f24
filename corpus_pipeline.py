"""The corpus pipeline: five stages from raw documents to packed sequences, each by an operator of lapline.llm.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last give the columns
of their input. Null and empty texts go in the first stage, as they have no language; an empty table stays empty
through all stages; rows without doc_id stay where a stage can't name them; columns besides text and n_chars are
never changed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lapline.llm import jaccard, language, lines, packing, secrets
from lapline.llm.shared import Scratch

#: Below this score the language model doesn't know a text; junk with some words of a language scores over 0.2.
LEAST_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn languages from the labelled rows of ``docs`` that aren't held out; documents of none go."""
    model = language.fit(docs.where(~language.held_out()))
    known = language.predict(docs, model).where(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.select(*(f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals within one edit go, and with its last line a document."""
    return lines.dedup_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a similarity of 0.8 the document with the smallest id stays.

    Rows that repeat a doc_id stay or go together; rows without one stay.
    """
    spare = Scratch(spark, "copies").write(
        jaccard.near_duplicates(docs, words=5, num=80, den=100).where("component_id <> doc_id").select(
            F.col("doc_id").alias("__spare")).distinct(), "spare")
    return docs.join(spare, F.col("doc_id").cast("long") == F.col("__spare"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is replaced by a mask."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of 4096."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can't express the language model of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{number}_{name}")
        if number:
            scratch.drop(f"{number - 1}_{STAGES[number - 1][0]}")
    return docs
