"""Corpus preparation: language ID, near duplicates, repeated sentences, benchmark leaks, packing.

Every stage takes all rows of the one before and calls one operator of glossa.llm. All but the last return the columns
of documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import decontaminate, langid, neardup, packing, sentences
from glossa.llm.common import discard, keep, materialize, table, temporaries

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters and undecided ones go."""
    return langid.keep_identified(docs, 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least doc_id."""
    return neardup.keep_one(docs)


def repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that an earlier place has too; a document that loses all of its words goes."""
    names = docs.columns
    cut = sentences.dedup_sentences(docs)
    left = cut.where((F.col("n_words_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in names:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*names)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item; a null doc_id saves no leak."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left in windows of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_sentences", repeated_sentences),
    ("benchmark_leaks", benchmark_leaks),
    ("pack", pack),
]

ORACLE_SQL = None  # models, sketches and tokenizers are not SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; every result but the last is written, and deleted when the next one is.

    What a stage writes for itself goes with it. Null, empty, very long and repeated texts, ties and extra columns are
    treated as the stages' operators say; empty documents or an empty benchmark give empty stages or drop nothing.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporaries(spark):
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
