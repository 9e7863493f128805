"""The corpus pipeline: stages over the documents, each by an operator of the library.

Each stage works on all rows that the one before it kept, written as Parquet and read
again.  All but the last return the columns of ``documents``.  Rows with nulls, empty
texts and repeated rows go through as the operators' docstrings say; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm import (
    line_templates,
    near_duplicates,
    piece_codec,
    source_mix,
    word_languages,
)
from scorewright.llm.common import table
from scorewright.sources.storage import materialize

#: More than op1, whose SQL has no fields that other documents decide.
LINES = line_templates.Rule(leaf=1 / 4)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or in no language by far, go."""
    return word_languages.keep_known(docs)


def without_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that recur across documents; ``n_chars`` follows the text."""
    kept = line_templates.without_recurring_lines(docs, LINES)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates; those emptied before are one class."""
    return near_duplicates.keep_one(docs, rule=near_duplicates.Rule(wordless=True))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks for."""
    return source_mix.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text decoded from them."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_codec.encode_decode(docs, path)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("language", known_languages),
    ("lines", without_recurring_lines),
    ("near_duplicates", one_of_each_class),
    ("mix", mixed_sources),
    ("pieces", pieces),
]

#: The language field and the similarity classes cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
