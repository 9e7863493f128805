"""The registered queries of this subpackage and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from scorewright.llm import (
    block_names,
    chat_windows,
    hard_negatives,
    importance,
    line_templates,
    near_duplicates,
    neighbours,
    piece_codec,
    repeated_spans,
    source_mix,
    token_files,
    toxicity,
    word_languages,
)
from scorewright.llm.common import table
from scorewright.sources.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.digests(table(spark, sf_dir, "documents"))


def op2_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.digests(
        repeated_spans.without_repeats(table(spark, sf_dir, "documents"))
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_report(table(spark, sf_dir, "documents"))


def op4_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.exact_duplicates(table(spark, sf_dir, "documents"))


#: The conversation that op7 adds: control strings of another template as texts.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    given = table(spark, sf_dir, "conversations").select(*columns)
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    return chat_windows.formatted_chats(given.unionByName(extra))


def op5_token_files(
    spark: SparkSession, sf_dir: str, tokenizer: str | None = None, end_id: int = 2
) -> DataFrame:
    folder = new_path(spark, "token-files")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(table(spark, sf_dir, "documents"), folder, path, end_id)
    return token_files.digests(token_files.read_tokens(spark, folder))


def op6_piece_codec(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    return piece_codec.digests(piece_codec.encode_decode(table(spark, sf_dir, "documents"), path))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_query = F.col("vec_id") % 20 == 0
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), is_query, 20)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op10_word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_languages.document_languages(table(spark, sf_dir, "documents"))


def op11_target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    is_anchor = F.col("vec_id") % 50 == 0
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor, label)


def queries() -> dict[str, Query]:
    return {name: job for name, job in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from scorewright.llm.oracle import SQL

    return dict(SQL)
