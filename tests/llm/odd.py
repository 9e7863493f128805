"""Small tables with odd rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " uid long, th long, size long, kept string, key string, line int, p int, class long"
)
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [
    (0, "one two three four five six seven eight nine ten", "en", "a"),
    (1, None, "en", "a"),
    (2, "", None, None),
    (3, " \t\n ", "de", "b"),
    (4, LONG, "en", "c"),
    (5, LONG, "en", "c"),
    (6, "one two\tthree four five six seven\n eight nine ten", "en", "a"),
    (6, "one two\tthree four five six seven\n eight nine ten", "en", "a"),
    (None, "one two three four five six seven eight nine ten", "en", "a"),
    (7, "été à la 中文 😀 \u0000 end", "fr", "b"),
    (8, "1234 !? 5", "en", "b"),
]


def odd_docs(spark: SparkSession) -> DataFrame:
    rows = [(i, t, l, s, len(t or ""), 1, 2, 3, "k", "x", 4, 5, 6) for i, t, l, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
