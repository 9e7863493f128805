"""What several operators share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words and the white space between them; the same classes in every operator.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_groups(texts: list[str], characters: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, in groups of about so many characters, to bound a task's memory."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group


def in_slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[pa.Array]:
    """The texts in order, in slices of about so many bytes: only a slice's are Python's at once."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    begin = 0
    while begin < len(texts):
        before = ends[begin - 1] if begin else 0
        end = int(np.searchsorted(ends, before + size)) + 1
        yield texts.slice(begin, end - begin)
        begin = end
