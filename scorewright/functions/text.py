"""Text helpers for profiling and repairing raw values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters to strip from raw values, and the pattern of a suspicious score text.
ID_DIRT = '[" ]'
SCORE_DIRT = '["?]'
ILLEGAL_SCORE = "[^A-Za-z0-9 .-]"


def show_spaces(text: Column) -> Column:
    """Write each blank as the two characters backslash and s."""
    return F.replace(text, F.lit(" "), F.lit("\\s"))


def strip_chars(text: Column, pattern: str) -> Column:
    """Remove every match of a character class, ignoring case."""
    return F.regexp_replace(text, f"(?i){pattern}", "")


def has_illegal_chars(text: Column) -> Column:
    return text.rlike(ILLEGAL_SCORE)


def truncate(text: Column, length: int) -> Column:
    """Keep the first ``length`` characters, as a cast to a bounded text type does."""
    return F.left(text, F.lit(length))
