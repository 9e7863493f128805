"""Mixing sources to target weights.

Tokens (words) are added up per source.  The sources, in code point order with null
last, weigh ``weights`` in turn and share ``share`` times all tokens; no target goes
above ``cap`` times its source, and what is cut off is shared again by weight.  The
repetition rate of a source is target / size: each of its documents is emitted
floor(rate) times, and once more if its hash falls below the fraction.

The shared-out level is found in closed form on the one-row-per-source table, all sums
in integers; only the rates meet the documents, so a source that holds a third of all
rows costs no more than its rows (the join side is the small table, and Spark splits
or broadcasts by size).

Defined results: null texts count 0 words; null is a source of its own; a source
without words has target 0 and its documents are taken 0 times; every row draws for itself:
by its id (null too), source and text, and rows alike in all three by a number among them,
given in the order in which the table is read; an empty table gives no rows; a very long
text counts as a whole.  Clashing column names are left alone (rows travel as one struct).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.llm.common import n_words
from scorewright.operators.ranking import global_rank
from scorewright.sources.storage import materialize

WEIGHTS = (5, 2, 1)
#: Share of all tokens in per cent, and the most repeats of a source.
SHARE_PERCENT = 150
MOST_REPEATS = 2
SEED = "mix-1"


def targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share_percent: int = SHARE_PERCENT,
    most: int = MOST_REPEATS,
) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source is cut off if its fair part reaches most x size.  Sources are cut off in
    the order of most x size / weight, so running sums over that order give the level.
    """
    listed = Window.orderBy(F.col("source").isNull(), "source")
    turn = (F.row_number().over(listed) - 1) % len(weights) + 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn))
    limit = F.col("source_size") * most
    tight = Window.orderBy(limit / F.col("weight"), F.col("source").isNull(), "source")
    everything = tight.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    summed = weighted.withColumns(
        {
            "limit": limit,
            "full": F.sum("source_size").over(everything) * share_percent,
            "cut": F.coalesce(F.sum(limit).over(before), F.lit(0)) * 100,
            "open": F.sum("weight").over(everything)
            - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    # limit <= weight * (full - cut) / (100 * open), without a division
    is_cut = F.col("limit").cast("double") * 100 * F.col("open") <= (
        F.col("weight") * (F.col("full") - F.col("cut"))
    ).cast("double")
    flagged = summed.withColumn("is_cut", is_cut)
    # the first open row has the smallest "cut" and the largest "open"
    level = flagged.withColumns(
        {
            "level_cut": F.min(F.when(~F.col("is_cut"), F.col("cut"))).over(everything),
            "level_open": F.max(F.when(~F.col("is_cut"), F.col("open"))).over(everything),
        }
    )
    part = (F.col("weight") * (F.col("full") - F.col("level_cut"))).cast("double") / (
        F.col("level_open") * 100
    ).cast("double")
    target = F.when(F.col("is_cut"), F.col("limit").cast("double")).otherwise(part)
    return level.select("source", "source_size", target.alias("target"))


_KEY = ["id", "source", "digest"]


def _draw(seed: str) -> Column:
    """A number in [0, 1) from the id, the text's digest and the number among equal rows."""
    doc_id = F.coalesce(F.col("id"), F.lit("null"))
    key = F.concat_ws(":", F.lit(seed), doc_id, "digest", F.col("number").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / float(16**13)


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``number``: 0, 1, ... among rows with the same id, source and text.

    Only rows that are repeated are numbered; they are placed by ranges, so that any number
    of them is split.
    """
    again = materialize(
        rows.groupBy(*_KEY).agg(F.count("*").alias("rows")).where("rows > 1").select(*_KEY),
        "repeated-rows",
    )
    if again.isEmpty():
        return rows.withColumn("number", F.lit(0).cast("long"))
    same = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in _KEY])
    keys = rows.select(*_KEY, "uid").alias("l").join(again.alias("r"), same, "left_semi")
    numbers = global_rank(keys, ["uid"], within=_KEY).select(
        "uid", (F.col("rank") - 1).alias("number")
    )
    found = rows.join(materialize(numbers, "row-numbers"), "uid", "left")
    return found.withColumn("number", F.coalesce("number", F.lit(0).cast("long")))


def with_copies(
    docs: DataFrame, *columns: str, seed: str = SEED, **shares
) -> DataFrame:
    """(row, size, source_size, target, copies): how often each row of ``docs`` is emitted.

    ``row`` holds the named columns, or all.  The rates are written, one row per source,
    so that Spark knows their size when it chooses how to join them.
    """
    size = n_words(F.col("text")).alias("size")
    rows = _numbered(
        docs.select(
            F.struct(*(columns or ["*"])).alias("row"),
            F.col("doc_id").cast("string").alias("id"),
            "source",
            F.md5(F.coalesce("text", F.lit(""))).alias("digest"),
            size,
            F.monotonically_increasing_id().alias("uid"),
        )
    )
    sizes = docs.select("source", size).groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = materialize(
        targets(sizes, **shares).select(
            F.col("source").alias("of"),
            "source_size",
            "target",
            F.try_divide("target", "source_size").alias("rate"),
        ),
        "mix-rates",
    )
    whole = F.floor("rate")
    extra = (_draw(seed) < F.col("rate") - whole).cast("long")
    return rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).select(
        "row", "size", "source_size", "target", F.coalesce(whole + extra, F.lit(0)).alias("copies")
    )


def mix(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    drawn = with_copies(docs, seed=seed, **shares).where("copies > 0")
    repeated = drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")


def mix_report(docs: DataFrame, seed: str = SEED, **shares) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    return with_copies(docs, "doc_id", seed=seed, **shares).select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        "copies",
    )
