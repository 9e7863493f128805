"""Chat formatting in budgeted windows, in SQL functions only.

Template: ``<|turn|>ROLE<|text|>TEXT<|end|>`` for each turn.  In roles and texts every
backslash is doubled, and a backslash is put after the first character of each control
string (of this template and of the common bracket templates), so that no text can
close or open a turn; dropping the backslashes undoes it.

Windows: a turn costs its words plus a fixed overhead.  Prefix sums of the costs cut
a conversation into spans at multiples of the room in a window; a turn that crosses a
multiple is a span of its own.  A span therefore fits the room unless it is one turn
longer than the room.  Each window holds the system turn (the first turn, if its role
is system), as many turns before the span as fit the history budget, and the span.
Loss is on the assistant turns of the span alone: the repeated ones are masked, so each
assistant text is a target exactly once.

Defined results: null roles and texts count as empty; rows of one conversation go by
turn (null first), then role, then text, so repeated rows are repeated turns; rows with
a null conv_id form one conversation; other columns are ignored.  An empty table gives
no rows.  The prefix sum and the digest of one conversation are made in one task, as a
digest of the whole conversation needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from scorewright.llm.common import n_words
from scorewright.sources.storage import materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: First characters of control strings, where the rest of one follows.
_CONTROL = r"<(?=\||/?s>|/?<?/?SYS>)|\[(?=/?INST\])"
#: Words that the markers of a turn count for.
OVERHEAD = 4


@dataclass(frozen=True)
class Budget:
    """Words of a window and of the repeated history in it."""

    window: int = 512
    history: int = 128


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their number and the prefix sum of costs before the non-system ones."""
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("nr", F.row_number().over(order) - 1)
    is_system = (F.col("nr") == 0) & (F.col("role") == "system")
    cost = n_words(F.col("text")) + OVERHEAD
    by_number = Window.partitionBy("conv_id").orderBy("nr")
    return numbered.select(
        "conv_id",
        "nr",
        "role",
        F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
        is_system.alias("is_system"),
        F.when(is_system, 0).otherwise(cost).alias("cost"),
        F.when(is_system, cost).otherwise(0).alias("system_cost"),
    ).withColumns(
        {
            "after": F.sum("cost").over(by_number),
            "system_cost": F.max("system_cost").over(
                by_number.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        }
    )


def _spans(turns: DataFrame, budget: Budget) -> DataFrame:
    """Turns with ``span`` (first number of their span) and ``begin`` (costs before it)."""
    room = F.greatest(
        F.lit(budget.window - budget.history) - F.col("system_cost"), F.lit(budget.window // 4)
    )
    before = F.col("after") - F.col("cost")
    cell = F.floor(F.greatest(F.col("after") - 1, F.lit(0)) / room)
    crosses = (before < cell * room) & ~F.col("is_system")
    order = Window.partitionBy("conv_id").orderBy("nr")
    key = F.struct(F.col("cell"), F.col("crosses"))
    keyed = turns.withColumns({"cell": cell, "crosses": crosses, "before": before})
    starts = keyed.withColumn(
        "starts", (F.col("nr") == 0) | (key != F.lag(key).over(order)) | F.col("crosses")
    )
    last_start = F.last(
        F.when(F.col("starts"), F.struct(F.col("nr").alias("span"), F.col("before").alias("begin"))),
        ignorenulls=True,
    ).over(order)
    return starts.withColumn("at", last_start).select(
        "conv_id", "nr", "role", "head", "body", "is_system", "before", "after",
        F.col("at.span").alias("span"), F.col("at.begin").alias("begin"),
    )


def _repeats(turns: DataFrame, budget: Budget) -> DataFrame:
    """The turns that windows repeat before their own: the system turn and the history.

    A repeated turn lies within ``history`` costs before the span, so it is found by an
    equality join on the costs divided by ``history``; each turn costs at least the
    overhead, so at most history / overhead windows repeat it.
    """
    spans = turns.where("nr = span").select(F.col("conv_id").alias("c"), "span", "begin")
    parts = ["nr", "head", "body"]
    size = budget.history
    old = turns.where(~F.col("is_system"))
    cell = F.floor(F.col("after") / size)
    reach = old.withColumn("cell", F.explode(F.array(cell, cell + 1)))
    near = spans.withColumn("cell", F.floor(F.col("begin") / size))
    in_reach = (
        F.col("conv_id").eqNullSafe(F.col("c"))
        & (reach["cell"] == near["cell"])
        & (F.col("nr") < near["span"])
        & (F.col("after") <= near["begin"])
        & (F.col("before") >= near["begin"] - size)
    )
    history = near.join(reach.drop("span", "begin"), in_reach).select("conv_id", "span", *parts)
    system = turns.where("is_system").drop("span", "begin")
    always = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") > 0)
    kept = spans.join(system, always).select("conv_id", "span", *parts)
    return history.unionByName(kept)


def windows(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """One row per window: conv_id, span, formatted, n_repeated, loss.

    ``formatted`` is the text of the window; its first ``n_repeated`` turns are repeated
    ones; ``loss`` lists (start, length) in code points of the parts that are targets.
    """
    turns = materialize(_spans(_turns(conversations), budget), "chat-turns")
    own = turns.select(
        "conv_id", "span", "nr", "head", "body", (F.col("role") == "assistant").alias("target")
    )
    repeated = _repeats(turns, budget).withColumn("target", F.lit(None).cast("boolean"))
    length = F.length("head") + F.length("body") + len(END)
    placed = own.unionByName(repeated).withColumn("length", length)
    order = Window.partitionBy("conv_id", "span").orderBy("nr")
    at = F.sum("length").over(order) - F.col("length") + F.length("head")
    rendered = placed.withColumn("at", at).select(
        "conv_id",
        "span",
        F.struct(
            "nr",
            F.concat("head", "body", F.lit(END)).alias("text"),
            "target",
            F.struct(F.col("at").alias("start"), F.length("body").alias("length")).alias("part"),
        ).alias("t"),
    )
    grouped = rendered.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select(
        "conv_id",
        "span",
        F.array_join(F.col("t.text"), "").alias("formatted"),
        F.size(F.filter("t", lambda t: t["target"].isNull())).alias("n_repeated"),
        F.transform(F.filter("t", lambda t: t["target"]), lambda t: t["part"]).alias("loss"),
    )


def parsed_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a window, read back from its text."""
    pieces = F.split(formatted, r"<\|end\|>")
    return F.transform(
        F.filter(pieces, lambda p: p != ""),
        lambda p: F.struct(
            unescape(F.substring_index(F.substring(p, len(TURN) + 1, 2**30), TEXT, 1)).alias("role"),
            unescape(F.substring_index(p, TEXT, -1)).alias("text"),
        ),
    )


def digests(read_back: DataFrame) -> DataFrame:
    """Per conversation, what its windows say: turns, targets and their digests."""
    own = F.expr("slice(turns, n_repeated + 1, size(turns))")
    lines = F.transform(
        F.col("own"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    targets = F.transform(
        "loss", lambda p: unescape(F.col("formatted").substr(p["start"].cast("int") + 1, p["length"]))
    )
    per_window = (
        read_back.withColumn("turns", parsed_turns(F.col("formatted")))
        .withColumn("own", own)
        .select(
            "conv_id",
            F.size("own").alias("n"),
            F.length("formatted").alias("chars"),
            F.struct(
                "span",
                F.array_join(lines, "").alias("turns"),
                F.array_join(targets, "").alias("loss"),
            ).alias("w"),
        )
    )
    whole = per_window.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list("w")).alias("w"),
    )
    loss = F.array_join(F.col("w.loss"), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("w.turns"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def formatted_chats(conversations: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Write the windows, read them back and report each conversation."""
    return digests(materialize(windows(conversations, budget), "chat-windows"))
