"""Line deduplication by a tree of line templates, in SQL functions only.

A line goes down a tree of fixed depth: by its number of tokens, by its leading tokens
(its first quarter), and by which of its other quarters may vary.  Tokens with a digit
are variable fields everywhere.  So a line has one template that fixes all four quarters
and, if it has at least ``Rule.variable`` tokens, three more, each of which leaves one
quarter open.  Lines that agree in a template differ in that field alone.

A template needs a share of constant tokens with a letter (``Rule.constant``); a line
whose own template has fewer is compared by its tokens as they are, so that rows of
numbers are alike only if the numbers are.

With ``Rule.leaf`` the fields of a line of three tokens or more are also decided by the
other documents: a line is in one leaf of the tree for each of its quarters with a word
(by its number of tokens and that quarter), and a token that too few texts of the leaf
have at its place is a field.  So any number of fields is open, in the first quarter too,
as long as one quarter has none.  Half of such a template must be constant, and two words.

A template recurs if at least ``Rule.documents`` documents with different texts have it
(exact copies of a document count once).  A line with a recurring template is dropped,
except in the document with the smallest doc_id that has the template; of several texts
of that id (rows without an id are of one id) the one with the smallest hash keeps it.

Lines are cut once and their 64-bit keys written; the keys are counted, combined before
the shuffle; only those of two texts or more are joined back to their lines and counted exactly, from a written table,
so that a line that a third of the documents share is split by Spark.

Defined results: null and empty texts have no lines to drop and stay as they are; lines
without tokens stay; repeated rows are copies and treated alike; a null doc_id counts as
the largest; other columns are handed through.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.common import SPACE
from scorewright.sources.storage import materialize

LAST_ID = 2**63 - 1
#: A token with a digit, from the start of the token on.
_FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*"
ANY = "<*>"


@dataclass(frozen=True)
class Rule:
    """Documents that make a template recur, and tokens from which a quarter may vary.

    ``constant``: least share of constant tokens with a letter in a template.  ``leaf``:
    least share of the texts of a leaf that have a constant token; 0 for no leaves.
    """

    documents: int = 5
    variable: int = 8
    constant: float = 1 / 3
    leaf: float = 0.0


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _rows(docs: DataFrame) -> DataFrame:
    """doc and th (which tells texts apart), and the whole row."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
        F.struct("*").alias("row"),
    )


def _quarter(i: int) -> Column:
    """The tokens of a quarter as one text."""
    begin, end = (F.floor(F.col("n") * k / 4).cast("int") for k in (i, i + 1))
    return F.array_join(F.slice("tokens", begin + 1, end - begin), " ")


def _lettered(quarter: Column) -> Column:
    """Constant tokens with a letter; fields have none."""
    return F.regexp_count(quarter, F.lit(r"\p{L}[^ ]*+"))


def _enough(rule: Rule, fixed: Iterable[int]) -> Column:
    """Whether the fixed quarters have the constant tokens that a template needs."""
    return sum(F.col(f"c{i}") for i in fixed) >= F.col("n") * F.lit(rule.constant)


def _masked(words: Column) -> Column:
    """The tokens of a line, those with a digit as fields."""
    masked = F.when(words.rlike("[0-9]"), F.regexp_replace(words, _FIELD, ANY)).otherwise(words)
    return F.filter(F.split(masked, SPACE), lambda t: t != "")


def _templates(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, th, line, key): each line under the keys of its templates."""
    whole = F.coalesce("text", F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(whole).alias("th"),
        F.posexplode(lines_of(whole)).alias("line", "words"),
    )
    tokens = _masked(F.col("words"))
    passed, more = [], []
    if rule.constant:
        passed = ["words"]
        more = ["words", *[_lettered(_quarter(i)).alias(f"c{i}") for i in range(4)]]
    counted = lines.select("doc", "th", "line", tokens.alias("tokens"), *passed)
    sized = counted.withColumn("n", F.size("tokens")).where("n > 0")
    hashed = sized.select(
        "doc", "th", "line", "n", *more, *[F.xxhash64(_quarter(i)).alias(f"q{i}") for i in range(4)]
    )
    fixed = F.xxhash64(F.lit(0), "n", "q0", "q1", "q2", "q3")
    open_ones = [
        F.xxhash64(F.lit(i), "n", *[f"q{j}" for j in range(4) if j != i]) for i in (1, 2, 3)
    ]
    if rule.constant:
        # Few lines get here, and only theirs are cut again.
        own = F.filter(F.split(F.col("words"), SPACE), lambda t: t != "")
        by_text = F.xxhash64(F.lit(4), F.array_join(own, " "))
        fixed = F.when(_enough(rule, (0, 1, 2, 3)), fixed).otherwise(by_text)
        open_ones = [
            F.when(_enough(rule, [j for j in range(4) if j != i]), key) for i, key in zip((1, 2, 3), open_ones)
        ]
    keys = F.when(F.col("n") >= rule.variable, F.array(fixed, *open_ones)).otherwise(F.array(fixed))
    exploded = hashed.select("doc", "th", "line", F.explode(keys).alias("key"))
    return exploded.where("key IS NOT NULL") if rule.constant else exploded


def _in_leaves(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, th, lines): the lines that are in leaves of enough texts, and those leaves."""
    whole = F.coalesce("text", F.lit(""))
    lines = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(whole).alias("th"),
        F.posexplode(lines_of(whole)).alias("line", "words"),
    )
    sized = lines.select("doc", "th", "line", _masked(F.col("words")).alias("tokens"))
    sized = sized.withColumn("n", F.size("tokens")).where("n > 2")
    leaves = [
        F.when(_lettered(_quarter(i)) > 0, F.xxhash64(F.lit(5 + i), "n", _quarter(i))) for i in range(4)
    ]
    rows = sized.select("doc", "th", "line", F.explode(F.array(*leaves)).alias("leaf"))
    cells = materialize(rows.where("leaf IS NOT NULL"), "line-leaves")
    several = materialize(
        cells.groupBy("leaf").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a < b").select("leaf"),
        "shared-leaves",
    )
    shared = materialize(cells.join(several, "leaf"), "lines-in-leaves")
    sizes = materialize(
        shared.groupBy("leaf", "th").agg(F.lit(1).alias("_"))
        .groupBy("leaf").agg(F.count("*").alias("texts"))
        .where(F.col("texts") >= rule.documents),
        "leaf-sizes",
    )
    of_line = shared.join(sizes, "leaf").groupBy("doc", "th", "line").agg(
        F.collect_set(F.struct("leaf", "texts")).alias("leaves")
    )
    return of_line.groupBy("doc", "th").agg(F.collect_list(F.struct("line", "leaves")).alias("lines"))


def _leaf_templates(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc, th, line, key): lines under the keys of what is constant in their leaves."""
    listed = materialize(_in_leaves(docs, rule), "leaves-of-texts")
    whole = F.coalesce("text", F.lit(""))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(whole).alias("th"),
        lines_of(whole).alias("all"),
    )
    words = F.transform(
        "lines", lambda l: F.struct(l["line"].alias("line"), l["leaves"].alias("leaves"), F.get("all", l["line"]).alias("words"))
    )
    found = texts.join(listed.hint("merge"), ["doc", "th"]).select("doc", "th", F.inline(words))
    # A token and its place as one number; the last bit says whether it has a letter.
    placed = F.transform(
        _masked(F.col("words")),
        lambda t, i: F.shiftleft(F.xxhash64(t, i), 1).bitwiseOR(t.rlike(r"\p{L}").cast("long")),
    )
    lines = materialize(
        found.select("doc", "th", "line", F.explode("leaves").alias("of"), placed.alias("tokens")).select(
            "doc", "th", "line", "of.leaf", "of.texts", "tokens"
        ),
        "leaf-lines",
    )
    of_texts = lines.select("leaf", "texts", "th", F.explode("tokens").alias("token"))
    counted = (
        of_texts.groupBy("leaf", "token", "th").agg(F.max("texts").alias("texts"))
        .groupBy("leaf", "token").agg(F.count("*").alias("have"), F.max("texts").alias("texts"))
        .where((F.col("have") >= rule.documents) & (F.col("have") >= F.col("texts") * F.lit(rule.leaf)))
    )
    constants = materialize(
        counted.groupBy("leaf").agg(F.collect_list("token").alias("constants")), "leaf-constants"
    )
    fixed = lines.join(constants, "leaf").select(
        "doc", "th", "line", "leaf",
        F.size("tokens").alias("n"), F.array_intersect("tokens", "constants").alias("fixed"),
    )
    lettered = F.size(F.filter("fixed", lambda t: t.bitwiseAND(F.lit(1)) == 1))
    least = F.greatest(F.lit(2), F.col("n") * F.lit(rule.constant))
    enough = (lettered >= least) & (2 * F.size("fixed") >= F.col("n"))
    return fixed.where(enough).select("doc", "th", "line", F.xxhash64("leaf", "fixed").alias("key"))


def dropped_lines(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc, th, lines): numbers of the lines to drop from each text."""
    keys = _templates(docs, rule)
    if rule.leaf:
        keys = keys.unionByName(_leaf_templates(docs, rule))
    lines = materialize(keys, "line-keys")
    several = materialize(
        lines.groupBy("key")
        .agg(F.min("doc").alias("first"), F.min("th").alias("a"), F.max("th").alias("b"))
        .where("a < b")
        .select("key", "first"),
        "line-templates",
    )
    again = materialize(lines.join(several, "key"), "templated-lines")
    texts = again.groupBy("key", "th").agg(F.min(F.col("doc") > F.col("first")).alias("later"))
    recurring = materialize(
        texts.groupBy("key")
        .agg(F.count("*").alias("texts"), F.min(F.when(~F.col("later"), F.col("th"))).alias("keeps"))
        .where(F.col("texts") >= rule.documents)
        .select("key", "keeps"),
        "recurring-templates",
    )
    dropped = again.join(recurring, "key").where("doc > first OR th <> keeps")
    return dropped.groupBy("doc", "th").agg(F.collect_set("line").alias("lines"))


def _without(dropped: Column, lines: Column) -> Column:
    numbers = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.transform(F.array_except(numbers, dropped), lambda i: F.get(lines, i))


def with_kept_text(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row, and its text without the dropped lines.

    The rows are always dealt out by their key: whether the dropped lines are few enough to
    be broadcast depends on the data.
    """
    found = materialize(dropped_lines(docs, rule), "dropped-lines")
    lines = lines_of(F.coalesce("row.text", F.lit("")))
    kept = F.when(
        F.col("lines").isNotNull(), F.array_join(_without(F.col("lines"), lines), "\n")
    ).otherwise(F.col("row.text"))
    return _rows(docs).join(found.hint("merge"), ["doc", "th"], "left").select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"),
        kept.alias("kept"),
    )


def without_recurring_lines(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The rows, all columns as they are, but for the texts, which lose the dropped lines."""
    changed = F.col("row").withField("text", F.col("kept"))
    return with_kept_text(docs, rule).select(changed.alias("row")).select("row.*")


def digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the kept lines joined by line ends)."""
    narrow = docs.select("doc_id", "text")
    return with_kept_text(narrow, rule).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )
