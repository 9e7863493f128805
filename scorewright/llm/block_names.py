"""Exact deduplication by deterministic block naming.

The white-space-normalised text of a document is cut into fixed-size byte blocks.
All distinct blocks of the corpus are sorted and get integer names.  Then adjacent
names are paired, the distinct pairs are sorted and get integer names, and so on,
until each document has one name.  Two documents have the same (level, name) if and
only if their normalised texts are the same: distinct blocks are told apart by their
content, never by a hash alone.

A block travels once, inside the distinct aggregate (combined before the shuffle, so a
block that a third of the rows share is small).  Everything else works on a skeleton
of block hashes.  Should two different blocks ever have one hash, they are given
different indices by their sorted content.

Defined results: null texts count as empty; an empty text is one empty block; repeated
rows are copies of each other and one of them stays; null doc_ids come last in the
choice of the row that stays; other columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.common import SPACE
from scorewright.sources.storage import materialize

BLOCK_BYTES = 4096


def _normalised(docs: DataFrame, text: str) -> DataFrame:
    spaced = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    return docs.withColumn("_bytes", F.encode(spaced, "UTF-8"))


def _blocks(size: int) -> Column:
    """The blocks of ``_bytes`` in order; binary substrings are cut without a scan."""
    last = F.greatest(F.ceil(F.length("_bytes") / size), F.lit(1)) - 1
    return F.transform(
        F.sequence(F.lit(0).cast("long"), last.cast("long")),
        lambda i: F.substring(F.col("_bytes"), i.cast("int") * size + 1, size),
    )


def _skeleton(rows: DataFrame, size: int) -> DataFrame:
    """One row per document: a row number, digest and the hashes of its blocks."""
    return materialize(
        rows.withColumn("_blocks", _blocks(size)).select(
            F.monotonically_increasing_id().alias("uid"),
            "doc_id",
            F.sha2("_bytes", 256).alias("text_sha256"),
            F.size("_blocks").alias("n"),
            F.transform("_blocks", lambda b: F.xxhash64(b)).alias("hashes"),
        ),
        "block-skeleton",
    )


def _numbered(values: DataFrame, *keys: str) -> DataFrame:
    """Distinct values in sorted order with increasing integer names, fixed by a write."""
    ordered = values.orderBy(*keys)
    return materialize(ordered.withColumn("name", F.monotonically_increasing_id()), "names")


def _hashes(rows: DataFrame, size: int) -> DataFrame:
    """(hash, contents): the number of different blocks behind each block hash."""
    blocks = rows.select(F.explode(_blocks(size)).alias("block"))
    contents = blocks.groupBy(F.xxhash64("block").alias("hash"), "block").agg(F.lit(1).alias("_"))
    return materialize(
        contents.groupBy("hash").agg(F.count("*").alias("contents")), "block-hashes"
    )


def _with_contents(rows: DataFrame, per_hash: DataFrame, size: int) -> DataFrame:
    """One row per block; blocks whose hash has several contents carry their bytes."""
    placed = rows.withColumn("uid", F.monotonically_increasing_id()).select(
        "uid",
        "doc_id",
        F.sha2("_bytes", 256).alias("text_sha256"),
        F.size(_blocks(size)).alias("n"),
        F.posexplode(_blocks(size)).alias("pos", "block"),
    )
    shared = per_hash.where("contents > 1").select("hash", F.lit(True).alias("shared"))
    marked = placed.withColumn("hash", F.xxhash64("block")).join(shared, "hash", "left")
    return materialize(
        marked.withColumn("block", F.when(F.col("shared"), F.col("block"))).drop("shared"),
        "shared-hash-blocks",
    )


def _first_names(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Documents (uid, doc_id, text_sha256, n) and their blocks (uid, pos, name)."""
    per_hash = _hashes(rows, size)
    if per_hash.where("contents > 1").isEmpty():
        skeleton = _skeleton(rows, size)
        names = _numbered(per_hash.select("hash"), "hash")
        places = skeleton.select("uid", F.posexplode("hashes").alias("pos", "hash"))
        named = places.join(names, "hash")
    else:
        places = _with_contents(rows, per_hash, size)
        skeleton = places.where("pos = 0")
        names = _numbered(places.select("hash", "block").distinct(), "hash", "block")
        same = (places["hash"] == names["hash"]) & places["block"].eqNullSafe(names["block"])
        named = places.join(names, same)
    docs = skeleton.select("uid", "doc_id", "text_sha256", "n")
    return docs, materialize(named.select("uid", "pos", "name"), "block-names")


def _paired(names: DataFrame) -> DataFrame:
    """Names of a level in adjacent pairs; -1 stands for a missing right part."""
    left, right = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
    return names.groupBy("uid", "depth", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
        F.max(F.when(left, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(right, F.col("name"))), F.lit(-1)).alias("b"),
    )


def identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, text_sha256, level, name), one row for each row of ``docs``.

    A document of n blocks has one name after ceil(log2 n) levels.
    """
    rows = _normalised(docs.select("doc_id", F.col(text).alias("_text")), "_text")
    skeleton, current = _first_names(rows, block_bytes)
    depths = materialize(
        skeleton.select("uid", F.ceil(F.log2("n")).cast("int").alias("depth")), "block-depths"
    )
    deepest = depths.agg(F.max("depth")).first()[0] or 0
    current = current.join(depths, "uid")
    done = [current.where("depth = 0").selectExpr("uid", "depth AS level", "name")]
    for level in range(1, deepest + 1):
        pairs = materialize(_paired(current.where(F.col("depth") >= level)), "name-pairs")
        names = _numbered(pairs.select("a", "b").distinct(), "a", "b")
        current = materialize(pairs.join(names, ["a", "b"]).drop("a", "b"), "pair-names")
        done.append(
            current.where(F.col("depth") == level).selectExpr("uid", "depth AS level", "name")
        )
    return skeleton.drop("n").join(reduce(DataFrame.unionByName, done), "uid")


def exact_duplicates(
    docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    named = materialize(identities(docs, text, block_bytes), "identities")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    groups = materialize(
        named.groupBy("level", "name").agg(
            F.min(order).alias("stays"), F.count("*").alias("group_size")
        ),
        "identity-groups",
    )
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        "group_size",
        (F.col("uid") == F.col("stays.uid")).alias("kept"),
        "text_sha256",
    )
