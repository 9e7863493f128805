"""Near duplicates by weighted MinHash signatures, bands and verified bag overlap.

A document is the bag of its five-word shingles.  Documents with the same bag are one
from the start.  The others get BagMinHash signatures (see ``bag_signatures``), whose
bands put them into buckets; buckets with the same members are one bucket.  In a bucket
all pairs are compared by their exact weighted Jaccard similarity, as bit sets inside a
task, and only links that join two classes leave it, so no pairs are handed on.

A large bucket is dealt into blocks.  First each block is compared together with a few
members that all its blocks share, which joins what is dense; then the members outside
the bucket's largest class are compared with all blocks.  So every pair of a bucket that
is not in one class by then has been compared, and no task holds more than two blocks.

With 24 bands of 4 slots a pair at the threshold of 0.8 shares a bucket with a
probability of 1 - (1 - 0.8 ** 4) ** 24 > 0.999996.

Defined results: a text of fewer words than a shingle is one shingle; texts without
words (null, empty) are each a class of their own, or all one class if ``Rule.wordless``
is set; repeated rows are copies; the member with the smallest doc_id (null last) stays;
other columns are ignored or handed through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm import bag_signatures
from scorewright.llm.components import components
from scorewright.sources.storage import materialize


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, least similarity, and the size of blocks of large buckets.

    ``wordless``: texts without words are copies of each other.
    """

    words: int = 5
    similarity: float = 0.8
    block: int = 512
    shared: int = 64
    wordless: bool = False


def bag_of(text: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles of a text and how often each occurs."""
    words = text.split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    single = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    shingles = single[: len(words) - k + 1].copy()
    for i in range(1, k):
        shingles *= np.uint64(0x9E3779B97F4A7C15)
        shingles += single[i : len(words) - k + 1 + i]
    shingles ^= shingles >> np.uint64(32)
    return np.unique(shingles, return_counts=True)


#: Shingles whose signatures are made in one go.
_GO = 300_000


def _signed(rule: Rule):
    """digest, bands and packed text of each document."""
    wordless = b"" if rule.wordless else None

    def group(texts: list[bytes], bags: list) -> pa.RecordBatch:
        tool = zstandard.ZstdCompressor(level=1)
        sizes = [len(bag[0]) for bag in bags]
        times = bag_signatures.signatures(
            len(bags),
            np.repeat(np.arange(len(bags)), sizes),
            np.concatenate([bag[0] for bag in bags]),
            np.concatenate([bag[1] for bag in bags]),
        )
        keys = bag_signatures.band_keys(bag_signatures.short(times))
        digests = [
            blake2b(b.tobytes() + n.tobytes(), digest_size=16).digest() if len(b) else wordless
            for b, n in bags
        ]
        offsets = np.arange(len(bags) + 1, dtype=np.int32) * keys.shape[1]
        bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
        packed = [tool.compress(text) for text in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), bands, pa.array(packed, pa.binary())],
            ["digest", "bands", "packed"],
        )

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, bags, size, begin = [], [], 0, 0
            for i, text in enumerate(batch.column(1).cast(pa.binary()), 1):
                texts.append(text.as_py())
                bags.append(bag_of(texts[-1], rule.words))
                size += len(bags[-1][0])
                if size >= _GO or i == batch.num_rows:
                    found = group(texts, bags)
                    doc_id, th = (batch.column(c).slice(begin, i - begin) for c in (0, 2))
                    yield pa.RecordBatch.from_arrays(
                        [doc_id, th, *found.columns], ["doc_id", "th", *found.schema.names]
                    )
                    texts, bags, size, begin = [], [], 0, i

    return made


def _bits(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Bit sets over the (shingle, occurrence) elements that several bags have."""
    owner = np.repeat(np.arange(len(bags)), [int(n.sum()) for _, n in bags])
    hashes = np.concatenate([np.repeat(h, n) for h, n in bags])
    turns = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for _, n in bags])
    order = np.lexsort((turns, hashes))
    first = np.ones(len(order), bool)
    same = (hashes[order][1:] == hashes[order][:-1]) & (turns[order][1:] == turns[order][:-1])
    first[1:] = ~same
    element = np.cumsum(first) - 1
    often = np.bincount(element) > 1
    column = (np.cumsum(often) - 1)[element]
    kept = often[element]
    width = -(-int(often.sum()) // 64)
    bits = np.zeros((len(bags), max(width, 1)), np.uint64)
    at = column[kept]
    np.bitwise_or.at(
        bits, (owner[order][kept], at // 64), np.uint64(1) << (at % 64).astype(np.uint64)
    )
    return bits


def links_within(bags: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[int, int]]:
    """A forest over the pairs of bags whose weighted Jaccard similarity is large enough."""
    bits = _bits(bags)
    sizes = np.array([n.sum() for _, n in bags], np.int64)
    root = np.arange(len(bags))
    found = []
    for i in range(len(bags) - 1):
        both = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
        alike = both >= similarity * (sizes[i] + sizes[i + 1 :] - both)
        for j in (np.flatnonzero(alike) + i + 1).tolist():
            if root[i] != root[j]:
                found.append((i, j))
                root[root == root[j]] = root[i]
    return found


def _compared(rule: Rule):
    """Links of each cell; the rows of a cell follow each other."""

    def links(uids: list[int], packed: list[bytes]) -> list[tuple[int, int]]:
        unpack = zstandard.ZstdDecompressor().decompress
        bags = [bag_of(unpack(p), rule.words) for p in packed]
        return [(uids[i], uids[j]) for i, j in links_within(bags, rule.similarity)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, uids, packed = None, [], []
        for batch in batches:
            found = []
            names = batch.schema.names
            cells = zip(*(batch.column(names.index(c)).to_pylist() for c in ("band", "key", "p", "q")))
            rows = zip(cells, batch.column(names.index("uid")).to_pylist(), batch.column(names.index("packed")))
            for of, uid, text in rows:
                if of != cell:
                    if len(uids) > 1:
                        found += links(uids, packed)
                    cell, uids, packed = of, [], []
                if not uids or uids[-1] != uid:
                    uids.append(uid)
                    packed.append(text.as_py())
            yield _edges(found)
        if len(uids) > 1:
            yield _edges(links(uids, packed))

    return made


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())],
        ["a", "b"],
    )


_CELL = ["band", "key", "p", "q"]


def _links(cells: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) between members of the same cell.

    The texts are always dealt out by their number: whether the cells are few enough to be
    broadcast depends on the data.
    """
    joined = cells.join(texts.hint("merge"), "uid").repartition(*_CELL).sortWithinPartitions(*_CELL, "uid")
    return materialize(joined.mapInArrow(_compared(rule), "a long, b long"), "near-links")


def _bucketed(bands: DataFrame) -> DataFrame:
    """(band, key, size, uid): the members of the different buckets of two or more."""
    rows = bands.select("uid", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(
        F.count("*").alias("size"),
        F.min("uid").alias("least"),
        F.max("uid").alias("most"),
        F.bit_xor(F.xxhash64("uid")).alias("members"),
    )
    several = buckets.where("size > 1").dropDuplicates(["size", "least", "most", "members"])
    kept = materialize(several.select("band", "key", "size"), "near-buckets")
    return materialize(rows.join(kept.hint("merge"), ["band", "key"]), "near-members")


def _in_blocks(members: DataFrame, rule: Rule) -> DataFrame:
    """The first cells: a block each, with the members that all blocks of a bucket share."""
    blocks = F.ceil(F.col("size") / rule.block).cast("int")
    own = F.pmod(F.xxhash64("uid"), blocks).cast("int")
    everywhere = F.pmod(F.xxhash64(F.col("uid"), F.lit(1)), F.col("size")) < rule.shared
    cells = F.when((blocks > 1) & everywhere, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))
    return members.select("band", "key", "uid", F.explode(cells).alias("p"), F.lit(-1).alias("q"))


def _across_blocks(large: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Cells of members outside the largest class (p) with all blocks (q) of a large bucket."""
    of = classes.select(F.col("node").alias("uid"), F.col("component").alias("class"))
    named = materialize(
        large.join(of, "uid", "left").withColumn("class", F.coalesce("class", "uid")), "near-large"
    )
    counts = named.groupBy("band", "key", "class").agg(F.count("*").alias("n"))
    largest = materialize(
        counts.groupBy("band", "key").agg(
            F.max_by("class", F.struct("n", "class")).alias("largest"),
            (F.sum("n") - F.max("n")).alias("outside"),
        ).where("outside > 0"),
        "near-largest",
    )
    rows = named.join(largest, ["band", "key"])
    q = F.pmod(F.xxhash64("uid"), F.ceil(F.col("size") / rule.block)).cast("int")
    n_q = F.ceil(F.col("size") / rule.block).cast("int")
    n_p = F.ceil(F.col("outside") / rule.block).cast("int")
    p = F.pmod(F.xxhash64(F.col("uid"), F.lit(2)), n_p).cast("int")
    every_p = rows.select("band", "key", "uid", F.explode(F.sequence(F.lit(0), n_p - 1)).alias("p"), q.alias("q"))
    every_q = rows.where("class <> largest").select(
        "band", "key", "uid", p.alias("p"), F.explode(F.sequence(F.lit(0), n_q - 1)).alias("q")
    )
    return every_p.unionByName(every_q)


def _text_hash(text: str) -> Column:
    """Tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")


def _signatures(docs: DataFrame, text: str, rule: Rule) -> DataFrame:
    """uid, doc_id, digest, bands, packed; written, so that the row numbers are fixed."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        _text_hash(text),
    )
    signed = rows.mapInArrow(
        _signed(rule), "doc_id long, th long, digest binary, bands array<long>, packed binary"
    )
    return materialize(signed.withColumn("uid", F.monotonically_increasing_id()), "near-signatures")


def classes(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """(uid, doc_id, th, class): the class of each row is the smallest uid in it."""
    return classes_of(_signatures(docs, text, rule), rule)


def classes_of(signed: DataFrame, rule: Rule = Rule()) -> DataFrame:
    same = materialize(
        signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("uid").alias("first")), "same-bags"
    )
    firsts = signed.join(same.select(F.col("first").alias("uid")), "uid", "left_semi")
    members = _bucketed(firsts.select("uid", "bands"))
    texts = signed.select("uid", "packed")
    edges = _links(_in_blocks(members, rule), texts, rule)
    large = members.where(F.col("size") > rule.block)
    if not large.isEmpty():
        cells = _across_blocks(large, components(edges), rule)
        edges = edges.unionByName(_links(cells, texts, rule))
    joined = components(edges)
    of = joined.select(F.col("node").alias("first"), "component")
    return (
        signed.select("uid", "doc_id", "th", "digest")
        .join(same, "digest", "left")
        .join(of, "first", "left")
        .select("uid", "doc_id", "th", F.coalesce("component", "first", "uid").alias("class"))
    )


def near_duplicates(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, kept."""
    return _named(materialize(classes(docs, text, rule), "near-classes")).drop("uid", "th")


def keep_one(docs: DataFrame, text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows that stay, one of each class, all columns as they are.

    Of rows with the same id and text one stays at most, as they are in one class.
    """
    named = _named(materialize(classes(docs, text, rule), "near-classes"))
    stays = named.where("kept").select(F.col("doc_id").alias("id"), "th")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc"), _text_hash(text).alias("hash"), F.struct("*").alias("row")
    )
    same = F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("th"))
    kept = rows.join(stays, same, "left_semi")
    return kept.dropDuplicates(["doc", "hash"]).select("row.*")


def _named(found: DataFrame) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    groups = materialize(
        found.groupBy("class").agg(F.min(order).alias("stays"), F.count("*").alias("class_size")),
        "near-groups",
    )
    return found.join(groups, "class").select(
        "uid",
        "th",
        "doc_id",
        F.col("stays.doc_id").alias("class_id"),
        "class_size",
        (F.col("uid") == F.col("stays.uid")).alias("kept"),
    )
