"""Repeated passages by a compacted graph of token k-mers.

The edges of the graph are the windows of ``window`` words.  Consecutive edges that have
the same smallest inner k-mer (their anchor) travel as one bundle, with a digest of the
words they cover: equal windows have equal anchors, so equal edges meet at one anchor.

1. Bundles are counted by anchor.  Anchors within one document are unique paths and go
   out.  Where all bundles of an anchor are equal the graph does not branch there.
2. Non-branching bundles that follow each other, each being the only neighbour of the
   other, are compacted into paths by joining them with their anchors.  A path has one
   source: its first document.  A checksum over its bundles finds the coordinates of its
   span there; a span is taken only with them.  Neighbours are compared by a part of their
   digests, so a path may run on too far: it is not found in its source, and all bundles
   with its anchors go to step 3.
3. At branching anchors the single edges decide: the texts of one copy of each different
   bundle are read again, and their windows are counted by anchor and digest.

An edge that also starts in a document with a smaller id is a repeat; all words under
repeats are removed.  Windows are judged on the input.

Bundles are made twice instead of being stored, and texts travel packed.  Counting
combines before the shuffle; the joins have written tables on both sides, so that Spark
splits a passage that a third of the documents share.  Digests have 64 bits and are only
compared under one 64-bit anchor.

Defined results: null texts have no words; texts shorter than a window keep all words;
rows with the same doc_id are no repeats of each other, and rows of one id and one text go
through the graph once, however many there are; a null doc_id counts as the largest; repeats
within one document stay; a very long text is bundled whole, in one task; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from scorewright.sources.storage import materialize

#: Stands for a null doc_id: larger than any other.
LAST_ID = 2**63 - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xFF51AFD7ED558CCD)


@dataclass(frozen=True)
class Shape:
    """Words of a window (an edge) and of the k-mers that anchor it.

    ``near_bits``: bits of a neighbouring bundle's digest that travel with a bundle.
    """

    window: int = 50
    anchor: int = 16
    near_bits: int = 32


def _digest(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)


def anchors_of(words: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """For each window, the place of its smallest k-mer (the first on a tie), and all hashes."""
    k = shape.anchor
    single = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    kmers = single[: len(words) - k + 1].copy()
    for i in range(1, k):
        kmers *= _MIX
        kmers += single[i : len(words) - k + 1 + i]
    kmers ^= kmers >> np.uint64(33)
    kmers *= _MIX2
    kmers ^= kmers >> np.uint64(29)
    inner = shape.window - k + 1
    places = np.lib.stride_tricks.sliding_window_view(kmers, inner).argmin(axis=1)
    return places + np.arange(len(places)), kmers


def _bundles_of(text: bytes, shape: Shape) -> list[np.ndarray] | None:
    """anchor, digest, start, n, before, after of the bundles of a text."""
    words = text.split()
    if len(words) < shape.window:
        return None
    places, kmers = anchors_of(words, shape)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
    ends = np.append(starts[1:], len(places))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    lows, highs = offsets[starts].tolist(), (offsets[ends + shape.window - 1] - 1).tolist()
    digests = np.array([_digest(joined[a:b]) for a, b in zip(lows, highs)], np.int64)
    short = (digests & ((1 << shape.near_bits) - 1)).astype(np.uint32).view(np.int32)
    before = np.concatenate([[0], short[:-1]])
    after = np.append(short[1:], 0)
    return [kmers[places[starts]].view(np.int64), digests, starts, ends - starts, before, after]


_BUNDLE = "anchor long, digest long, doc long, th long, start int, n int, before int, after int"


def _bundled(shape: Shape):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "doc", "th", "start", "n", "before", "after"]
        kinds = [np.int64, np.int64, np.int64, np.int64, np.int32, np.int32, np.int32, np.int32]
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            columns: list[list[np.ndarray]] = [[] for _ in names]
            for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                found = _bundles_of(text.as_py(), shape)
                if found is None:
                    continue
                size = len(found[0])
                found[2:2] = [np.full(size, doc, np.int64), np.full(size, th, np.int64)]
                for column, values in zip(columns, found):
                    column.append(values)
            if columns[0]:
                arrays = [pa.array(np.concatenate(c).astype(t)) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return made


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """doc (id for comparing), th (tells rows with the same id apart), text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64(whole).alias("th"),
        whole.alias("text"),
    )


def _once(texts: DataFrame) -> DataFrame:
    """Each text of an id once; only rows that occur again are dealt by their key."""
    key = ["doc", "th"]
    again = materialize(
        texts.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key),
        "repeated-rows",
    )
    if again.isEmpty():
        return texts
    several = texts.join(again, key, "left_semi").groupBy(*key).agg(F.first("text").alias("text"))
    return texts.join(again, key, "left_anti").unionByName(several)


def _anchors(bundles: DataFrame) -> DataFrame:
    """Anchors that several documents have, with their first document and how they branch."""
    both = [f(c).alias(f"{f.__name__}_{c}") for c in ("doc", "digest", "before", "after") for f in (F.min, F.max)]
    counted = bundles.groupBy("anchor").agg(*both)
    return materialize(
        counted.where("min_doc < max_doc").select(
            "anchor",
            F.col("min_doc").alias("source"),
            (F.col("min_digest") == F.col("max_digest")).alias("whole"),
            (F.col("min_before") == F.col("max_before")).alias("one_before"),
            (F.col("min_after") == F.col("max_after")).alias("one_after"),
        ),
        "span-anchors",
    )


def _paths(bundles: DataFrame) -> DataFrame:
    """Spans of compacted paths: doc, th, start, n, head, checksum, source."""
    order = Window.partitionBy("doc", "th").orderBy("start")
    follows = (F.lag(F.col("start") + F.col("n")).over(order) == F.col("start")) & (
        F.lag("one_after").over(order) & F.col("one_before")
    )
    linked = bundles.withColumn("begins", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    numbered = linked.withColumn("path", F.sum("begins").over(order))
    return numbered.groupBy("doc", "th", "path").agg(
        F.min("start").alias("start"),
        F.sum("n").cast("int").alias("n"),
        F.max(F.when(F.col("begins") == 1, F.col("digest"))).alias("head"),
        F.bit_xor("digest").alias("checksum"),
        F.min("source").alias("source"),
    )


def _placed(paths: DataFrame) -> DataFrame:
    """Spans outside their source, with the start of the same path there; null if it has none."""
    sources = materialize(
        paths.where("doc = source")
        .groupBy("head", "checksum", "n", "source")
        .agg(F.min("start").alias("source_start")),
        "span-sources",
    )
    copies = paths.where("doc > source").select("doc", "th", "start", "n", "head", "checksum", "source")
    found = copies.join(sources, ["head", "checksum", "n", "source"], "left")
    return materialize(found.select("doc", "th", "start", "n", "source", "source_start"), "placed-spans")


def _of_unplaced(bundles: DataFrame, placed: DataFrame) -> DataFrame | None:
    """All bundles with an anchor that a span without coordinates goes through."""
    lost = placed.where("source_start IS NULL").select("doc", "th", F.col("start").alias("low"), "n")
    if lost.isEmpty():
        return None
    spans = lost.groupBy("doc", "th").agg(
        F.collect_list(F.struct("low", (F.col("low") + F.col("n")).alias("high"))).alias("lost")
    )
    inside = F.exists("lost", lambda s: F.col("start").between(s["low"], s["high"] - 1))
    anchors = bundles.join(spans, ["doc", "th"]).where(inside).select("anchor").distinct()
    return bundles.join(materialize(anchors, "unplaced-anchors"), "anchor", "left_semi")


_EDGE = "anchor long, edge long, bundle long, i int, first long, last long"


def _edges_of(shape: Shape):
    """Windows of the listed bundles, from packed texts."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed, listed in zip(batch.column(0), batch.column(1)):
                words = unpack(packed.as_py()).split()
                rows = [
                    (b["anchor"], _digest(b" ".join(words[at : at + shape.window])), b["bundle"], at - b["start"], b["first"], b["last"])
                    for b in listed.as_py()
                    for at in range(b["start"], b["start"] + b["n"])
                ]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(
                    arrays, ["anchor", "edge", "bundle", "i", "first", "last"]
                )

    return made


def _branching(bundles: DataFrame, packed: DataFrame, shape: Shape) -> DataFrame:
    """Repeated edges of branching bundles: doc, th, and a list of (start, n)."""
    different = materialize(
        bundles.groupBy("anchor", "digest")
        .agg(
            F.min(F.struct("doc", "th", "start", "n")).alias("copy"), F.max("doc").alias("last")
        )
        .select("anchor", "digest", "copy.*", "last")
        .withColumn("bundle", F.monotonically_increasing_id()),
        "span-bundles",
    )
    listed = different.groupBy("doc", "th").agg(
        F.collect_list(
            F.struct("anchor", "bundle", "start", "n", F.col("doc").alias("first"), "last")
        ).alias("bundles")
    )
    again = packed.join(listed, ["doc", "th"]).select("packed", "bundles")
    edges = materialize(again.mapInArrow(_edges_of(shape), _EDGE), "span-edges")
    firsts = materialize(
        edges.groupBy("anchor", "edge")
        .agg(F.min("first").alias("source"), F.max("last").alias("latest"))
        .where("source < latest"),
        "span-edge-sources",
    )
    repeated = (
        edges.join(firsts, ["anchor", "edge"])
        .where("source < last")
        .groupBy("bundle")
        .agg(F.collect_list(F.struct("i", "source")).alias("edges"))
    )
    of_bundle = materialize(
        different.select("anchor", "digest", "bundle").join(repeated, "bundle").drop("bundle"),
        "span-repeats",
    )
    later = F.transform(
        F.filter("edges", lambda e: e["source"] < F.col("doc")),
        lambda e: F.struct((F.col("start") + e["i"]).alias("start"), F.lit(1).alias("n")),
    )
    return (
        bundles.join(of_bundle, ["anchor", "digest"])
        .select("doc", "th", later.alias("spans"))
        .where(F.size("spans") > 0)
    )


def _packed(texts: DataFrame) -> DataFrame:
    """doc, th, and the text packed for travelling."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            small = pa.array([tool.compress(t.as_py()) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), small], ["doc", "th", "packed"]
            )

    return texts.mapInArrow(pack, "doc long, th long, packed binary")


@dataclass(frozen=True)
class Repeats:
    """What was found: spans of paths, and single edges at branches."""

    paths: DataFrame
    edges: DataFrame
    packed: DataFrame


def find_repeats(docs: DataFrame, text: str = "text", shape: Shape = Shape()) -> Repeats:
    """Spans that also stand in a document with a smaller id.

    ``paths``: doc, th, start, n (windows), source, source_start; ``edges``: doc, th, spans.
    """
    once = _once(_texts(docs, text))
    bundles = once.mapInArrow(_bundled(shape), _BUNDLE)
    anchors = _anchors(bundles)
    repeated = materialize(
        bundles.drop("before", "after").join(anchors, "anchor"), "span-repeated-bundles"
    )
    placed = _placed(materialize(_paths(repeated.where("whole")), "span-paths"))
    columns = ["anchor", "digest", "doc", "th", "start", "n"]
    branching = repeated.where("NOT whole").select(*columns)
    unplaced = _of_unplaced(repeated.where("whole").select(*columns), placed)
    if unplaced is not None:
        branching = branching.unionByName(unplaced)
    return Repeats(
        placed.where("source_start IS NOT NULL"),
        _branching(branching, _packed(once), shape),
        _packed(_texts(docs, text)),
    )


def _kept(shape: Shape):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts, removed = [], []
            for packed, spans in zip(batch.column(1), batch.column(2)):
                words = unpack(packed.as_py()).split()
                gone = np.zeros(len(words) + 1, np.int64)
                for span in spans.as_py() or ():
                    gone[span["start"]] += 1
                    gone[min(len(words), span["start"] + span["n"] + shape.window - 1)] -= 1
                under = np.cumsum(gone[:-1]) > 0
                removed.append((len(words), int(under.sum())))
                if removed[-1][1]:
                    words = [word for word, out in zip(words, under.tolist()) if not out]
                texts.append(b" ".join(words))
            counts = [pa.array(c, pa.int64()) for c in zip(*removed)] or [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc", "n_words", "n_removed", "kept"],
            )

    return made


def without_repeats(docs: DataFrame, text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (words joined by spaces)."""
    found = find_repeats(docs, text, shape)
    spans = found.paths.select("doc", "th", F.array(F.struct("start", "n")).alias("spans"))
    of_doc = materialize(
        spans.unionByName(found.edges)
        .groupBy("doc", "th")
        .agg(F.flatten(F.collect_list("spans")).alias("spans")),
        "span-removals",
    )
    joined = found.packed.join(of_doc, ["doc", "th"], "left").select("doc", "packed", "spans")
    kept = joined.mapInArrow(_kept(shape), "doc long, n_words long, n_removed long, kept string")
    return kept.select(
        F.nullif("doc", F.lit(LAST_ID)).alias("doc_id"), "n_words", "n_removed", "kept"
    )


def digests(kept: DataFrame) -> DataFrame:
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
