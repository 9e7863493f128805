"""Draw documents that look like a target corpus, by hashed n-gram importance weights.

Features are runs of 1 to ``longest`` consecutive words; their hashed buckets are counted
over all documents and over the target.  A bucket's gain is the logarithm of how much
likelier the target is to use it; a document's weight is the mean gain of its features.
Adding a Gumbel draw seeded by the id and taking the highest scores samples documents
without replacement in proportion to their importance.

Two passes read the texts.  In each, a task interns the n-grams of a block of words in an
open-addressed NumPy table: xxhash64 keys, linear probing, and a comparison of the bytes
wherever keys agree.  A slot stores its n-gram's bucket and count, so the first pass adds
up slots instead of occurrences; in the second, the slot of each occurrence gathers its
gain.  A block holds ``BLOCK_WORDS`` words at most, however long a text is, and a task
hands on one row per bucket and one per document.

The counts of the buckets (``buckets`` rows) are all that reaches the driver.  Ranks are
given over ranges of the scores (``ranking.place_by_range``), so no task sorts everything.

Defined results: null and empty texts have no features and weight 0; a null id is seeded as
the empty text; equal scores go by the smaller id (null last), then by the order in the
scored table; repeated rows are rows of their own; an empty table gives an empty result, an
empty target counts 0 for each bucket; texts of any length are read whole; other columns
are ignored by ``scores`` and kept by ``resample``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.operators.ranking import global_rank
from scorewright.sources.storage import materialize

#: Bytes of the texts, and words, that are worked on at once.
GROUP_BYTES = 4_000_000
BLOCK_WORDS = 100_000


@dataclass(frozen=True)
class Rule:
    longest: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


_SPACE = ord(" ")


def _word_bytes() -> np.ndarray:
    """What each byte stands for: digits, letters (A-Z lower-cased) and all bytes of
    characters beyond ASCII belong to words, the others become spaces."""
    table = np.full(256, _SPACE, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


_WORD_BYTES = _word_bytes()


@dataclass
class Words:
    """Words of several texts in ``data``, one space after each word; ``text`` numbers texts."""

    data: bytes
    begins: np.ndarray
    ends: np.ndarray
    text: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        none, end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        ended = pc.binary_join_element_wise(texts, none, end)
        _, offsets, data = ended.buffers()
        edges = np.frombuffer(offsets, np.int64)[ended.offset : ended.offset + len(ended) + 1]
        given = _WORD_BYTES[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]]
        inside = given != _SPACE
        after = np.concatenate([[False], inside[:-1]])
        kept = inside | after
        placed = np.cumsum(kept) - 1
        first = np.flatnonzero(inside & ~after)
        owner = np.searchsorted(edges - edges[0], first, side="right") - 1
        return cls(
            given[kept].tobytes(), placed[first], placed[np.flatnonzero(~inside & after)], owner
        )

    def runs(self, begin: int, end: int, longest: int) -> tuple[np.ndarray, ...]:
        """First byte, end and text of all runs that start with the words begin .. end - 1."""
        found = [(self.begins[begin:end], self.ends[begin:end], self.text[begin:end])]
        for more in range(1, longest):
            last = min(end + more, len(self.text))
            start, stop = slice(begin, last - more), slice(begin + more, last)
            whole = self.text[start] == self.text[stop]
            found.append((self.begins[start][whole], self.ends[stop][whole], self.text[start][whole]))
        return tuple(np.concatenate(part) for part in zip(*found))


class Interned:
    """The n-grams of a block: ``slot`` of each occurrence, ``bucket`` and ``count`` of each slot."""

    def __init__(self, data: bytes, begins: np.ndarray, ends: np.ndarray, buckets: int, key=None):
        lanes = _eight_bytes(data)
        lengths = ends - begins
        keys = (key or xxhash64)(data, lanes, begins, lengths)
        size = 1 << max(4, (2 * len(begins) - 1).bit_length())
        holder = np.full(size, -1, np.int64)  # the occurrence that a slot was made for
        self.slot = (keys & np.uint64(size - 1)).astype(np.int64)
        left = np.arange(len(begins))
        while len(left):
            at = self.slot[left]
            free = holder[at] < 0
            holder[at[free]] = left[free]  # of several for one free slot the last stays
            other = holder[at]
            same = (keys[other] == keys[left]) & (lengths[other] == lengths[left])
            same[same] = _same_bytes(lanes, begins, lengths, left[same], other[same])
            left = left[~same]
            self.slot[left] = (self.slot[left] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        used = np.flatnonzero(holder >= 0)
        made_for = holder[used]
        self.bucket[used] = crc32(data, lanes, begins[made_for], lengths[made_for]) % buckets


def _by_length(lengths: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of the n-grams of each length; those above ``longest`` come as one group."""
    short = np.minimum(lengths, longest + 1).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    edges = np.searchsorted(short[order], np.arange(longest + 3))
    for length, (begin, end) in enumerate(zip(edges, edges[1:])):
        if end > begin:
            yield length, order[begin:end]


#: The five primes of xxhash64.
_PRIMES = np.array(
    [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261],
    np.uint64,
)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(data: bytes, lanes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, those of one length at once; long ones by the library."""
    one, two, three, four, five = _PRIMES
    found = np.empty(len(begins), np.uint64)
    for length, which in _by_length(lengths, 31):
        at = begins[which]
        if length > 31:
            spans = zip(at.tolist(), lengths[which].tolist())
            found[which] = [xxhash.xxh64_intdigest(data[b : b + n]) for b, n in spans]
            continue
        h = np.full(len(at), five + np.uint64(length), np.uint64)
        done = 0
        while length - done >= 8:
            h ^= _turned(lanes[at + done] * two, 31) * one
            h = _turned(h, 27) * one + four
            done += 8
        if length - done >= 4:
            h ^= (lanes[at + done] & np.uint64(0xFFFFFFFF)) * one
            h = _turned(h, 23) * two + three
            done += 4
        while done < length:
            h ^= (lanes[at + done] & np.uint64(0xFF)) * five
            h = _turned(h, 11) * one
            done += 1
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
        found[which] = h ^ (h >> np.uint64(32))
    return found


def _crc_table() -> np.ndarray:
    """crc32 steps of each byte, by shifting out its eight bits."""
    table = np.arange(256, dtype=np.uint64)
    for _ in range(8):
        table = np.where(table & np.uint64(1), (table >> np.uint64(1)) ^ np.uint64(0xEDB88320), table >> np.uint64(1))
    return table


_CRC = _crc_table()


def crc32(data: bytes, lanes: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Checksums of n-grams, those of one length at once; long ones by the library."""
    found = np.empty(len(begins), np.int64)
    for length, which in _by_length(lengths, 63):
        at = begins[which]
        if length > 63:
            spans = zip(at.tolist(), lengths[which].tolist())
            found[which] = [zlib.crc32(data[b : b + n]) for b, n in spans]
            continue
        c = np.full(len(at), 0xFFFFFFFF, np.uint64)
        for done in range(0, length, 8):
            ahead = lanes[at + done]
            for _ in range(min(8, length - done)):
                c = _CRC[(c ^ ahead) & np.uint64(0xFF)] ^ (c >> np.uint64(8))
                ahead = ahead >> np.uint64(8)
        found[which] = (c ^ np.uint64(0xFFFFFFFF)).astype(np.int64)
    return found


def _eight_bytes(data: bytes) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def _same_bytes(
    lanes: np.ndarray, begins: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray
) -> np.ndarray:
    """Whether occurrences a and b, equal in length, have the same bytes."""
    same = np.ones(len(a), bool)
    open_ = np.flatnonzero(a != b)
    at = 0
    while len(open_):
        one, two = a[open_], b[open_]
        beyond = np.maximum(8 - (lengths[one] - at), 0).astype(np.uint64) * np.uint64(8)
        differ = (lanes[begins[one] + at] ^ lanes[begins[two] + at]) << beyond
        same[open_] = differ == 0
        at += 8
        open_ = open_[(differ == 0) & (lengths[one] > at)]
    return same


def _blocks(texts: pa.Array, rule: Rule) -> Iterator[tuple[Words, np.ndarray, Interned]]:
    """Words, text numbers of the occurrences, and interned n-grams, a block at a time."""
    words = Words.of(texts)
    for begin in range(0, len(words.text), BLOCK_WORDS):
        end = min(begin + BLOCK_WORDS, len(words.text))
        begins, ends, text = words.runs(begin, end, rule.longest)
        low, high = int(begins.min()), int(ends.max())
        data = words.data[low:high]
        yield words, text, Interned(data, begins - low, ends - low, rule.buckets)


def _groups(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of about ``GROUP_BYTES``, with the number of the first."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // GROUP_BYTES
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(column)]
    for begin, end in zip(edges, edges[1:]):
        if end > begin:
            yield begin, column.slice(begin, end - begin)


def _counting(rule: Rule):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for _, texts in _groups(batch.column(0)):
                for _, _, grams in _blocks(texts, rule):
                    totals += np.bincount(grams.bucket, grams.count, rule.buckets).astype(np.int64)
        met = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(totals[met])], ["bucket", "n"])

    return counted


def bucket_counts(docs: DataFrame, rule: Rule = Rule(), text: str = "text") -> DataFrame:
    """(bucket, n): occurrences of the features of all texts, of each bucket that occurs."""
    counted = docs.select(text).mapInArrow(_counting(rule), "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, rule: Rule = Rule()) -> np.ndarray:
    """The gain of each bucket, in thousandths of the natural logarithm."""
    found = []
    for corpus in (docs, target):
        counts = np.zeros(rule.buckets)
        for row in bucket_counts(corpus, rule).collect():  # one row per bucket at most
            counts[row["bucket"]] = row["n"]
        found.append(counts)
    s, t = found
    ratio = ((t + 1) * (s.sum() + rule.buckets)) / ((s + 1) * (t.sum() + rule.buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighing(shared, rule: Rule):
    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            n_words, n_features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, texts in _groups(batch.column(1)):
                rows = slice(first, first + len(texts))
                words = None
                for words, text, grams in _blocks(texts, rule):
                    of_slot = gain[grams.bucket]
                    n_features[rows] += np.bincount(text, minlength=len(texts))
                    sums = np.bincount(text, of_slot[grams.slot], len(texts))
                    total[rows] += sums.astype(np.int64)
                if words:
                    n_words[rows] = np.bincount(words.text, minlength=len(texts))
            weight = total // np.maximum(n_features, 1)
            values = [batch.column(0), *map(pa.array, (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(values, ["key", "n_words", "n_features", "weight"])

    return weighed


def _gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, from the hash of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, key: Column, target: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """key, n_words, n_features, weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains(docs, target, rule))
    rows = docs.select(key.alias("key"), F.col("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(
        _weighing(shared, rule), f"key {kind}, n_words long, n_features long, weight long"
    )


def scores(docs: DataFrame, target: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score, rank.

    ``rank`` counts the drawn documents from the highest score on; the others have none.
    """
    found = weights(docs, F.col("doc_id"), target, rule).withColumnRenamed("key", "doc_id")
    scored = found.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), rule.seed))
    return _drawn(scored, rule)


def _drawn(scored: DataFrame, rule: Rule) -> DataFrame:
    numbered = scored.withColumns(
        {
            "_out": F.col("n_words") < rule.least_words,
            "_down": -F.col("score"),
            "_null": F.col("doc_id").isNull(),
            "_row": F.monotonically_increasing_id(),
        }
    )
    written = materialize(numbered, "importance")
    eligible = written.where(~F.col("_out")).count()
    ranked = global_rank(written, ["_out", "_down", "_null", "doc_id", "_row"])
    drawn = F.col("rank") <= rule.percent * eligible // 100
    return ranked.withColumn("rank", F.when(drawn, F.col("rank"))).drop(
        "_out", "_down", "_null", "_row", "n"
    )


def resample(docs: DataFrame, target: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The drawn rows, with all their columns."""
    rows = materialize(
        docs.select(
            F.struct(*docs.columns).alias("row"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "numbered",
    )
    texts = rows.select("row.doc_id", "row.text", "uid")
    key = F.struct("doc_id", "uid")
    scored = weights(texts, key, target, rule).select("key.*", "n_words", "weight")
    scored = scored.withColumn("score", F.col("weight") + _gumbel(F.col("doc_id"), rule.seed))
    drawn = _drawn(scored, rule).where(F.col("rank").isNotNull()).select("uid")
    return rows.join(drawn, "uid", "left_semi").select("row.*")
