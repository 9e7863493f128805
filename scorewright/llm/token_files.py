"""Token ids of a corpus in range-coded files, in ascending order of the documents.

Texts are tokenised once and the ids written to the shared folder.  Their counts over
the whole corpus give one static frequency table.  The ids are then dealt out by ranges
of doc_id and sorted, and each task codes runs of whole documents as independent blocks
(see ``range_coder``): a row of the file holds a block with its document directory,
checkpoints and checksum.  Rows are written and committed by Spark, so a lost executor
costs a task, and any block can be read alone.

What the driver holds is bounded: the frequency table by the vocabulary, the totals by
the number of partitions.

Tokenising: no token of a byte-level vocabulary of the usual pattern goes from a
character that is not white space to one that is, so texts are cut at such places, and
each worker keeps the ids of the chunks it has met in a bounded table.  Other kinds of
tokenizer files get whole texts.

Defined results: null texts count as empty and get the end id alone; documents go by
doc_id (null last), rows of one id by the hash of their token ids, so any number of rows of
one id or without one is split over tasks; other columns are ignored.  An empty table gives
files without blocks and no rows.  A very long text is a row of the files like any other.
"""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.taskcontext import TaskContext

from scorewright.llm import range_coder
from scorewright.llm.common import in_groups
from scorewright.sources.storage import materialize

#: Unicode white space; a text without the rarer ones is cut faster.
_RARE = "\t\x0b\x0c\r\x85\xa0  -     　"
_CHUNK = re.compile(rf"[ \n{_RARE}]*[^ \n{_RARE}]+|[ \n{_RARE}]+")
#: The characters that stand for bytes in byte-level vocabularies: printable ones for
#: themselves, the others in order from U+0100.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
_SPELLING = "".join(chr(256 + _OTHER.index(b)) if b in _OTHER else chr(b) for b in range(256))
_SLOW = re.compile(f"[{_RARE}]")
#: A run of Latin letters is one unit of the pattern, and so is the run of ASCII marks after
#: it; an apostrophe may begin another kind of unit.
_LATIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: Words of ASCII without apostrophes fall into runs of letters, digits and marks.
_ASCII = re.compile(r"[!-&(-~]+")
_UNITS = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]+")
#: Words whose ids a worker keeps.
CACHED_WORDS = 500_000
#: Tokens of a block and of a partition of the files.
BLOCK_TOKENS = 1 << 19
PARTITION_TOKENS = 1 << 23
#: Partitions of the files at most; beyond, each holds more blocks.
MOST_PARTITIONS = 20_000

_BLOCK_SCHEMA = """
    part int, block int, start long, n_tokens long, lanes int, doc_ids array<long>,
    lengths array<long>, words binary, states binary, at array<long>, crc32 long
"""


class _Table(dict):
    """Ids of words.  A full table is followed by a new one that takes over what is used."""

    def __init__(self, tokens: Tokens, before: dict[str, bytes]):
        super().__init__()
        self.tokens, self.before = tokens, dict(before)

    def __missing__(self, word: str) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.tokens.learn(word)
        self[word] = found
        return found


class Tokens:
    """Ids of texts as little-endian integers of 16 bits, or of 32 for large vocabularies."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        shape = parts.get("pre_tokenizer") or {}
        self.by_chunk = (
            shape.get("type") == "ByteLevel"
            and shape.get("use_regex", True)
            and not shape.get("add_prefix_space")
            and not parts.get("normalizer")
            and (parts["model"].get("type"), parts["model"].get("dropout")) == ("BPE", None)
            and not any(
                re.search(r"\s", t["content"]) or t["content"].isalpha() or t["lstrip"] or t["rstrip"] or t["single_word"]
                for t in parts.get("added_tokens", [])
            )
        )
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        self.model = self.library.model
        self.size = self.library.get_vocab_size()
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype(f"<u{array(self.code).itemsize}")
        self.line_end = self._encode_chunk("\n")
        self.table = _Table(self, {})
        self.part = lru_cache(maxsize=20_000)(self._unit)

    def learn(self, word: str) -> bytes:
        """Ids of a word of a text as it stands after a space or, with it, a line end.

        The units of the pattern that such a word falls into go straight to the model, the
        first one with the space before it.
        """
        lead, rest = (self.line_end, word[1:]) if word[:1] == "\n" else (b"", word)
        latin = _LATIN.fullmatch(rest)
        if latin and not latin[2]:
            return lead + self._unit(rest if lead else " " + rest)
        if any(content in rest for content in self.added):
            return self._encode_chunk(word if lead else " " + word)
        if latin:
            return self.table[word[: -len(latin[2])]] + self.part(latin[2])
        if _ASCII.fullmatch(rest):
            first, *others = _UNITS.findall(rest)
            return lead + self.part(first if lead else " " + first) + b"".join(map(self.part, others))
        return self._encode_chunk(word if lead else " " + word)

    def _unit(self, unit: str) -> bytes:
        spelled = codecs.charmap_decode(unit.encode(), "strict", _SPELLING)[0]
        return array(self.code, [token.id for token in self.model.tokenize(spelled)]).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        ids = self.library.encode(chunk, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of whole texts."""
        if len(self.table) > CACHED_WORDS:
            self.table = _Table(self, self.table)
        look_up = self.table.__getitem__
        found = []
        for text in texts:
            words = self._words(text)
            if words:
                words[0] = "\n" + words[0]
                found.append(b"".join(map(look_up, words))[len(self.line_end) :])
            elif self.by_chunk:
                found.append(b"".join(map(self._encode_chunk, _CHUNK.findall(text))))
            else:
                found.append(self._encode_chunk(text))
        return found

    def _words(self, text: str) -> list[str]:
        """The words of a text with single spaces and line ends alone; empty for other texts."""
        if not self.by_chunk or text[:1] in ("", " ", "\n") or text[-1] in " \n":
            return []
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return []
        if any(c in text for c in "\t\x0b\x0c\r") if text.isascii() else _SLOW.search(text):
            return []
        return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=2)
def load(path: str) -> Tokens:
    """The tokenizer of a file that every executor has at this path; loaded once per worker."""
    return Tokens(path)


def token_ids(path: str, end_id: int) -> Column:
    """The ids of the text column it is applied to, with the end id, as packed integers."""
    @F.arrow_udf("binary")
    def packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = load(path)
        ending = np.array([end_id], tokens.kind).tobytes()
        for batch in batches:
            some = in_groups([text or "" for text in batch.to_pylist()])
            packed = [ids + ending for group in some for ids in tokens.encode(group)]
            yield pa.array(packed, pa.binary())

    return packed


def _counted(kind: np.dtype) -> Callable:
    """(id, n) of a partition."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            ids = b"".join(batch.column(0).to_pylist())
            now = np.bincount(np.frombuffer(ids, kind))
            if len(now) > len(counts):
                now, counts = counts, now
            counts[: len(now)] += now
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "n"])

    return counted


def _blocks(frequencies, kind: np.dtype) -> Callable:
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = range_coder.Table(frequencies.value)
        part, number, start = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        size = 0

        def finished() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            code = range_coder.encode(tokens, table)
            row = {
                "part": part, "block": number, "start": start, "n_tokens": len(tokens),
                "lanes": code.lanes, "doc_ids": doc_ids, "lengths": [len(p) for p in parts],
                "words": code.words, "states": code.states, "at": code.at, "crc32": code.crc32,
            }
            return pa.RecordBatch.from_pylist([row], _arrow_schema())

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                parts.append(np.frombuffer(ids.as_py(), kind))
                size += len(parts[-1])
                if size >= BLOCK_TOKENS:
                    yield finished()
                    number, start, size, doc_ids, parts = number + 1, start + size, 0, [], []
        if parts:
            yield finished()

    return coded


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = (part.split() for part in _BLOCK_SCHEMA.replace("\n", " ").split(","))
    return pa.schema([(name, kinds[kind]) for name, kind in fields])


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int, text: str = "text") -> None:
    """Write the ids of all documents and their frequency table below ``folder``."""
    spark, kind = docs.sparkSession, load(path).kind
    ids = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        token_ids(path, end_id)(F.coalesce(F.col(text), F.lit(""))).alias("ids"),
    )
    ids.write.option("compression", "zstd").parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    counted = ids.select("ids").mapInArrow(_counted(kind), "id long, n long")
    counts = counted.groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id
    seen = np.zeros(max((row["id"] for row in counts), default=0) + 1, np.int64)
    for row in counts:
        seen[row["id"]] = row["n"]
    frequencies = range_coder.shared_out(seen)
    table = [(i, int(f)) for i, f in enumerate(frequencies) if f]
    spark.createDataFrame(table, "id long, frequency long").coalesce(1).write.parquet(
        f"{folder}/frequencies"
    )
    n_parts = min(max(1, -(-int(seen.sum()) // PARTITION_TOKENS)), MOST_PARTITIONS)
    # Rows of one id are split by their ids' hash, rows that are alike by their place.
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("ids")]
    placed = ids.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(n_parts, *order, "place").sortWithinPartitions(*order, "ids")
    blocks = dealt.select("doc_id", "ids").mapInArrow(_blocks(spark.sparkContext.broadcast(frequencies), kind), _BLOCK_SCHEMA)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _decoded(frequencies) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = range_coder.Table(frequencies.value)
        for batch in batches:
            for row in batch.to_pylist():
                code = range_coder.Block(
                    row["n_tokens"], row["lanes"], row["words"], row["states"], row["at"], row["crc32"]
                )
                tokens = range_coder.decode(code, table).astype("<u4")
                sizes = np.array(row["lengths"], np.int64)
                ends = np.cumsum(sizes)
                offsets = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
                ids = pa.Array.from_buffers(
                    pa.binary(), len(sizes), [None, offsets, pa.py_buffer(tokens.tobytes())]
                )
                starts = pa.array(row["start"] + ends - sizes)
                doc_ids = pa.array(row["doc_ids"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, starts, pa.array(sizes), ids], ["doc_id", "start", "n_tokens", "ids"]
                )

    return read


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids (packed integers)."""
    rows = spark.read.parquet(f"{folder}/frequencies").collect()  # one row per id
    frequencies = np.zeros(max((row["id"] for row in rows), default=0) + 1, np.int64)
    for row in rows:
        frequencies[row["id"]] = row["frequency"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(  # one row per partition of the files
        totals.select(
            F.col("part").alias("of"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")
        ),
        "token-bases",
    )
    placed = blocks.join(bases, F.col("part") == F.col("of"))
    return placed.withColumn("start", F.col("base") + F.col("start")).mapInArrow(
        _decoded(spark.sparkContext.broadcast(frequencies)),
        "doc_id long, start long, n_tokens long, ids binary",
    )


def digests(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the checksum of the ids."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
