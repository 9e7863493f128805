"""SentencePiece encoding and decoding (merge models) with a prefix table.

Merge tokenisation has two properties.  The first tokens of an encoded text are the
encoding of the text they cover, so each prefix has one last token.  And a sequence of
tokens is an encoding if each neighbouring pair is one.  So, going once over a text, an
automaton gives the tokens that end at each place, longest first; the one whose
predecessor (the last token of the prefix before it) is compatible with it is the last
token of this prefix.  The ids are then read backwards from the end.

Two tokens are compatible if merging their joined characters never crosses their
border.  Each token's own merges are played once when the model is loaded; a pair is
then decided by playing both lists by score, the left one first on a tie, against the
piece that would join the two symbols at the border.

No piece holds a mark after another character (checked when the model is loaded), so
texts are cut before marks, and each task keeps the ids of the words it has met in a
bounded table, over slices of the texts; a worker that waits holds the model alone.
Characters without a piece become their bytes and nothing merges over them.

Defined results: null and empty texts have no ids and decode to an empty text; repeated
rows get the same answer; other columns are ignored or handed through.  Models with
user-defined or unused pieces, or with a normaliser that changes texts, are refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.common import in_slices

MARK = "▁"
#: Entries of each table that a task keeps.
CACHED = 400_000
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


def _marked_words(text: str) -> list[str]:
    """What follows the marks of a text; marks that follow marks belong to the next word."""
    if not text:
        return []
    if "  " in text or text[0] == " " or MARK in text:
        runs = _RUN.findall(MARK + text.replace(" ", MARK))
        return [run[1:] for run in runs]
    return text.split(" ")


def _merges(symbols: list[str], score: dict[str, float]) -> Iterator[float]:
    """Merge neighbours in place, best score first, leftmost on a tie; yields the scores."""
    while True:
        found = [
            (-score[pair], i)
            for i in range(len(symbols) - 1)
            if (pair := symbols[i] + symbols[i + 1]) in score
        ]
        if not found:
            return
        best, at = min(found)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        yield -best


class PieceModel:
    """The pieces of a model and what is derived from them."""

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = f" Aﬁ  é{MARK}\tz "
        if library.normalize(probe) != MARK + probe.replace(" ", MARK):
            raise ValueError("a model whose normaliser changes texts is not supported")
        ids = range(library.get_piece_size())
        if any(library.is_unused(i) for i in ids):
            raise ValueError("a model with unused pieces is not supported")
        self.pieces = [library.id_to_piece(i) for i in ids]
        self.plain = {
            self.pieces[i]: i
            for i in ids
            if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))
        }
        if any(MARK in piece.lstrip(MARK) for piece in self.plain):
            raise ValueError("a model with marks inside pieces is not supported")
        byte_ids = {self.pieces[i]: i for i in ids if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.byte_ids = [byte_ids.get(f"<0x{b:02X}>", self.unknown) for b in range(256)]
        self.score = {piece: library.get_score(i) for piece, i in self.plain.items()}
        #: Neighbouring characters of pieces: merges can go over nothing else.
        self.joints = {p[i : i + 2] for p in self.plain for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        #: Characters that merges can use though they are no pieces: bytes, if left alone.
        loose = sorted({c for piece in self.plain for c in piece} - self.plain.keys())
        self.loose = dict(enumerate(loose, len(self.pieces)))
        self.stride = len(self.pieces) + len(loose)
        self.letters = {c for piece in self.plain for c in piece}
        for i, piece in [*((i, piece) for piece, i in self.plain.items()), *self.loose.items()]:
            self._add(piece, i)
        self.automaton.make_automaton()
        self.outcome: dict[int, bool] = {}
        #: Ids of words with a mark before them, and of the parts of words of several.
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.texts = [self._bytes_of(i, library) for i in ids]

    def _bytes_of(self, i: int, library) -> bytes:
        if library.is_byte(i):
            return bytes([int(self.pieces[i][3:5], 16)])
        if library.is_control(i):
            return b""
        if library.is_unknown(i):
            return " ⁇ ".encode()
        return self.pieces[i].replace(MARK, " ").encode()

    def _add(self, piece: str, i: int) -> None:
        """Play the merges of a piece; pieces that merging cannot reach are left out."""
        symbols = list(piece)
        first, last = symbols[0], symbols[-1]
        played = [(best, symbols[0], symbols[-1]) for best in _merges(symbols, self.score)]
        if len(symbols) == 1:
            self.left[i] = first, [(best, symbol) for best, symbol, _ in played]
            self.right[i] = last, [(best, symbol) for best, _, symbol in played]
            self.automaton.add_word(piece, (i, len(piece)))

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both tokens ends in these two tokens."""
        key = a * self.stride + b
        found = self.outcome.get(key)
        if found is None:
            found = self.outcome[key] = self._stay_apart(a, b)
        return found

    def _stay_apart(self, a: int, b: int) -> bool:
        (last, mine), (first, yours) = self.right[a], self.left[b]
        i = j = 0
        while True:
            crossing = self.score.get(last + first)
            next_a = mine[i][0] if i < len(mine) else None
            next_b = yours[j][0] if j < len(yours) else None
            if crossing is not None and (next_a is None or crossing > next_a):
                if next_b is None or crossing >= next_b:
                    return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a >= next_b):
                last, i = mine[i][1], i + 1
            else:
                first, j = yours[j][1], j + 1

    def _encode_run(self, run: str) -> list[int]:
        """Ids of a run of known characters: prefix table, then backwards."""
        last = [-1] * (len(run) + 1)
        size = [0] * (len(run) + 1)
        for end, (token, length) in self.automaton.iter(run):
            end += 1
            if last[end] < 0:
                before = end - length
                if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                    last[end], size[end] = token, length
        backwards: list[int] = []
        end = len(run)
        while end:
            token = last[end]
            if token in self.loose:
                backwards += self._fallback(self.loose[token])[::-1]
            else:
                backwards.append(token)
            end -= size[end]
        return backwards[::-1]

    def _encode_word(self, word: str) -> bytes:
        """Ids of a mark and a word; parts between which no piece can reach are kept alone."""
        chunk, begin, found = MARK + word, 0, []
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1 : i + 1] not in self.joints:
                part = chunk[begin:i]
                ids = self.parts.get(part)
                if ids is None and not begin:
                    ids = self.words.get(part[1:])
                if ids is None:
                    run = self._encode_run if part[0] in self.letters else self._fallback
                    ids = np.array(run(part), "<i4").tobytes()
                    if len(part) < len(chunk):
                        self.parts[part] = ids
                found.append(ids)
                begin = i
        return b"".join(found)

    def _fallback(self, text: str) -> list[int]:
        return [self.byte_ids[b] for b in text.encode()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        for table in (self.words, self.parts, self.outcome):
            if len(table) > CACHED:
                table.clear()
        cut = [_marked_words(text) for text in texts]
        known = self.words
        for word in set().union(*cut):
            if word not in known:
                known[word] = self._encode_word(word)
        return [b"".join(map(known.__getitem__, words)) for words in cut]

    def forget(self) -> None:
        """Empty the tables of what was met in texts."""
        for table in (self.words, self.parts, self.outcome):
            table.clear()

    def decode(self, ids: list[int]) -> str:
        joined = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace")
        return joined.removeprefix(" ")


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    """The model of a file that every executor has at this path; loaded once per worker."""
    return PieceModel(path)


def _coded(model: PieceModel, texts: pa.Array) -> pa.Array:
    packed = model.encode([text or "" for text in texts.to_pylist()])
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    values = np.frombuffer(b"".join(packed), "<i4")
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    decoded = pa.array([model.decode(np.frombuffer(p, "<i4").tolist()) for p in packed], pa.string())
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
    return pa.StructArray.from_arrays([ids, decoded], ["ids", "decoded"])


def codec(path: str) -> Column:
    """struct(ids, decoded) of the text column it is applied to."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        try:
            for batch in batches:
                for texts in in_slices(batch):
                    yield _coded(model, texts)
        finally:
            model.forget()

    return encoded


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows: doc_id, ids and the text decoded from the ids."""
    found = docs.select("doc_id", codec(path)(F.coalesce(F.col(text), F.lit(""))).alias("p"))
    return found.select("doc_id", "p.ids", "p.decoded")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
