"""Token files, the range coder and the piece codec against the libraries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers

from scorewright.llm import piece_codec, range_coder, token_files
from scorewright.sources.storage import new_path
from tests.llm.odd import TEXTS, no_docs, odd_docs

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(parts, n, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_of_odd_texts(path):
    library = tokenizers.Tokenizer.from_file(path)
    parts = ["foo", " bar", "<|endoftext|>", "'s", " ", "\n", "  ", "12", "é", " ", "\x1c", "!?", "中", "don't", "ends.", "ɑa"]
    texts = random_texts(parts, 3000, 1)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    tokens = token_files.load(path)
    assert [np.frombuffer(f, tokens.kind).tolist() for f in tokens.encode(texts)] == expected


def test_ids_of_words_that_fall_into_units():
    """Letters, digits, marks and added tokens next to one another, with Latin and other letters."""
    library = tokenizers.Tokenizer.from_file(BYTES)
    parts = ["ab", " cd", "<|endoftext|>", "<|", "|>", "'s", "12", "...", "!!", "@x.y", "A1b2", "²", "ª", "µ", "×", "ÿ", "ɐ", "ʰ", "İ", "\x1c", "\x7f", "\x00", "\n"]
    texts = random_texts(parts, 6000, 7)
    tokens = token_files.load(BYTES)
    found = [np.frombuffer(ids, tokens.kind).tolist() for ids in tokens.encode(texts)]
    assert found == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_quotients_of_the_largest_states_are_exact():
    """Tables of one symbol, of rare ones and of all alike, with states up to their limit."""
    for counts in ([1], [10**9, 1, 1], [1] * 70_000):
        table = range_coder.Table(range_coder.shared_out(np.array(counts)))
        frequency = np.repeat(table.frequency, 4)
        states = (table.limit[:, None] - np.array([1, 2, 3, 4])).ravel()
        assert ((states / frequency).astype(np.int64) == states // frequency).all()
        tokens = np.arange(150_000, dtype=np.uint32)[::-1] % len(counts)
        assert (range_coder.decode(range_coder.encode(tokens, table), table) == tokens).all()


def test_range_coder_round_trip_from_every_checkpoint():
    draw = np.random.default_rng(2)
    tokens = np.minimum(draw.geometric(0.01, 200_000), 5_000).astype(np.uint32)
    table = range_coder.Table(range_coder.shared_out(np.bincount(tokens)))
    for n in (0, 1, 15, 17, 511, 513, len(tokens)):
        block = range_coder.encode(tokens[:n], table)
        assert (range_coder.decode(block, table) == tokens[:n]).all()
    step = range_coder.CHECK_STEPS * block.lanes
    for i in range(len(block.at)):
        part = range_coder.decode(block, table, i, 1)
        assert (part == tokens[i * step : (i + 1) * step]).all()
    assert len(block.words) * 8 < 9.5 * len(tokens)
    block.words = block.words[:-1] + bytes([block.words[-1] ^ 1])
    with pytest.raises(range_coder.DamagedBlock):
        range_coder.decode(block, table)


def test_frequencies_add_up():
    for counts in ([1], [0, 5, 0, 1], list(range(1, 3000)), [10**15, 1, 1]):
        found = range_coder.shared_out(np.array(counts))
        assert found.sum() == 1 << range_coder.BITS
        assert ((found > 0) == (np.array(counts) > 0)).all()


def test_token_files_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 8)
    monkeypatch.setattr(token_files, "PARTITION_TOKENS", 1 << 16)
    library = tokenizers.Tokenizer.from_file(BYTES)
    folder = new_path(spark, "test-tokens")
    token_files.write_tokens(odd_docs(spark), folder, BYTES, 2)
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    expected = [
        (i, library.encode(t or "", add_special_tokens=False).ids + [2])
        for i, t, *_ in sorted(TEXTS, key=lambda r: (r[0] is None, r[0] or 0))
    ]
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == expected
    assert [r.start for r in rows] == [0, *np.cumsum([len(e) for _, e in expected])[:-1].tolist()]
    checks = token_files.digests(token_files.read_tokens(spark, folder)).collect()
    by_start = {r.start: r.ids_crc32 for r in checks}
    assert all(by_start[r.start] == zlib.crc32(r.ids) for r in rows)


def test_a_hot_id_is_split_over_the_partitions(spark, monkeypatch):
    """A third of the rows have no id, another third one id and one text."""
    monkeypatch.setattr(token_files, "PARTITION_TOKENS", 500)
    docs = spark.range(0, 3000, 1, 4).selectExpr(
        "case id % 3 when 0 then null when 1 then 7L else id end as doc_id",
        "if(id % 3 = 1, 'the same words', concat('number ', id)) as text",
    )
    folder = new_path(spark, "test-tokens")
    token_files.write_tokens(docs, folder, BYTES, 2)
    parts = spark.read.parquet(f"{folder}/blocks").groupBy("part").sum("n_tokens").collect()
    total = sum(r[1] for r in parts)
    assert len(parts) > 10 and max(r[1] for r in parts) < 0.25 * total
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0)) and len(ids) == 3000
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]


def test_token_files_of_no_rows(spark):
    folder = new_path(spark, "test-tokens")
    token_files.write_tokens(no_docs(spark), folder, BYTES, 2)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_pieces_like_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    model = piece_codec.load(PIECES)
    letters = list("abcdet hn  ▁▁ioué\n\t\u0000<s>/01234中文😀 İ½")
    words = [p.replace("▁", " ") for p in model.plain][::7]
    texts = random_texts(letters, 3000, 3) + random_texts(words, 3000, 4) + [" ", "  ", "▁", ""]
    found = [np.frombuffer(ids, "<i4").tolist() for ids in model.encode(texts)]
    assert found == library.encode(texts)
    assert [model.decode(ids) for ids in found] == library.decode(found)


def test_pieces_of_odd_rows(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = piece_codec.encode_decode(odd_docs(spark), PIECES).collect()
    expected = [(i, library.encode(t or "")) for i, t, *_ in TEXTS]
    assert sorted((repr(r.doc_id), r.ids, r.decoded) for r in rows) == sorted(
        (repr(i), ids, library.decode(ids)) for i, ids in expected
    )
    assert piece_codec.encode_decode(no_docs(spark), PIECES).count() == 0


def test_pieces_are_made_in_slices_and_a_waiting_worker_keeps_no_words(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = ["", None, "some words, " * 60_000, "more words", "x" * 1_200_000, None, "the last, the last"]
    batches = [pa.array(texts, pa.string()), pa.array([], pa.string()), pa.array([None], pa.string())]
    made = piece_codec.codec(PIECES).func(iter(batches))
    found = [next(made)]
    model = piece_codec.load(PIECES)
    assert "more" in model.words
    found += made
    assert [len(f) for f in found] == [5, 2, 1]
    assert [row["ids"] for f in found for row in f.to_pylist()] == library.encode([t or "" for t in [*texts, None]])
    assert not (model.words or model.parts or model.outcome)
