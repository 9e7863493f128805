"""Chat windows, mixing, vector search, languages and the pipeline."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorewright.llm import chat_windows, neighbours, source_mix, word_languages
from scorewright.llm.common import table
from tests.conftest import SMALL
from tests.llm.odd import TEXTS, no_docs, odd_docs

CHAT = "conv_id long, turn long, role string, text string, span long, body string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_windows_of_odd_turns(spark):
    draw = random.Random(5)
    parts = ["a b c ", "</s>", "[INST]", "[/INST]", "<|end|>", "<|turn|>", "\\", "<", "|", "\n", "é ", "<s>", "<<SYS>>"]
    rows = []
    for conv in [None, *range(12)]:
        for turn in range(draw.randrange(1, 40)):
            role = "system" if turn == 0 and draw.random() < 0.5 else draw.choice(["user", "assistant", None, "<|text|>"])
            text = None if draw.random() < 0.1 else "".join(draw.choice(parts) for _ in range(draw.randrange(0, 30)))
            rows.append((conv, turn if draw.random() < 0.95 else None, role, text, 7, "x"))
    rows.append(rows[-1])
    budget = chat_windows.Budget(window=60, history=20)
    chats = spark.createDataFrame(rows, CHAT)
    found = {r.conv_id: r for r in chat_windows.formatted_chats(chats, budget).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        got = found[conv]
        assert (got.n_turns, got.turns_sha256) == (len(own), sha(turns))
        assert (got.loss_chars, got.loss_sha256) == (len(loss), sha(loss))
    assert chat_windows.formatted_chats(spark.createDataFrame([], CHAT)).count() == 0


def test_chat_windows_keep_the_budget(spark):
    rows = [(1, 0, "system", "be kind now", 0, "")]
    rows += [(1, i, "user" if i % 2 else "assistant", "w " * (i % 9), 0, "") for i in range(1, 60)]
    found = chat_windows.windows(spark.createDataFrame(rows, CHAT), chat_windows.Budget(60, 20)).collect()
    pairs = [w.formatted.count("<|turn|>") for w in found]
    costs = [len(w.formatted.replace("<|", " <|").replace("|>", "|> ").split()) for w in found]
    assert all("be kind now" in w.formatted for w in found) and max(costs) <= 60 + 4 * max(pairs)
    assert all(w.n_repeated >= 1 for w in found if w.span) and any(w.n_repeated > 1 for w in found)


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_ones, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_ones:
        total = sum(weight[s] for s in open_ones)
        full = {s for s in open_ones if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_ones}
        for s in full:
            target[s] = 2.0 * sizes[s]
        open_ones -= full
        left -= sum(target[s] for s in full)
    return target


def test_targets_like_plain_rounds(spark):
    draw = random.Random(6)
    for n in (1, 2, 3, 30):
        sizes = {f"s{i}" if i else None: draw.choice((0, 1, 50, 10**6, 10**12)) for i in range(n)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: r.target for r in source_mix.targets(frame).collect()}
        expected = plain_targets(sizes)
        assert all(abs(found[s] - expected[s]) <= 1e-9 * max(1, expected[s]) for s in sizes)


def test_mix_of_odd_rows(spark):
    docs = odd_docs(spark)
    report = source_mix.mix_report(docs).collect()
    assert len(report) == len(TEXTS) and all(r.taken <= 2 * r.size for r in report)
    mixed = source_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in report) == source_mix.mix(docs).count()
    assert source_mix.mix(no_docs(spark)).count() == 0


VECTORS = "vec_id long, embedding array<float>, cell int, rank int"


def test_search_of_all_cells_is_exact_and_ties_go_by_id(spark):
    draw = np.random.default_rng(7)
    points = draw.normal(size=(400, 8)).astype(np.float32)
    points[50:250] = points[50]
    rows = [(i, p.tolist(), 1, 2) for i, p in enumerate(points)]
    odd = [None, [0.0] * 8, [1.0] * 7, [None] * 8, [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    rows += [(1000 + 20 * i, v, 1, 2) for i, v in enumerate(odd)] + [(None, [1.0] * 8, 1, 2)]
    shape = neighbours.Shape(share=1.0, block=32)
    frame = spark.createDataFrame(rows, VECTORS)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 20, shape=shape).collect()
    exact = points.astype(np.float64)
    for q in range(0, 400, 20):
        scores = (exact * exact[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(400), -scores)).tolist() if i != q][:20]
        got = sorted((r.rank, r.vec_id) for r in found if r.query_id == q)
        assert got == list(enumerate(order, 1))
    assert {r.query_id for r in found} == set(range(0, 400, 20))


@pytest.mark.parametrize("text", ["concat('w', id, ' x y z')", "'the same seven words of every row'"])
def test_a_mix_of_rows_without_ids_meets_its_target(spark, text):
    """3,000 rows without an id, with a text each or one text for all."""
    docs = spark.range(0, 3000, 1, 4).selectExpr("cast(null as long) as doc_id", f"{text} as text", "'a' as source")
    docs = docs.unionByName(spark.sql("select 1L as doc_id, 'one two' as text, 'b' as source"))
    report = source_mix.mix_report(docs)
    (row,) = report.where("doc_id is null").groupBy("target").sum("taken").collect()
    assert abs(row[1] / row.target - 1) < 0.05
    assert sorted(map(str, report.collect())) == sorted(map(str, source_mix.mix_report(docs).collect()))


def test_search_of_a_part_finds_nine_tenths(spark):
    """On 500 vectors without structure; tables this small are searched whole by default."""
    vectors = table(spark, SMALL, "embeddings")
    shape = neighbours.Shape(least=0, share=0.8)
    found = neighbours.nearest(vectors, F.col("vec_id") % 20 == 0, 20, shape=shape).collect()
    rows = vectors.select("vec_id", "embedding").collect()
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = 0
    for q in ids[ids % 20 == 0]:
        scores = points @ points[ids == q][0]
        best = [i for i in ids[np.argsort(-scores)].tolist() if i != q][:20]
        hits += len(set(best) & {r.vec_id for r in found if r.query_id == q})
    assert hits >= 0.9 * len(found)
    empty = spark.createDataFrame([], VECTORS)
    assert neighbours.nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("copies", [0, 1 / 3])
def test_search_with_the_default_shape_finds_nine_tenths(spark, copies):
    """10,000 vectors without structure, none equal or a third of them; the mean of all queries."""
    draw = np.random.default_rng(9)
    points = draw.normal(size=(10_000, 64)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    same = draw.random(len(points)) < copies
    points[same] = points[0]
    frame = spark.createDataFrame([(i, p.tolist(), 1, 2) for i, p in enumerate(points)], VECTORS)
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0, 20).toPandas()
    exact, recalls = points.astype(np.float64), []
    for q, own in found.groupby("query_id"):
        scores = (exact * exact[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(len(points)), -scores)).tolist() if i != q][:20]
        assert sorted(own["rank"]) == list(range(1, 21))
        if not same[q]:
            recalls.append(len(set(best) & set(own["vec_id"])) / 20)
    assert len(found) == 500 * 20 and np.mean(recalls) >= 0.93


def test_forward_backward_like_all_paths():
    draw = np.random.default_rng(8)
    lengths = np.array([3, 1, 4])
    given, step, start = draw.random((2, 8)), draw.random((2, 2)), draw.random(2)
    found, pairs = word_languages.forward_backward(given, lengths, step, start, True)
    expected_pairs = np.zeros((2, 2))
    begin = 0
    for n in lengths:
        sums, total, links = np.zeros((2, n)), 0.0, np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=int(n)):
            p = start[path[0]] * np.prod([given[s, begin + i] for i, s in enumerate(path)])
            p *= np.prod([step[a, b] for a, b in zip(path, path[1:])])
            total += p
            for i, s in enumerate(path):
                sums[s, i] += p
            for a, b in zip(path, path[1:]):
                links[a, b] += p
        assert np.allclose(found[:, begin : begin + n], sums / total)
        expected_pairs += links / total
        begin += n
    assert np.allclose(pairs, expected_pairs)


def test_languages_of_held_out_documents(spark):
    docs = table(spark, SMALL, "documents")
    found = {r.doc_id: r for r in word_languages.document_languages(docs).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(found[r.doc_id].held_out for r in rows)
    assert sum(found[r.doc_id].lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_languages_of_switching_text_and_odd_rows(spark):
    model = word_languages.train(table(spark, SMALL, "documents"))
    rows = table(spark, SMALL, "documents").where("lang IN ('de', 'en')").orderBy("doc_id").collect()
    german = next(r.text for r in rows if r.lang == "de")
    english = next(r.text for r in rows if r.lang == "en")
    (lang, score, n, switches), *_ = word_languages._answers(model, [f"{german}\n{english}"])
    assert lang in ("de", "en") and score < 0.98 and 1 <= switches < n / 4
    odd = {r.doc_id: r for r in word_languages.document_languages(odd_docs(spark), model).collect()}
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in (1, 2, 3, 8))
    kept = word_languages.keep_known(odd_docs(spark), model)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(TEXTS) - 4
    assert word_languages.document_languages(no_docs(spark)).count() == 0


def test_pipeline_runs_and_keeps_the_columns(spark):
    docs = table(spark, SMALL, "documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    result = corpus_pipeline.run(spark, SMALL)
    assert result.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert 0 < result.select("doc_id").distinct().count() <= docs.count()
