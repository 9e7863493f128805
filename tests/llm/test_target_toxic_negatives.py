"""Target sampling, toxicity and hard negatives against plain code and held-out rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from scorewright.llm import hard_negatives, importance, toxicity
from scorewright.llm.common import table
from tests.conftest import SMALL
from tests.llm.odd import LONG, TEXTS, no_docs, odd_docs


def plain_words(text: str | None) -> list[str]:
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and c.isalnum() or ord(c) >= 128 else " " for c in lowered).split(" ")


def plain_features(text: str | None) -> list[str]:
    words = [w for w in plain_words(text) if w]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def test_interned_slots_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 700)
    texts = [t for _, t, _, _ in TEXTS]
    counts, per_text = Counter(), Counter()
    for _, text, grams in importance._blocks(pa.array(texts), importance.Rule()):
        used = np.flatnonzero(grams.count)
        for slot in used:
            counts[int(grams.bucket[slot])] += int(grams.count[slot])
        per_text.update(text.tolist())
    expected = Counter(
        zlib.crc32(f.encode()) % 10_000 for t in texts for f in plain_features(t)
    )
    assert counts == expected
    assert all(per_text[i] == len(plain_features(t)) for i, t in enumerate(texts))


def test_hashes_like_the_libraries():
    draw = np.random.default_rng(2)
    data = draw.integers(0, 256, 5000, np.uint8).tobytes()
    begins = draw.integers(0, 4000, 3000)
    lengths = draw.integers(0, 90, 3000)
    lanes = importance._eight_bytes(data)
    spans = [data[b : b + n] for b, n in zip(begins, lengths)]
    assert importance.xxhash64(data, lanes, begins, lengths).tolist() == [
        xxhash.xxh64_intdigest(s) for s in spans
    ]
    assert importance.crc32(data, lanes, begins, lengths).tolist() == list(map(zlib.crc32, spans))


def test_equal_keys_of_unlike_ngrams_are_told_apart():
    data = b"ab cd ab abcdefghi abcdefghj abcdefghi "
    begins = np.array([0, 3, 6, 9, 19, 29])
    ends = np.array([2, 5, 8, 18, 28, 38])
    grams = importance.Interned(data, begins, ends, 1000, key=lambda _, __, b, ___: np.full(len(b), 5, np.uint64))
    slots = grams.slot.tolist()
    assert slots[0] == slots[2] and slots[3] == slots[5] and len(set(slots)) == 4
    assert [int(grams.count[s]) for s in slots] == [2, 1, 2, 2, 1, 2]


def test_target_sample_of_odd_rows(spark):
    target = spark.createDataFrame([(1, "three four"), (2, None)], "item_id long, text string")
    rule = importance.Rule(least_words=1, percent=50)
    found = importance.scores(odd_docs(spark), target, rule).collect()
    s = Counter(zlib.crc32(f.encode()) % 10_000 for _, t, _, _ in TEXTS for f in plain_features(t))
    t = Counter(zlib.crc32(f.encode()) % 10_000 for f in plain_features("three four"))
    S, T = sum(s.values()), sum(t.values())

    def gain(f):
        b = zlib.crc32(f.encode()) % 10_000
        return math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))

    def weight(text):
        features = plain_features(text)
        return sum(map(gain, features)) // len(features) if features else 0

    assert Counter((r.doc_id, r.n_features, r.weight) for r in found) == Counter(
        (i, len(plain_features(x)), weight(x)) for i, x, _, _ in TEXTS
    )
    eligible = [r for r in found if r.n_words >= 1]
    drawn = sorted((r.rank, r.score) for r in found if r.rank)
    assert [r for r, _ in drawn] == list(range(1, len(eligible) // 2 + 1))
    assert [x for _, x in drawn] == sorted((r.score for r in eligible), reverse=True)[: len(drawn)]
    kept = importance.resample(odd_docs(spark), target, rule)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(drawn)
    assert importance.scores(no_docs(spark), target).count() == 0
    assert importance.scores(odd_docs(spark), target.limit(0)).count() == len(TEXTS)


def test_risk_is_corrected_and_not_negative():
    draw = np.random.default_rng(3)
    scores, toxic = draw.normal(size=20_000), draw.random(20_000) < 0.2
    negatives = np.logaddexp(0, scores[~toxic]).mean() * (~toxic).mean()
    estimate = toxicity.pu_risk(scores[toxic], scores, toxic.mean())[1]
    assert abs(estimate - negatives) < 1e-9
    # learnt by heart: the unlabelled documents score as negatives, the toxic ones as positives
    up, down = np.full(10, 30.0), np.full(100, -30.0)
    assert toxicity.pu_risk(up, down, 0.2)[1] < 0
    own, other = toxicity._slopes(up, down, 0.2)
    assert (own >= 0).all() and (other <= 0).all()


def labelled(spark):
    """Documents with an insult at some place; a part of them has a label."""
    draw = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in "bdfgklmn" for b in ("an", "ode", "irt", "ul")]
    docs, labels = [], []
    for i in range(900):
        words = draw.choice(plain, 30).tolist()
        toxic = i % 6 == 0
        if toxic:
            words[int(draw.integers(30))] = ("zounder", "quarkling")[i // 24 % 2]
        docs.append((i, " ".join(words), 1, 2))
        if i // 6 % 2 == 0:
            labels.append((i, int(toxic), "x"))
    schema = "doc_id long, text string, score int, toxic int"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(
        labels + [(None, 1, "x"), (5000, 1, "x"), (2, None, "x")], "doc_id long, toxic int, text string"
    )


def test_toxic_documents_that_were_held_out(spark):
    docs, labels = labelled(spark)
    found = {r.doc_id: r for r in toxicity.toxic_scores(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    held = [(i, r) for i, r in found.items() if r.held_out]
    assert sum(r.predicted == (i % 6 == 0) for i, r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.columns == docs.columns and 700 < kept.count() < 800


def test_toxicity_of_odd_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    long = "ban lode " * 300_000 + "zounder " * 60_000
    assert model.score([long])[0] > 0.3 > model.score(["ban lode " * 300_000])[0]
    odd = toxicity.toxic_scores(odd_docs(spark), labels, model).collect()
    assert len(odd) == len(TEXTS)
    assert all(r.score == 0 for r in odd if r.doc_id in (1, 2, 3, 8))
    assert toxicity.toxic_scores(no_docs(spark), labels).count() == 0
    none = toxicity.toxic_scores(odd_docs(spark), labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0}
    repeated = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert toxicity.toxic_scores(repeated, labels).count() == 1800


def test_words_of_a_long_text_are_read_in_pieces(monkeypatch):
    whole = toxicity.word_counts(LONG + " é" * 5000 + "x" * 1000)
    monkeypatch.setattr(toxicity, "PIECE", 37)
    assert toxicity.word_counts(LONG + " é" * 5000 + "x" * 1000) == whole


VECTORS = "vec_id long, embedding array<float>, label int, uid int, score string"


def plain_negatives(rows, low=50, high=95):
    """Anchors by id divisible by 5; (anchor, positive, rank, negative, scores) by sorting all."""
    taken = [
        (r, i, label, [math.floor(256 * x) for x in v])
        for r, (i, v, label, *_) in enumerate(rows)
        if i is not None and label is not None and v is not None and len(v) == 6
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []
    for r, i, label, v in taken:
        if i % 5:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, s, m) for s, j, m, w in taken if s != r)
        for p, j, _, _ in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and low * -p <= 100 * -x[0] <= high * -p][:3]
            found += [(i, j, k, x[1], -p, -x[0]) for k, x in enumerate(fits, 1)]
    return Counter(found)


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_negatives_like_sorting_all(spark, spread):
    """Clustered and unstructured vectors; a third of the rows are one vector of one label."""
    draw = np.random.default_rng(11)
    middles = draw.normal(size=(12, 6))
    rows = []
    for i in range(420):
        v = middles[i % 12] + spread * draw.normal(size=6)
        rows.append((i, v.astype(np.float32).tolist(), i % 4, 1, "s"))
    for i in range(150):
        rows[i] = (i, rows[0][1], 2, 1, "s")
    rows += [rows[200], rows[205]]
    rows += [(500 + 5 * k, [0.0] * 6, k % 2, 1, "s") for k in range(3)]
    odd = [None, [None] * 6, [float("nan")] * 6, [float("inf")] * 6, [1.0] * 5, []]
    rows += [(600 + 5 * k, v, 1, 1, "s") for k, v in enumerate(odd)]
    rows += [(700, rows[3][1], None, 1, "s"), (None, rows[3][1], 1, 1, "s")]
    shape = hard_negatives.Shape(references=5, tile=48, team=32)
    is_anchor = F.col("vec_id") % 5 == 0
    frame = spark.createDataFrame(rows, VECTORS)
    found = hard_negatives.hard_negatives(frame, is_anchor, shape=shape).collect()
    assert Counter(map(tuple, found)) == plain_negatives(rows)
    assert Counter(map(tuple, hard_negatives.hard_negatives(frame, is_anchor).collect())) == (
        plain_negatives(rows)
    )


def test_entries_of_other_clusters_are_not_multiplied():
    draw = np.random.default_rng(12)
    middles = np.eye(8) * 4
    points = np.floor(256 * (np.repeat(middles, 100, axis=0) + 0.1 * draw.normal(size=(800, 8))))
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    angles = np.arccos(np.clip(units, -1, 1))  # to the axes
    block = hard_negatives._Block(
        np.arange(100), np.arange(100), np.zeros(100), points[:100].astype(np.int32),
        np.linalg.norm(points[:100], axis=1), angles[:100],
    ).in_order()
    other = np.linalg.norm(points[100:164], axis=1)
    least = 0.5 * other * block.norm.max()
    part = block.window(other, angles[100:164, block.direction], least, np.full(64, np.inf))
    assert part.stop == part.start
    near = block.window(other, angles[:64, block.direction], least, np.full(64, np.inf))
    assert near.stop - near.start == 100


def test_negatives_of_no_rows(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty, F.col("vec_id") % 5 == 0).count() == 0
    one = spark.createDataFrame([(1, [1.0], 1, 1, "s")], VECTORS)
    assert hard_negatives.hard_negatives(one, F.col("vec_id") % 5 == 0).count() == 0


def test_scores_are_exact_beyond_doubles():
    big = np.array([[(1 << 26) - 1] * 4, [3, -(1 << 26) + 1, 1, 7]], np.int32)
    block = hard_negatives._Block(*[np.arange(2)] * 3, big, np.linalg.norm(big.astype(float), axis=1), np.zeros((2, 1)))
    found = block.scores(big, block.norm, slice(0, 2))
    plain = [[sum(int(a) * int(b) for a, b in zip(x, y)) for y in big] for x in big]
    assert found.tolist() == plain


def test_scores_of_the_given_table(spark):
    found = toxicity.toxic_scores(table(spark, SMALL, "documents"), table(spark, SMALL, "labels"))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert found.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.3 AS int)").count() == 0
