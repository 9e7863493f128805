"""Exact copies, line templates, repeated spans and near duplicates against plain code."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from scorewright.llm import bag_signatures, block_names, line_templates, near_duplicates, repeated_spans
from scorewright.llm.components import components
from tests.llm.odd import TEXTS, no_docs, odd_docs


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def as_docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_block_names_of_odd_rows(spark):
    rows = block_names.exact_duplicates(odd_docs(spark), block_bytes=16).collect()
    assert len(rows) == len(TEXTS)
    by_id = {row.doc_id: row for row in rows}
    assert (by_id[0].group_size, by_id[0].keep_id, by_id[0].kept) == (4, 0, True)
    assert by_id[6].keep_id == 0 and not by_id[6].kept and by_id[None].keep_id == 0
    assert by_id[1].keep_id == by_id[2].keep_id == 1 and by_id[3].keep_id == 3
    assert (by_id[5].keep_id, by_id[4].kept) == (4, True)
    assert by_id[3].text_sha256 == sha(" ") and by_id[1].text_sha256 == sha("")
    assert block_names.exact_duplicates(no_docs(spark)).count() == 0


def test_block_names_that_share_a_hash_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    class Poor:
        def __getattr__(self, name):
            return getattr(F, name)

        @staticmethod
        def xxhash64(block):
            return F.length(block).cast("long")

    monkeypatch.setattr(block_names, "F", Poor())
    texts = ["abcdefgh", "abcdefgx", "abcdefgh", "xbcdefgh", "abcd", "abcx", "abcd"]
    rows = block_names.exact_duplicates(as_docs(spark, texts), block_bytes=4).collect()
    assert {r.doc_id: r.keep_id for r in rows} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 5, 6: 4}


def test_line_templates_generalise_fields(spark):
    texts = [f"text {i}\nShared by user u{i} at page {i} of the old site\nown line number {chr(97 + i) * 3}" for i in range(6)]
    texts += [f"alpha beta gamma delta epsilon zeta eta {w}" for w in ("a b c", "a b d", "a b e", "a b f", "a b g")]
    kept = {r.row.doc_id: r for r in line_templates.with_kept_text(as_docs(spark, texts)).collect()}
    assert kept[0].n_dropped == 0 and kept[6].n_dropped == 0
    assert [kept[i].kept.split("\n") for i in range(1, 6)] == [
        [f"own line number {chr(97 + i) * 3}"] for i in range(1, 6)
    ]
    assert all(kept[i].kept == "" for i in range(7, 11))


def test_rows_of_numbers_keep_their_contents(spark):
    texts = [f"own{w} text\n{i} | {i * i}\n| 1  2 | 3 |" for i, w in enumerate("abcdefg")]
    kept = {r.row.doc_id: r.kept for r in line_templates.with_kept_text(as_docs(spark, texts)).collect()}
    assert kept[0] == texts[0]
    assert [kept[i] for i in range(1, 7)] == [t.rsplit("\n", 1)[0] for t in texts[1:]]


def test_a_line_of_rows_without_an_id_stays_in_one_text(spark):
    """Seven texts of no id; one of them is there three times, and its copies go alike."""
    texts = [f"the line that all of them share\nonly {w}" for w in "abcdefg"]
    rows = [(None, t) for t in [*texts, texts[3], texts[3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.text for r in line_templates.without_recurring_lines(docs).collect()]
    whole = [t for t in kept if t.startswith("the line")]
    assert len(set(whole)) == 1 and len(whole) == rows.count((None, whole[0]))
    assert sorted(set(kept) - set(whole)) == sorted({t.split("\n")[1] for t in texts if t != whole[0]})
    with_id = docs.unionByName(spark.createDataFrame([(4, texts[5] + "!")], docs.schema))
    found = {(r.doc_id, r.text) for r in line_templates.without_recurring_lines(with_id).collect()}
    assert found == {(4, texts[5] + "!"), *[(None, t.split("\n")[1]) for t in texts]}


def test_line_templates_of_odd_rows(spark):
    docs = odd_docs(spark)
    assert line_templates.without_recurring_lines(docs).columns == docs.columns
    rows = line_templates.without_recurring_lines(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, docs.collect()))
    assert line_templates.without_recurring_lines(no_docs(spark)).count() == 0


def spans_removed(texts, window):
    first, words = {}, {i: (t or "").encode().split() for i, t in enumerate(texts)}
    for i, w in words.items():
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        yield i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


@pytest.mark.parametrize(("letters", "bits"), [("ab", 32), ("abcdefghijklm", 32), ("abcdefghijklm", 0)])
def test_repeated_spans_like_plain_code(spark, letters, bits):
    draw = random.Random(len(letters))
    texts = []
    for _ in range(60):
        words = [draw.choice(letters) for _ in range(draw.randrange(0, 40))]
        if texts and draw.random() < 0.6:
            old = draw.choice(texts).split()
            begin = draw.randrange(0, len(old) + 1)
            at = draw.randrange(0, len(words) + 1)
            words[at:at] = old[begin : begin + draw.randrange(0, 40)]
        texts.append("  ".join(words))
    shape = repeated_spans.Shape(window=8, anchor=3, near_bits=bits)
    found = repeated_spans.without_repeats(as_docs(spark, texts), shape=shape).collect()
    assert sorted(map(tuple, found)) == sorted(spans_removed(texts, 8))


def test_paths_are_compacted_and_name_their_source(spark):
    passage = " ".join(f"w{i}" for i in range(200))
    texts = [f"a b {passage}", f"c d e {passage} f", "g", passage]
    paths = repeated_spans.find_repeats(as_docs(spark, texts)).paths.collect()
    assert {row.source for row in paths} == {0}
    assert all(row.source_start is not None for row in paths)
    assert len(paths) < 8


def test_repeated_spans_of_odd_rows(spark):
    rows = repeated_spans.without_repeats(odd_docs(spark)).collect()
    assert len(rows) == len(TEXTS)
    by_id = {row.doc_id: row for row in rows}
    assert (by_id[4].n_removed, by_id[5].n_removed, by_id[5].kept) == (0, 60_000, "")
    assert by_id[1].n_words == by_id[3].n_words == 0 and by_id[6].n_removed == 0
    assert repeated_spans.without_repeats(no_docs(spark)).count() == 0


def test_rows_of_one_id_whose_hashes_end_alike_keep_their_own_words(spark):
    passage = " ".join(f"p{i}" for i in range(20))

    def tail(text):
        value = xxhash.xxh64_intdigest(text.encode(), 42)
        return str(value - (value >> 63 << 64))[-9:]

    copies = {tail(t): t for t in (f"a{i} {passage}" for i in range(200_000))}
    others = ((tail(t), t) for t in (f"b{i} own words here" for i in range(200_000)))
    copy, other = next((copies[end], t) for end, t in others if end in copies)
    docs = spark.createDataFrame([(0, passage), (None, copy), (None, other)], "doc_id long, text string")
    shape = repeated_spans.Shape(window=8, anchor=3)
    found = repeated_spans.without_repeats(docs, shape=shape).collect()
    kept = {(r.doc_id, r.n_words, r.n_removed, r.kept) for r in found}
    assert kept == {(0, 20, 0, passage), (None, 21, 20, copy.split()[0]), (None, 4, 0, other)}


def plain_classes(texts, k=5, similarity=0.8):
    bags = []
    for text in texts:
        words = (text or "").encode().split()
        k_now = min(k, len(words))
        bags.append(Counter(tuple(words[i : i + k_now]) for i in range(len(words) - k_now + 1)) if words else Counter())
    root = list(range(len(texts)))
    for i, a in enumerate(bags):
        for j in range(i):
            both = sum((a & bags[j]).values())
            if a and both >= similarity * (sum(a.values()) + sum(bags[j].values()) - both):
                old, new = root[i], root[j]
                root = [min(old, new) if r in (old, new) else r for r in root]
    return root


def test_near_duplicates_like_plain_code_in_small_blocks(spark):
    draw = random.Random(3)
    base = [" ".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(80)) for _ in range(4)]
    texts = []
    for i in range(70):
        words = draw.choice(base[: 1 + i % 4]).split()
        for _ in range(draw.randrange(0, 4)):
            words[draw.randrange(len(words))] = draw.choice("ABCDEFGH")
        texts.append(" ".join(words * draw.choice((1, 1, 2))))
    rule = near_duplicates.Rule(block=8, shared=2)
    found = near_duplicates.near_duplicates(as_docs(spark, texts), rule=rule).collect()
    assert {r.doc_id: r.class_id for r in found} == dict(enumerate(plain_classes(texts)))


def test_near_duplicates_of_odd_rows(spark):
    rows = near_duplicates.near_duplicates(odd_docs(spark)).collect()
    by_id = {row.doc_id: row for row in rows}
    assert len(rows) == len(TEXTS) and by_id[0].class_size == 4 and by_id[5].class_id == 4
    assert all(by_id[i].class_size == 1 for i in (1, 2, 3, 7, 8))
    kept = near_duplicates.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 8]
    assert near_duplicates.near_duplicates(no_docs(spark)).count() == 0
    assert near_duplicates.keep_one(no_docs(spark)).count() == 0


def test_signatures_agree_as_often_as_the_weights_do():
    draw = np.random.default_rng(1)
    errors = []
    for _ in range(20):
        elements = draw.integers(0, 2**63, 40).astype(np.uint64)
        a = draw.integers(0, 12, 40)
        b = np.where(draw.random(40) < 0.6, a, draw.integers(0, 12, 40))
        bags = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        times = bag_signatures.signatures(
            2, bags, np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2048
        )
        errors.append((times[0] == times[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.02


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(7, 7), (200, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for row in found:
        groups[row.component].add(row.node)
    assert groups == {100: set(range(100, 141)), 0: {*range(30), 200}}


def test_coordinates_in_the_source_catch_paths_that_run_on(spark):
    """Without any bit of the neighbours' digests, passages that follow each other run together."""
    draw = random.Random(9)
    passages = [" ".join(f"p{i}w{draw.randrange(10**6)}" for _ in range(30)) for i in range(6)]
    orders = [(0, 1), (2, 3), (4, 5), (0, 3), (2, 5), (4, 1), (0, 1, 2), (3, 2)]
    texts = [" ".join(passages[i] for i in order) for order in orders]
    shape = repeated_spans.Shape(window=8, anchor=3, near_bits=0)
    found = repeated_spans.without_repeats(as_docs(spark, texts), shape=shape).collect()
    assert sorted(map(tuple, found)) == sorted(spans_removed(texts, 8))
    paths = repeated_spans.find_repeats(as_docs(spark, texts), shape=shape).paths
    assert paths.where("source_start IS NULL").count() == 0


def test_many_equal_rows_of_one_id_are_one_text(spark):
    words = " ".join(f"w{i}" for i in range(400))
    docs = spark.range(4000).selectExpr(
        "if(id = 0, 1L, null) as doc_id", f"'{words}' as text", "id as other"
    )
    found = repeated_spans.without_repeats(docs).groupBy("doc_id", "n_removed").count().collect()
    assert sorted((r.doc_id or 0, r.n_removed, r["count"]) for r in found) == [(0, 400, 3999), (1, 0, 1)]
    assert repeated_spans.find_repeats(docs).paths.count() + 0 <= 2
