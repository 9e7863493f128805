"""Stages of the corpus pipeline one after the other on small tables."""

from __future__ import annotations

from types import SimpleNamespace

import pandas as pd

import corpus_pipeline
from scorewright.llm import word_languages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def as_docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_near_copies_that_lose_all_lines_end_as_one_row(spark):
    copies = [f"alpha beta gamma delta epsilon zeta eta theta iota kappa {w} end" for w in "abcdefg"]
    docs = as_docs(spark, [*copies, "own words", " \t", None])
    lines = corpus_pipeline.without_recurring_lines(spark, docs, "")
    assert [r.text for r in lines.orderBy("doc_id").collect()] == [copies[0], *[""] * 6, "own words", " \t", None]
    kept = corpus_pipeline.one_of_each_class(spark, lines, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 7]


def test_lines_of_numbers_are_alike_only_if_the_numbers_are(spark):
    texts = [f"own{w} text\n{i} | {i * i}\n| 1  2 | 3 |\npage {i} of 20" for i, w in enumerate("abcdefg")]
    texts += [f"{i}.1 {i}.2 {i}.3 {i}.4 {i}.5 {i}.6 {i}.7 8{w}" for i, w in enumerate("abcdefg")]
    docs = as_docs(spark, texts)
    kept = corpus_pipeline.without_recurring_lines(spark, docs, "").orderBy("doc_id").collect()
    assert [r.text for r in kept[:7]] == [texts[0], *[f"own{w} text\n{i} | {i * i}" for i, w in enumerate("abcdefg")][1:]]
    assert [r.text for r in kept[7:]] == texts[7:]


def test_fields_are_decided_by_the_other_documents(spark):
    names = ["Alice", "Bob", "Carol", "Dan", "Eve", "Frank", "Grace", "Heidi"]
    places = ["Sports", "News", "Music", "Art", "Food", "Law", "Tech", "Film"]
    recurring = [
        "Posted by {a}",
        "Posted by {a} in {b} on {c} with all the usual tags",
        "{a} wrote this comment on {b}",
        "{a} and {b} like this page of the old site {c}",
    ]
    texts = []
    for i, a in enumerate(names):
        fields = {"a": a, "b": places[i], "c": names[-1 - i] + "day"}
        lines = [line.format(**fields) for line in recurring]
        texts.append("\n".join([f"{a} {places[i]}", *lines, f"{a} went home {places[i]} {a}", f"The {a}"]))
    docs = as_docs(spark, texts)
    kept = corpus_pipeline.without_recurring_lines(spark, docs, "").orderBy("doc_id").collect()
    assert kept[0].text == texts[0]
    for i, a in enumerate(names[1:], 1):
        own = [f"{a} {places[i]}", f"{a} went home {places[i]} {a}", f"The {a}"]
        assert kept[i].text.split("\n") == own


def test_a_language_of_long_documents_only_is_learned(spark):
    """Documents of 30,000 characters are above the sample's bound; a part of each is learned."""
    docs = spark.range(40).selectExpr(
        "id as doc_id",
        "if(id % 2 = 0, repeat('der hund und die katze nicht ', 1050), repeat('the dog and a cat not ', 40)) as text",
        "if(id % 2 = 0, 'de', 'en') as lang",
    )
    found = word_languages.document_languages(docs).collect()
    assert [r.lang_pred for r in sorted(found, key=lambda r: r.doc_id)] == ["de", "en"] * 20
    assert docs.where("length(text) > 30000 - 1000 AND lang = 'de'").count() == 20


def test_a_waiting_worker_keeps_no_potentials_of_words(spark, monkeypatch):
    """In this process: tasks have a copy of the model."""
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda _, model: SimpleNamespace(value=model))
    model = word_languages.fit([("de", "der hund und die katze"), ("en", "the dog and a cat")] * 5, 100)
    labelled = word_languages.predict(spark.range(1), model).func
    made = labelled(iter([pd.Series(["der hund", None]), pd.Series(["the new cat"])]))
    found = [next(made)]
    assert set(model.rows) == {"der", "hund"}
    found += made
    assert [lang for f in found for lang in f["lang_pred"]] == ["de", "und", "en"]
    assert model.rows is None and model.table is None
