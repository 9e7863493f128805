"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents and unlabelled text are learned from; that a document was
looked at and found harmless is used for nothing but the class prior.  The loss on toxic
documents is weighted by the prior, the loss of unlabelled text as negative is reduced by
the part that the toxic documents among it must have, and where that difference falls below
zero (the classifier has begun to learn the unlabelled documents by heart) a step goes the
other way.  Members are linear classifiers in numpy over hashed character n-grams of words;
a text is the unit vector of its words, each by one plus the logarithm of its count.  Only
n-grams whose share of the toxic documents differs from their share of unlabelled text by
``Training.least_deviations`` take part, weighted by how far they differ, so that a few
dozen confirmed documents suffice where the signs are clear.  The steps of a member's second
half are averaged, and so are the members, which leaves one vector of weights of fixed
size; it goes to the tasks as a broadcast.

Training: a bounded sample, ``Sample`` documents by the hash of the id, of each at most
``Sample.characters`` in a row from a place that the hash names.  Scoring covers every whole
text; weights are kept per distinct word in a bounded cache of each Python worker.

Defined results: null texts and texts without letters score 0, as does everything if no
document is confirmed toxic.  A document with several labels is toxic if one says so; rows
without an id are never learned from; rows with one id are one training document (the text
first in order) and are scored each by its own text; an empty table gives an empty result; a
text of any length is read in pieces; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scorewright.llm.common import in_groups

HELD_OUT_OF, HELD_OUT_REST = 4, 2
#: Hashed features, words that a worker keeps, and characters of a text read at once.
BUCKETS = 1 << 18
CACHED_WORDS = 500_000
PIECE = 1_000_000
#: Runs of letters; an endless one is cut, so that no word is unbounded.
_WORD = re.compile(r"[^\W\d_]{1,64}")
_NO_LETTER = re.compile(r"[\W\d_]")


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample, and the prior where no harmless label tells one."""

    positives: int = 2_400
    unlabelled: int = 4_800
    characters: int = 20_000
    prior: float = 0.1


@dataclass(frozen=True)
class Training:
    members: int = 3
    least_positives: int = 300  # of a member
    least_deviations: float = 3.5
    steps: int = 150
    rate: float = 0.02
    decay: float = 3e-4
    scale: float = 8.0


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_OF == HELD_OUT_REST


def word_counts(text: str) -> Counter:
    """How often each word occurs, lower-cased; a long text is read in pieces."""
    counts: Counter = Counter()
    begin = 0
    while begin < len(text):
        stop = _NO_LETTER.search(text, begin + PIECE)
        end = stop.start() if stop else len(text)
        counts.update(_WORD.findall(text[begin:end].lower()))
        begin = end
    return counts


def _features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs: hashed runs of 3 to 6 characters between edge marks."""
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    owners, found = [], []
    for n in (3, 4, 5, 6):
        mixed = np.full(max(0, len(codes) - n + 1), n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[k : len(mixed) + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = owner[: len(mixed)] == owner[n - 1 :]
        owners.append(owner[: len(mixed)][inside])
        found.append((mixed[inside] >> np.uint64(20)) % np.uint64(BUCKETS))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


def _word_scores(weights: np.ndarray, words: Sequence[str]) -> np.ndarray:
    owner, found = _features(words)
    return np.bincount(owner, weights[found], len(words))


@dataclass
class _Texts:
    """Texts as rows (text, word number, value) of a sparse matrix with unit rows."""

    text: np.ndarray
    word: np.ndarray
    value: np.ndarray
    n: int

    @classmethod
    def of(cls, counts: Sequence[Counter], numbers: dict[str, int]) -> _Texts:
        text = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        word = np.array([numbers.setdefault(w, len(numbers)) for c in counts for w in c], np.int64)
        value = 1 + np.log(np.array([n for c in counts for n in c.values()], np.float64))
        size = np.sqrt(np.bincount(text, value**2, len(counts)))
        return cls(text, word, value / size[text], len(counts))

    def times(self, by_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, by_word[self.word] * self.value, self.n)

    def back(self, by_text: np.ndarray, n_words: int) -> np.ndarray:
        return np.bincount(self.word, by_text[self.text] * self.value, n_words)

    def holding(self, first: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Number of texts with each feature; word w has the features from ``first[w]`` on."""
        total = np.zeros(BUCKETS, np.int64)
        edges = np.searchsorted(self.text, np.arange(0, self.n + 64, 64))
        for begin, end in zip(edges, edges[1:]):
            words, texts = self.word[begin:end], self.text[begin:end]
            n = first[words + 1] - first[words]
            places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[words], n)
            pairs = np.unique(np.repeat(texts, n) * BUCKETS + found[places])
            total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
        return total


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pu_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Risk of the positives, and of the negatives as estimated from unlabelled scores."""
    as_positive = prior * np.logaddexp(0, -positive).mean()
    as_negative = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    return float(as_positive), float(as_negative)


def _slopes(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """By score: slopes of the risk, or of the way back where its second part is below zero."""
    own = prior * _sigmoid(positive) / len(positive)
    other = _sigmoid(unlabelled) / len(unlabelled)
    if pu_risk(positive, unlabelled, prior)[1] < 0:
        return own, -other
    return -prior * _sigmoid(-positive) / len(positive) - own, other


@dataclass
class Model:
    """One weight for each hashed feature, and the base; empty if nothing was confirmed."""

    weights: np.ndarray | None = None
    base: float = 0.0
    scale: float = 1.0
    known: dict[str, float] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probabilities; a word's score is computed once for each distinct word of a worker."""
        if self.weights is None:
            return np.zeros(len(texts))
        counts = [word_counts(text or "") for text in texts]
        if len(self.known) > CACHED_WORDS:
            self.known = {}
        if new := list({w for c in counts for w in c}.difference(self.known)):
            self.known.update(zip(new, _word_scores(self.weights, new).tolist()))
        found = np.zeros(len(texts))
        for i, c in enumerate(counts):
            if c:
                value = 1 + np.log(np.fromiter(c.values(), np.float64, len(c)))
                scores = np.fromiter(map(self.known.__getitem__, c), np.float64, len(c))
                z = self.base + self.scale * (value @ scores) / np.sqrt(value @ value)
                found[i] = _sigmoid(z)
        return found


def fit(
    positives: Sequence[str], unlabelled: Sequence[str], prior: float, training: Training = Training()
) -> Model:
    """The mean of the members; each has its own share of both samples."""
    bags = [[c for c in map(word_counts, texts) if c] for texts in (positives, unlabelled)]
    if not bags[0] or not bags[1]:
        return Model()
    members = max(1, min(training.members, len(bags[0]) // training.least_positives))
    fitted = [
        _member(bags[0][k::members], bags[1][k::members], prior, training) for k in range(members)
    ]
    weights = np.mean([w for w, _ in fitted], axis=0)
    return Model(weights, float(np.mean([b for _, b in fitted])), training.scale)


def _confidence(sides: Sequence[_Texts], owner: np.ndarray, found: np.ndarray, least: float) -> np.ndarray:
    """By feature: deviations between its shares of both sides, a tenth of them and 1 at most."""
    n_words = int(owner.max()) + 1
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(n_words + 1))
    own, other = (side.holding(first, found[order]) for side in sides)
    expected = sides[0].n * (other + 1) / (sides[1].n + 1)
    spread = np.sqrt(np.maximum(expected * (1 - expected / sides[0].n), 0.01 * expected) + 0.5)
    deviations = np.abs(own - expected) / spread
    return np.where(deviations >= least, np.minimum(deviations / 10, 1), 0.0)


def _member(
    positives: Sequence[Counter], unlabelled: Sequence[Counter], prior: float, training: Training
) -> tuple[np.ndarray, float]:
    numbers: dict[str, int] = {}
    sides = [_Texts.of(bags, numbers) for bags in (positives, unlabelled)]
    n_words = len(numbers)
    owner, found = _features(list(numbers))
    confidence = _confidence(sides, owner, found, training.least_deviations)
    owner, found = owner[confidence[found] > 0], found[confidence[found] > 0]
    size = training.scale * confidence[found]
    start = np.log(prior / (1 - prior))
    state = np.zeros(BUCKETS + 1)  # the weights, then what is added to the base
    first, second, total = (np.zeros(BUCKETS + 1) for _ in range(3))
    averaged = 0
    for step in range(1, training.steps + 1):
        by_word = np.bincount(owner, state[found] * size, n_words)
        scores = [side.times(by_word) + start + state[-1] for side in sides]
        slopes = _slopes(*scores, prior)
        to_words = sum(side.back(s, n_words) for side, s in zip(sides, slopes))
        pull = np.bincount(found, to_words[owner] * size, BUCKETS + 1) + training.decay * state
        pull[-1] = sum(s.sum() for s in slopes)
        first += 0.1 * (pull - first)
        second += 0.01 * (pull**2 - second)
        move = (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        state -= training.rate * move
        if 2 * step > training.steps:
            total += state
            averaged += 1
    total /= averaged
    return total[:-1] * confidence, float(start + total[-1])


def _training_texts(
    docs: DataFrame, labels: DataFrame, sample: Sample
) -> tuple[list[str], list[str], float]:
    """Texts of both samples, and the prior."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    confirmed = (
        own.where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    share = confirmed.agg(F.sum("toxic"), F.count("*")).first()
    if not share[0]:
        return [], [], sample.prior
    prior = share[0] / share[1] if share[0] < share[1] else sample.prior
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))
    )
    ids = rows.select("doc_id").distinct()
    toxic = ids.join(confirmed.where("toxic = 1"), "doc_id", "left_semi")
    drawn = _by_hash(toxic, "toxic", sample.positives).unionByName(
        _by_hash(ids, "unlabelled", sample.unlabelled)
    )
    # At most ``positives + unlabelled`` ids; one text of each.
    begin = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length("text") - sample.characters))
    part = F.substring(F.col("text"), begin.cast("int") + 1, F.lit(sample.characters))
    texts = (
        rows.join(F.broadcast(drawn), "doc_id")
        .groupBy("side", "doc_id")
        .agg(F.min(part).alias("text"))
        .orderBy("side", "doc_id")
        .collect()
    )
    return *([r["text"] for r in texts if r["side"] == s] for s in ("toxic", "unlabelled")), prior


def _by_hash(ids: DataFrame, side: str, n: int) -> DataFrame:
    order = F.xxhash64(F.lit(side), F.col("doc_id"))
    return ids.orderBy(order, "doc_id").limit(n).select("doc_id", F.lit(side).alias("side"))


def train(
    docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), training: Training = Training()
) -> Model:
    """The classifier for ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    return fit(*_training_texts(docs, labels, sample), training)


def predict(docs: DataFrame, model: Model) -> Column:
    """The score of the text column it is applied to."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            groups = in_groups([text or "" for text in batch.tolist()])
            yield pd.Series(np.concatenate([shared.value.score(g) for g in groups] or [[]]))

    return scored


def toxic_scores(
    docs: DataFrame, labels: DataFrame, model: Model | None = None, least: float = 0.3
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    model = model or train(docs, labels)
    found = docs.select("doc_id", predict(docs, model)(F.col("text")).alias("score"))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def keep_harmless(
    docs: DataFrame, labels: DataFrame, model: Model | None = None, least: float = 0.3
) -> DataFrame:
    """The rows, all columns as they are, that score below ``least``."""
    model = model or train(docs, labels)
    rows = docs.select(F.struct("*").alias("row"))
    found = rows.withColumn("score", predict(docs, model)(F.col("row.text")))
    return found.where(F.col("score") < least).select("row.*")
