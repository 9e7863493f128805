"""Language of words and documents by a linear-chain conditional random field.

Words are runs of letters, lower-cased.  A word's potentials come from its affixes, the
character n-grams of the word with its edges marked, and a lexicon of training words;
learned transitions link neighbouring words of a line (a line longer than
``CHAIN_WORDS`` words goes on in a new chain).  Forward-backward gives each word a
distribution over the languages, so a text that switches language is labelled word by
word; a document's language is the one with the largest share of the words.

Training: a bounded sample of labelled rows that are not held out, ``Sample`` documents
per language by the hash of the id, of longer documents a part; the model (hashed weights, one row per feature) has
a fixed size and goes to the tasks as a broadcast.  Prediction reads the text alone and
covers every whole text; potentials are kept per distinct word in a bounded cache of
each task, so lines cost a look-up per word and a few array operations for
each step of many chains at once.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is
everything if there is no labelled row; ties go to the language first in code point
order; repeated rows get the same answer; rows without an id are learned from and labelled
like any other; an empty table gives an empty result; a text of any length is labelled whole;
other columns are ignored or handed through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from scorewright.llm.common import in_groups

UNKNOWN = "und"
HELD_OUT_PART = 5
CHAIN_WORDS = 128
_LETTERS = re.compile(r"[^\W\d_]+")
#: Hashed features, and potentials that a task keeps.
BUCKETS = 1 << 16
CACHED_WORDS = 500_000


@dataclass(frozen=True)
class Sample:
    """Bounds of the training sample, for each language."""

    documents: int = 150
    characters: int = 20_000
    lexicon: int = 5_000


def _features(words: Sequence[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature) pairs: n-grams of the words between edge marks, and the lexicon.

    An n-gram that holds a mark is an affix.
    """
    codes = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)
    owners, found = [], []
    for n in (2, 3, 4):
        mixed = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inside = owner[: len(mixed)] == owner[n - 1 :]
        owners.append(owner[: len(mixed)][inside])
        found.append((mixed[inside] >> np.uint64(20)) % np.uint64(BUCKETS))
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    owners.append(np.array([i for i, _ in known], np.int64))
    found.append(np.array([BUCKETS + k for _, k in known], np.int64))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


def _scores(weights: np.ndarray, owner: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Potentials [language, word]: exp of the mean weights, scaled to a largest value of 1."""
    norm = np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    scores = np.stack([np.bincount(owner, w[found], n) / norm for w in weights])
    return np.exp(np.maximum(scores - scores.max(axis=0), -30))


def forward_backward(
    potentials: np.ndarray,
    lengths: np.ndarray,
    transition: np.ndarray,
    start: np.ndarray,
    with_pairs: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals [language, word], and the sum of the pair marginals, for many chains at once.

    ``potentials`` [language, word] holds the chains one after the other.  The words are
    dealt anew by their place in the chain, longest chains first, so that each step works
    on one slice: the chains that still go on.
    """
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    longest = int(lengths.max())
    active = np.searchsorted(-lengths[order], -np.arange(longest), side="left").tolist()
    dealt = np.concatenate([begins[:n] + t for t, n in enumerate(active)])
    at = [0, *np.cumsum(active).tolist()]
    given = potentials[:, dealt]
    ahead, back = np.empty_like(given), np.ones_like(given)
    for t, n in enumerate(active):
        now = slice(at[t], at[t] + n)
        step = start[:, None] if t == 0 else transition.T @ ahead[:, at[t - 1] : at[t - 1] + n]
        step = step * given[:, now]
        ahead[:, now] = step / step.sum(axis=0)
    pairs = np.zeros_like(transition)
    for t in range(longest - 2, -1, -1):
        n = active[t + 1]
        coming = given[:, at[t + 1] : at[t + 1] + n] * back[:, at[t + 1] : at[t + 1] + n]
        step = transition @ coming
        now = slice(at[t], at[t] + n)
        if with_pairs:
            pairs += (ahead[:, now] / (ahead[:, now] * step).sum(axis=0)) @ coming.T
        back[:, now] = step / step.sum(axis=0)
    both = ahead * back
    marginals = np.empty_like(both)
    marginals[:, dealt] = both / both.sum(axis=0)
    return marginals, pairs * transition


def chains(text: str) -> tuple[list[str], list[int]]:
    """The words of a text and the lengths of its chains."""
    words: list[str] = []
    lengths: list[int] = []
    for line in text.lower().split("\n"):
        found = _LETTERS.findall(line)
        words += found
        full, rest = divmod(len(found), CHAIN_WORDS)
        lengths += [CHAIN_WORDS] * full + [rest] * (rest > 0)
    return words, lengths


class _Rows(dict):
    """Numbers of words; a new word gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = len(self)
        return len(self) - 1


@dataclass
class Model:
    """Weights [language, feature] of the field; ``langs`` in code point order."""

    langs: list[str]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int]
    rows: _Rows | None = None
    table: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "rows": None, "table": None}

    def look_up(self, words: list[str]) -> np.ndarray:
        """Potentials of all words, computed once for each distinct word of a task."""
        if self.rows is None or len(self.rows) > CACHED_WORDS:
            self.rows, self.table = _Rows(), np.empty((len(self.langs), 0), np.float32)
        numbers = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        if new := self.rows.new:
            fresh = _scores(self.weights, *_features(new, self.lexicon), len(new))
            self.table = np.concatenate([self.table, fresh.astype(np.float32)], axis=1)
            self.rows.new = []
        return self.table[:, numbers]

    def forget(self) -> None:
        """Let go of the words met in texts."""
        self.rows = self.table = None

    def label(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word marginals of all texts, one text after the other, and their word numbers."""
        words: list[str] = []
        lengths: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            own, of = chains(text)
            words += own
            lengths += of
            counts[i] = len(own)
        if not words:
            return np.empty((len(self.langs), 0)), counts
        transition = np.exp(self.transition).astype(np.float32)
        start = np.exp(self.start).astype(np.float32)
        found, _ = forward_backward(self.look_up(words), np.array(lengths), transition, start)
        return found, counts


def _training_rows(docs: DataFrame, text: str, lang: str, sample: Sample) -> DataFrame:
    """(lang, text) of the sampled documents; the limit is applied before the shuffle.

    Documents of at most ``Sample.characters`` come first; of a longer one that many in a
    row are taken, from a place that the hash of its id names.
    """
    size = F.length("text")
    begin = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), size - sample.characters)).cast("int")
    part = F.substring(F.col("text"), begin + 1, F.lit(sample.characters))
    rows = (
        docs.select(
            F.col("doc_id").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")
        )
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
        .withColumn("long", size > sample.characters)
        .withColumn("text", F.when(F.col("long"), part).otherwise(F.col("text")))
    )
    order = Window.partitionBy("lang").orderBy("long", F.xxhash64("id"), "id", F.xxhash64("text"))
    ranked = rows.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= sample.documents).select("lang", "text")


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_PART == 0


def fit(labelled: Sequence[tuple[str, str]], lexicon: int, steps: int = 30) -> Model:
    """Maximise the likelihood of the labels (each word has its text's) by Adam steps."""
    labelled = sorted(labelled)
    langs = sorted({lang for lang, _ in labelled})
    words: list[str] = []
    lengths: list[int] = []
    labels: list[np.ndarray] = []
    common: dict[str, Counter] = {lang: Counter() for lang in langs}
    for lang, text in labelled:
        own, of = chains(text)
        words += own
        lengths += of
        labels.append(np.full(len(own), langs.index(lang)))
        common[lang].update(own)
    known = dict.fromkeys(w for c in common.values() for w, n in c.most_common(lexicon) if n > 1)
    n = len(langs)
    lexicon_rows = dict(zip(known, range(len(known))))
    weights = np.zeros((n, BUCKETS + len(known)))
    model = Model(langs, weights, np.zeros((n, n)), np.zeros(n), lexicon_rows)
    if n < 2 or not words:
        return model
    index = {word: i for i, word in enumerate(dict.fromkeys(words))}
    owner, found = _features(list(index), lexicon_rows)
    shape = (1 / np.sqrt(np.bincount(owner, minlength=len(index))))[owner]
    at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    gold = np.concatenate(labels)
    chain = np.array(lengths)
    follows = np.ones(len(words), bool)
    follows[np.cumsum(chain) - 1] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (gold[:-1][follows[:-1]], gold[1:][follows[:-1]]), 1)
    target = np.stack([np.bincount(at[gold == k], minlength=len(index)) for k in range(n)])
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (weights, model.transition)]
    for step in range(1, steps + 1):
        potentials = _scores(weights, owner, found, len(index))
        marginals, pairs = forward_backward(
            potentials[:, at], chain, np.exp(model.transition), np.exp(model.start), True
        )
        expected = np.stack([np.bincount(at, m, len(index)) for m in marginals])
        to_words = target - expected
        slope = np.stack([np.bincount(found, g[owner] * shape, weights.shape[1]) for g in to_words])
        slopes = (slope - 0.05 * weights, (seen - pairs) - 20 * model.transition)
        for w, (first, second), pull in zip((weights, model.transition), moments, slopes):
            first += 0.1 * (pull - first)
            second += 0.01 * (pull**2 - second)
            size = np.sqrt(second / (1 - 0.99**step)) + 1e-6
            w += 0.1 * (first / (1 - 0.9**step)) / size
    return model


def train(
    docs: DataFrame, text: str = "text", lang: str = "lang", sample: Sample = Sample()
) -> Model:
    rows = _training_rows(docs, text, lang, sample).collect()
    return fit([(row["lang"], row["text"]) for row in rows], sample.lexicon)


def predict(docs: DataFrame, model: Model) -> Column:
    """struct(lang_pred, score, n_words, n_switches) of the text column it is applied to."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType(
        [
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_switches", T.LongType()),
        ]
    )

    @F.pandas_udf(kind)
    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                yield pd.DataFrame(
                    _answers(shared.value, batch.tolist()),
                    columns=["lang_pred", "score", "n_words", "n_switches"],
                )
        finally:
            # A worker that waits for other tasks holds its memory.
            shared.value.forget()

    return labelled


def _answers(model: Model, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
    groups = in_groups([text or "" for text in texts])
    return [answer for group in groups for answer in _group_answers(model, group)]


def _group_answers(model: Model, texts: list[str]) -> list[tuple[str, float, int, int]]:
    if not model.langs:
        return [(UNKNOWN, 0.0, 0, 0)] * len(texts)
    marginals, counts = model.label(texts)
    ends = np.cumsum(counts)
    answers = []
    best = marginals.argmax(axis=0)
    switch = np.concatenate([[0], np.cumsum(best[1:] != best[:-1])]) if len(best) else best
    for text, begin, end in zip(texts, ends - counts, ends):
        if begin == end or not any(map(str.isalpha, text)):
            answers.append((UNKNOWN, 0.0, int(end - begin), 0))
            continue
        share = marginals[:, begin:end].mean(axis=1, dtype=np.float64)
        top = int(share.argmax())
        score = min(1.0, float(share[top]))
        answers.append((model.langs[top], score, int(end - begin), int(switch[end - 1] - switch[begin])))
    return answers


def document_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, n_words, n_switches."""
    model = model or train(docs)
    found = docs.select("doc_id", predict(docs, model)(F.col("text")).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.*")


def keep_known(docs: DataFrame, model: Model | None = None, least: float = 0.3) -> DataFrame:
    """The rows, all columns as they are, whose language is known with ``least`` of the words."""
    model = model or train(docs)
    rows = docs.select(F.struct("*").alias("row"))
    found = rows.withColumn("p", predict(docs, model)(F.col("row.text")))
    return found.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
