"""Operator 8: toxicity by subword-bag embeddings and a linear softmax.

A word is the bag of its character n-grams (with word borders) and itself,
each hashed to a row of an embedding table. A stretch of words is the average
of its rows; a linear softmax over the average gives its class. Table and
softmax are trained together in numpy, so that an unseen misspelling scores by
the n-grams it shares with words seen. A document takes the score of its
worst stretch of STRETCH distinct words, in training as in scoring, since a few
words make a long text toxic. Repeats do not count, so that a word said over and
over is not judged more surely than one said once.

Training uses at most MOST_TOXIC and MOST_CLEAN labelled documents, those
whose ids have the smallest digests; this sample is all the driver holds.
Scoring reads every whole text.

Null and empty texts score as a stretch without words does: by the softmax's
bias. Labels that are null are not learnt from; a document with several
labels counts as toxic if one says so. Without toxic or without clean labels
the scores are the share of the labels there are (0 without any). Repeated
rows get equal scores. An empty table gives an empty one. Other columns of
the input are kept whatever their names, except the output column's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

MOST_TOXIC, MOST_CLEAN = 1200, 2400
ROWS, WIDTH = 1 << 17, 8
GRAMS = (3, 4, 5)
STRETCH = 32
#: rows of zeros that every average takes in, so that a stretch of few words is not judged by one
PAD = 400.0
#: stretches that must hold an n-gram for it to be learnt
LEAST = 8
STEPS, RATE, BIAS_RATE = 120, 0.05, 2.0
#: weight of all toxic documents in training
TOXIC_SHARE = 0.85
THRESHOLD = 0.7
#: toxic documents as many as which speak for the share of the labels alone
DOUBT = 4
MOST_WORDS, WORDS_AT_ONCE = 150_000, 5_000


_SIGNS = re.compile(r"(?:[^\w\s]|_)+")


def _rows_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word's n-grams, one word behind the other, and
    how many each word has."""
    points = [np.frombuffer(f"<{w}>".encode("utf-32-le", "surrogatepass"), "<u4") for w in words]
    size = np.fromiter(map(len, points), np.int64, len(points))
    flat = np.concatenate(points).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    h, rows, owner = flat * np.uint64(0x9E3779B97F4A7C15), [], []
    for n in range(2, max(GRAMS) + 1):
        k = len(flat) - n + 1
        if k <= 0:
            break
        h = ((h[:k] ^ h[:k] >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)) + flat[n - 1:]
        if n in GRAMS:
            inside = np.flatnonzero(word[:k] == word[n - 1:])
            rows.append(h[inside] * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - ROWS.bit_length() + 1))
            owner.append(word[inside])
    # the whole word: the sum of its points by place
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    mixed = (flat + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    mixed ^= mixed >> np.uint64(29)
    whole = np.add.reduceat(mixed, np.cumsum(size) - size)
    rows.append(whole * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - ROWS.bit_length() + 1))
    owner.append(np.arange(len(words)))
    rows, owner = np.concatenate(rows).astype(np.int64), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return rows[order], np.bincount(owner, minlength=len(words))


def distinct_words(text: str) -> list[str]:
    """The words of a text in order of first occurrence, without what is
    neither letter nor digit: signs that many words end in would else be
    n-grams of their own, learnt for the few texts that hold them."""
    return list(dict.fromkeys(_SIGNS.sub("", text.lower()).split()))


@dataclass
class Model:
    """Embeddings, softmax weights and bias; ``odds`` holds, for each table
    row, what it adds to the log odds before averaging."""

    embedding: np.ndarray
    weight: np.ndarray
    bias: np.ndarray

    @property
    def odds(self) -> np.ndarray:
        return self.embedding @ (self.weight[:, 1] - self.weight[:, 0])

    @property
    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def constant(share: float) -> Model:
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros((ROWS, WIDTH)), np.zeros((WIDTH, 2)), np.array([0.0, np.log(p / (1 - p))]))


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 8) -> Model:
    """Descent on the cross entropy of the documents' worst stretches; the first
    third of the steps average over all stretches, so that the worst ones
    are not picked at random."""
    if not len(labels) or labels.min() == labels.max():
        return constant(float(labels.mean()) if len(labels) else 0.0)
    index: dict[str, int] = {}
    words, stretch_of, doc_of = [], [], []
    for d, t in enumerate(texts):
        own = distinct_words(t)
        for lo in range(0, len(own), STRETCH):
            part = [index.setdefault(w, len(index)) for w in own[lo:lo + STRETCH]]
            words.append(np.array(part, np.int32))
            stretch_of.append(len(part))
            doc_of.append(d)
    if not words:
        return constant(float(labels.mean()))
    size = np.asarray(stretch_of)
    flat = np.concatenate(words)
    doc = np.asarray(doc_of)
    first = np.cumsum(size) - size
    # the rows of all words, a part at a time; those of few stretches would
    # learn their documents and not their class, and stay at zero
    met = np.bincount(flat, minlength=len(index))
    times, n_rows, rows, word_of = np.zeros(ROWS), [], [], []
    vocabulary = list(index)
    del index, words
    for lo in range(0, len(vocabulary), WORDS_AT_ONCE):
        some, n = _rows_of(vocabulary[lo:lo + WORDS_AT_ONCE])
        owner = np.repeat(np.arange(lo, lo + len(n)), n)
        times += np.bincount(some, met[owner], ROWS)
        n_rows.append(n)
        rows.append(some.astype(np.int32))
        word_of.append(owner.astype(np.int32))
    common = times >= LEAST
    n_rows = np.concatenate(n_rows)
    for k in range(len(rows)):
        keep = common[rows[k]]
        rows[k], word_of[k] = rows[k][keep], word_of[k][keep]
    rows, word_of = np.concatenate(rows), np.concatenate(word_of)
    bag = np.add.reduceat(n_rows[flat], first) + PAD
    held = np.unique(doc)
    doc_first = np.searchsorted(doc, held)
    y = labels[held].astype(np.float64)
    balance = np.where(y == 1, TOXIC_SHARE / max(y.sum(), 1), (1 - TOXIC_SHARE) / max((1 - y).sum(), 1))
    rng = np.random.default_rng(seed)
    model = Model(rng.normal(0, 0.05, (ROWS, WIDTH)), rng.normal(0, 0.5, (WIDTH, 2)), np.zeros(2))
    model.embedding[~common] = 0.0
    state = [np.zeros_like(x) for x in (model.embedding, model.weight)]
    for step in range(1, steps + 1):
        per_word = np.bincount(word_of, model.odds[rows], len(n_rows))
        total = np.add.reduceat(per_word[flat], first)
        logit = total / bag + model.offset
        if step * 3 <= steps:  # share of each stretch in its document's average
            part = bag / np.repeat(np.add.reduceat(bag, doc_first), np.diff(np.append(doc_first, len(doc))))
        else:
            top = np.maximum.reduceat(logit, doc_first)
            hit = logit == np.repeat(top, np.diff(np.append(doc_first, len(doc))))
            part = hit / np.repeat(np.add.reduceat(hit.astype(float), doc_first), np.diff(np.append(doc_first, len(doc))))
        z = np.add.reduceat(part * logit, doc_first)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * balance
        by_stretch = part * np.repeat(error, np.diff(np.append(doc_first, len(doc)))) / bag
        by_word = np.bincount(flat, np.repeat(by_stretch, size), len(n_rows))
        by_row = np.bincount(rows, by_word[word_of], ROWS)
        turn = model.weight[:, 1] - model.weight[:, 0]
        down = by_row @ model.embedding
        gradients = (by_row[:, None] * turn[None, :], np.stack([-down, down], axis=1))
        # one step length for all: rare rows then learn little, unlike with
        # steps scaled by row, by which they would learn their documents
        pace = RATE * (1 - (step - 1) / steps)
        for x, g, m in zip((model.embedding, model.weight), gradients, state, strict=True):
            m *= 0.9
            m += g
            x -= pace * (np.linalg.norm(x) + 1.0) * m / (np.linalg.norm(m) + 1e-12)
        model.bias += np.array([0.5, -0.5]) * BIAS_RATE * error.sum()
    # what few toxic documents have taught counts less than the labels' share
    trust, share = y.sum() / (y.sum() + DOUBT), y.mean()
    model.weight *= trust
    model.bias = trust * model.bias + (1 - trust) * np.array([0.0, np.log(share / (1 - share))])
    return model


class Scorer:
    """Scores texts; remembers words met before within a bounded memory."""

    def __init__(self, odds: np.ndarray, offset: float):
        self.odds, self.offset = odds, offset
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.total, self.count = np.zeros(1024), np.ones(1024)

    def learn(self, words: list[str]) -> None:
        rows, n = _rows_of(words)
        have, need = len(self.index), len(self.index) + len(words)
        while need > len(self.total):
            self.total, self.count = np.resize(self.total, 2 * len(self.total)), np.resize(self.count, 2 * len(self.count))
        self.total[have:need] = np.add.reduceat(self.odds[rows], np.cumsum(n) - n)
        self.count[have:need] = n
        self.index.update(zip(words, range(have, need), strict=True))

    def scores(self, texts: list[str]) -> Iterator[float]:
        if len(self.index) > MOST_WORDS:
            self.forget()
        cut = [distinct_words(t) for t in texts]
        new = list(set().union(*cut).difference(self.index)) if cut else []
        if new:
            self.learn(new)
        for own in cut:
            if not own:
                yield self.offset
                continue
            at = np.fromiter(map(self.index.__getitem__, own), np.int64, len(own))
            first = np.arange(0, len(at), STRETCH)
            yield float((np.add.reduceat(self.total[at], first) / (np.add.reduceat(self.count[at], first) + PAD)).max()) + self.offset


_SCORERS: dict[int, Scorer] = {}


def scorer_of(shared: tuple[np.ndarray, float]) -> Scorer:
    """This Python worker's scorer for a broadcast model; the words it
    remembers serve the worker's later tasks."""
    known = _SCORERS.get(id(shared))
    if known is None or known.odds is not shared[0]:
        _SCORERS.clear()
        known = _SCORERS[id(shared)] = Scorer(*shared)
    return known


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def learnable(doc_id: str = "doc_id") -> Column:
    """False for the third of ids that is held out of training."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """A model of the labelled documents that are not held out."""
    marked = (labels.where(learnable() & F.col("toxic").isNotNull()).groupBy("doc_id")
              .agg((F.max("toxic") > 0).alias("toxic")))
    order = (F.md5(F.col("doc_id").cast("string").cast("binary")), F.col("doc_id"))
    chosen = (marked.where("toxic").orderBy(*order).limit(most_toxic)
              .unionAll(marked.where("not toxic").orderBy(*order).limit(most_clean)))
    rows = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect())
    return train([r.text for r in rows], np.array([int(r.toxic) for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic. What is broadcast
    is one number for each row of the embedding table."""
    shared = docs.sparkSession.sparkContext.broadcast((model.odds, model.offset))

    @F.pandas_udf("double")
    def probabilities(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = scorer_of(shared.value)
        for part in parts:
            texts = part.tolist()
            yield pd.Series(probability(np.array([x for lo in range(0, len(texts), 256)
                                                  for x in scorer.scores(texts[lo:lo + 256])])))

    return docs.withColumn(out, probabilities(text_or_empty(text)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
