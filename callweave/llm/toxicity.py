"""Toxicity: subword-bag embeddings averaged into a linear softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .labelled import examples, fold, logistic

BUCKETS = 1 << 17
SIZE = 8
#: Words of a window; one starts at each word.
WINDOW = 3
#: Training documents of each label; bounds what the driver holds, as their bytes are bounded too.
PER_CLASS = 4000
#: Parts of the training documents; each is scored by the model of the others, which calibrates the scores.
PARTS = 3
#: Steps of the training: windows at once, their rate, epochs on one choice of windows at most, and the loss that is low enough.
BATCH, RATE, EPOCHS, LOW = 128, 0.3, 40, 0.05
_LONGEST, _PART = 40, 20
_MARKS = "\"'.,;:!?()[]{}<>|*#$%&/\\-_=+~`@^“”‘’«»…–—¿¡"


def tokens(text: str) -> list[str]:
    """The text's words in lower case, marks included; very long ones in parts."""
    found = text.lower().split()
    if max(map(len, found), default=0) <= _LONGEST:
        return found
    return [t[i : i + (_PART if len(t) > _LONGEST else _LONGEST)] for t in found for i in range(0, len(t), _PART if len(t) > _LONGEST else _LONGEST)]


def bare(token: str) -> str:
    """A token without the marks around it."""
    return token.strip(_MARKS) or token


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' features end to end, and how many each has: the word itself and its 3- to 5-grams, marked at both ends."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    start = np.cumsum(size) - size
    word_of = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(codes))
    owners = [np.arange(len(words))]
    found = [np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], np.uint64)]
    grams = np.zeros(len(codes), np.uint64)
    for n in range(1, 6):
        shifted = np.zeros(len(codes), np.uint64)
        shifted[: max(0, len(codes) - n + 1)] = codes[n - 1 :]
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
        if n >= 3:
            ok = left >= n
            found.append(grams[ok] ^ np.uint64(n << 58))
            owners.append(word_of[ok])
    owner = np.concatenate(owners)
    buckets = (np.concatenate(found) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    order = np.argsort(owner, kind="stable")
    return buckets[order].astype(np.int32), np.bincount(owner, minlength=len(words)).astype(np.int32)


def window_means(scores: np.ndarray) -> np.ndarray:
    """The mean score of each window of WINDOW words; fewer words are one window, no words one of zero."""
    if len(scores) <= WINDOW:
        return np.array([scores.mean() if len(scores) else 0.0])
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return (sums[WINDOW:] - sums[:-WINDOW]) / WINDOW


@dataclass
class Model:
    """Each bucket's part in the logit of a window, the windows' bias, and weights of the largest window logit, the log of their number, and 1."""

    weights: np.ndarray
    bias: float
    scale: np.ndarray

    def score(self, largest: np.ndarray, windows: np.ndarray) -> np.ndarray:
        z = self.scale[0] * largest + self.scale[1] * np.log(windows) + self.scale[2]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Vocabulary:
    """The subwords of many words, worked out some at a time."""

    def __init__(self, words: Sequence[str], at_once: int = 50_000):
        found = [subwords(words[a : a + at_once]) for a in range(0, len(words), at_once)]
        self.buckets, self.n = (np.concatenate(x) for x in zip(*found, strict=True))
        self.start = np.cumsum(self.n, dtype=np.int64) - self.n

    def scores(self, weights: np.ndarray, at_once: int = 50_000) -> np.ndarray:
        """The mean weight of each word's subwords."""
        out = []
        for a in range(0, len(self.n), at_once):
            n = self.n[a : a + at_once]
            first = int(self.start[a])
            own = weights[self.buckets[first : first + int(n.sum())]]
            out.append(np.add.reduceat(own, self.start[a : a + at_once] - first) / n)
        return np.concatenate(out)


class Words:
    """The scores of tokens, each worked out once; emptied when it holds too many."""

    def __init__(self, weights: np.ndarray, keep: int = 300_000):
        self.weights, self.keep, self.known = weights, keep, {}

    def of(self, found: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known = {}
        new = list(set(found).difference(self.known))
        if new:
            self.known.update(zip(new, Vocabulary([bare(t) for t in new]).scores(self.weights).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, found), np.float64, len(found))


class Trainer:
    """Embeddings and softmax, trained jointly with Adagrad on windows of word ids."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        self.embed = rng.normal(0, 0.1, (BUCKETS, SIZE)).astype(np.float32)
        self.soft = rng.normal(0, 1.0, (SIZE, 2))
        self.bias = np.zeros(2)
        self.seen = np.full(BUCKETS, 1e-3)
        self.seen_soft, self.seen_bias = np.full((SIZE, 2), 1e-3), np.full(2, 1e-3)

    def step(self, word: np.ndarray, window: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """word[i] stands in window[i] (ascending); y and weight are the windows' labels and weights. Returns the loss before the step."""
        v = self.vocabulary
        count = np.maximum(1, np.bincount(window, minlength=len(y)))
        n = v.n[word]
        ends = np.cumsum(n)
        at = v.buckets[np.repeat(v.start[word] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        touched, back = np.unique(at, return_inverse=True)
        share = np.repeat(1 / (n * count[window]), n)
        owner = np.repeat(window, n)
        # Each window's share of each feature it holds, as pairs without repeats.
        pair, of = np.unique(owner * np.int64(len(touched)) + back, return_inverse=True)
        share = np.bincount(of, share)
        owner, back = pair // len(touched), pair % len(touched)
        own = self.embed[touched]
        mean = np.stack([np.bincount(owner, own[back, d] * share, len(y)) for d in range(SIZE)], 1)
        z = mean @ self.soft + self.bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        picked = np.arange(len(y)), y
        loss = float(-(weight * np.log(np.maximum(p[picked], 1e-12))).sum() / weight.sum())
        g = p.copy()
        g[picked] -= 1
        g *= (weight / weight.sum())[:, None]
        to_mean = g @ self.soft.T
        for param, seen, grad in ((self.soft, self.seen_soft, mean.T @ g), (self.bias, self.seen_bias, g.sum(0))):
            seen += grad**2
            param -= rate * grad / np.sqrt(seen)
        grad = np.stack([np.bincount(back, to_mean[owner, d] * share, len(touched)) for d in range(SIZE)], 1)
        self.seen[touched] += (grad**2).mean(1)
        self.embed[touched] -= rate * grad / np.sqrt(self.seen[touched])[:, None]
        return loss

    def model(self) -> tuple[np.ndarray, float]:
        return self.embed @ (self.soft[:, 1] - self.soft[:, 0]), float(self.bias[1] - self.bias[0])


def first_scores(docs: list[np.ndarray], y: np.ndarray, words: int) -> np.ndarray:
    """What a word says of a text at least: the log-odds of texts that hold it, less one and a half standard errors, but not below zero."""
    counts = np.zeros((2, words))
    for d, k in zip(docs, y, strict=True):
        counts[k, np.unique(d)] += 1
    each = np.array([(y == k).sum() for k in (0, 1)])[:, None]
    odds = np.log((counts + 0.5) / (each - counts + 0.5))
    error = np.sqrt((1 / (counts + 0.5) + 1 / (each - counts + 0.5)).sum(0))
    return np.maximum(0.0, odds[1] - odds[0] - 1.5 * error)


def train_windows(docs: list[np.ndarray], y: np.ndarray, vocabulary: Vocabulary, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Bucket weights and bias of a model of windows.

    A text is toxic if one of its windows is, so each round trains on the toxic texts' windows that score highest by
    then, against the clean texts' highest and one other, until the loss is low or no longer falls. Scores start as
    cautious log-odds of the words.
    """
    rng = np.random.default_rng(seed)
    trainer = Trainer(vocabulary, seed)
    scores = first_scores(docs, y, len(vocabulary.n))
    for _ in range(rounds):
        chosen: list[tuple[np.ndarray, int]] = []
        for d, k in zip(docs, y.tolist(), strict=True):
            means = window_means(scores[d])
            best = int(np.argmax(means))
            chosen += [(d[i : i + WINDOW], k) for i in ([best] if k else [best, int(rng.integers(len(means)))])]
        label = np.array([k for _, k in chosen])
        weight = np.where(label == 1, (label == 0).sum() / max(1, (label == 1).sum()), 1.0)
        past: list[float] = []
        while len(past) < EPOCHS and not (past and past[-1] < LOW) and not (len(past) > 6 and past[-1] > 0.97 * past[-4]):
            order = rng.permutation(len(chosen))
            loss = []
            for a in range(0, len(order), BATCH):
                own = order[a : a + BATCH]
                n = np.array([len(chosen[i][0]) for i in own])
                loss.append(trainer.step(np.concatenate([chosen[i][0] for i in own]), np.repeat(np.arange(len(own)), n), label[own], weight[own], RATE))
            past.append(float(np.mean(loss)))
        weights, bias = trainer.model()
        scores = vocabulary.scores(weights)
    return weights, bias


def train(texts: Sequence[str], labels: Sequence[int], rounds: int = 3, seed: int = 7) -> Model:
    """A model of labelled texts: the mean of PARTS models, each trained without one part of the texts.

    What each says of the part it hasn't seen calibrates the scores (a logistic regression on the largest window logit and
    the log of the number of windows). Fewer than two texts of a label for each part, or scores that don't rise with the label,
    give the toxic texts' smoothed share as every score.
    """
    y = np.array(labels, np.int64)
    share = (y.sum() + 1) / (len(y) + 2)
    none = Model(np.zeros(BUCKETS, np.float32), 0.0, np.array([0.0, 0.0, np.log(share / (1 - share))]))
    if min(y.sum(), len(y) - y.sum()) < 2 * PARTS:
        return none
    part = np.zeros(len(y), np.int64)
    for k in (0, 1):  # every part gets its share of each label
        part[y == k] = np.arange((y == k).sum()) % PARTS
    at: dict[str, int] = {}
    docs = [np.array([at.setdefault(bare(t), len(at)) for t in tokens(text)], np.int32) for text in texts]
    many = np.array([max(1, len(d) - WINDOW + 1) for d in docs])
    vocabulary = Vocabulary(list(at) or [""])
    del at
    largest, total, offset = np.zeros(len(y)), np.zeros(BUCKETS), 0.0
    for k in range(PARTS):
        fit = np.flatnonzero(part != k)
        weights, bias = train_windows([docs[i] for i in fit], y[fit], vocabulary, rounds, seed + k)
        scores = vocabulary.scores(weights)
        for i in np.flatnonzero(part == k):
            largest[i] = window_means(scores[docs[i]]).max() + bias
        total, offset = total + weights / PARTS, offset + bias / PARTS
    x = np.stack([largest, np.log(many), np.ones(len(y))], 1)
    balance = np.sqrt(np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum())))
    scale = logistic(x, y, balance, ridge=0.1)
    return Model(total.astype(np.float32), offset, scale) if scale[0] > 0 else none


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of a bounded sample of labelled documents outside fold 0."""
    found = examples(docs, labels, label, per_class, id_col, text_col)
    return train(found.column("text").to_pylist(), found.column("label").to_pylist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score (0 to 1), predicted (score of 0.5 or more) of every whole text.

    Only the text is used. A null text counts as empty; texts without words have the score of a window without words.
    A null id is held out or not as crc32 of null says: it is not. Repeated rows score alike. No rows give no
    rows; other columns are dropped. One pass without a shuffle; the model (one number a bucket) is broadcast.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        words = Words(own.weights)
        for batch in slices(batches):
            rows = [tokens(t) for t in batch.column("text").to_pylist()]
            flat = words.of([w for row in rows for w in row])
            ends = np.cumsum([0, *map(len, rows)])
            means = [window_means(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            made = own.score(np.array([m.max() for m in means]) + own.bias, np.array([len(m) for m in means]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made)], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
