"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character 3- and 4-grams and itself, hashed to `BUCKETS` embeddings, so an
unseen misspelling shares most vectors with the word it was made from. A window of `WINDOW` words is
the average of its words' averaged vectors; a linear softmax over that gives its class. A text is as
toxic as its most toxic window, of all that begin at any word; a run of one word counts once. Embeddings and softmax are trained
together by Adam: first on random windows of each labelled text, then on the window that the model finds
most toxic.

So that the model does not learn single texts by heart, only grams of at least `RARE` labelled texts have
a vector (others count as zero), and each step drops grams of the bags at random. One labelled text in
`FOLD` is not learned from: by these texts the best step of the training is chosen, and the bias is set
so that they are parted best (`COST`: how many shares of toxic texts found one share of false alarms
outweighs).

The model is fitted on the driver on a bounded sample of labelled rows: `POSITIVE` and `NEGATIVE` rows
at most, of ids that the documents have, and `TRAIN_BYTES` bytes of text. The order of the sample and the
texts' sizes are taken first, so only texts that fit reach the driver; a text that does not fit is left
out, and the rest still taken. Every whole text is scored, in Arrow batches.

Cases: null and empty texts, and those without words, score by the bias alone; labels that are null,
repeated or of unknown documents are ignored, reduced to their maximum, and ignored; without documents
labelled with each class, all scores are 0, but if only their texts' size keeps a class out, that fails; repeated rows score alike; other columns pass.
"""

from __future__ import annotations

import math
import re
from itertools import groupby
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BUCKETS, DIMENSION, WINDOW = 1 << 17, 8, 16
POSITIVE, NEGATIVE, TRAIN_BYTES = 1200, 2400, 24_000_000
ROUNDS, RANDOM_ROUNDS, RATE, DECAY, WEIGHT = 120, 60, 0.05, 0.005, 1.0
RARE, DROPPED, FOLD, COST, LOOK = 8, 0.5, 5, 12.0, 5
#: Words that a worker remembers before it begins anew; bounds its memory, not its results.
REMEMBERED = 500_000
WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[int]:
    data, mask = f"<{word}>".encode(), BUCKETS - 1
    n = len(data)
    return [crc32(data) & mask] + [crc32(data[i : i + 3]) & mask for i in range(n - 2) if n > 3] + [crc32(data[i : i + 4]) & mask for i in range(n - 3) if n > 4]


def logistic(x: float) -> float:
    e = math.exp(-abs(x))
    return 1 / (1 + e) if x >= 0 else e / (1 + e)


def tops(each: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For texts that follow each other (ends: where), the greatest mean of WINDOW words of each (of all, where it has fewer), and where that window begins."""
    starts = np.r_[0, ends[:-1]]
    size = np.minimum(ends - starts, WINDOW)
    total = np.r_[0.0, np.cumsum(each)]
    at = np.arange(len(each))
    stop = np.minimum(at + WINDOW, np.repeat(ends, ends - starts))
    begin = np.maximum(np.minimum(at, stop - np.repeat(size, ends - starts)), 0)
    mean = (total[stop] - total[begin]) / np.repeat(size, ends - starts)
    best = np.maximum.reduceat(mean, starts)
    place = np.flatnonzero(mean == np.repeat(best, ends - starts))
    return best, begin[place[np.searchsorted(place, starts)]]


class Model:
    """margin: each bucket's share of the fitted softmax's logit, which is linear in the average, so a word adds one number; bias: the rest."""

    def __init__(self, margin: np.ndarray, bias: float) -> None:
        self.margin, self.bias = margin, bias

    def score(self, worth: Words, text: str) -> float:
        words = [w for w, _ in groupby(WORD.findall(text.lower()))]  # a run of one word counts once
        if not words:
            return logistic(self.bias)
        each = np.fromiter(map(worth.__getitem__, words), np.float64, len(words))
        total = np.cumsum(each)
        best = total[-1] / len(each) if len(each) <= WINDOW else max(total[WINDOW - 1], float((total[WINDOW:] - total[:-WINDOW]).max())) / WINDOW
        return logistic(float(best) + self.bias)


class Words(dict):
    """word -> its average margin."""

    def __init__(self, model: Model) -> None:
        self.margin = model.margin.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        bag = grams(word)
        value = self[word] = sum([self.margin[g] for g in bag]) / len(bag)
        return value


def flat_bags(vocabulary: dict[str, int], words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words' grams as numbers of those that at least RARE texts have (the others: the last number), where each word's end, and the numbers' buckets."""
    bags = [np.array(grams(w), np.int32) for w in vocabulary]
    gram, ends = np.concatenate(bags), np.cumsum([0, *map(len, bags)])
    texts = np.zeros(BUCKETS, np.int32)
    for w in words:
        texts[np.unique(np.concatenate([bags[k] for k in np.unique(w)]))] += 1
    known = np.flatnonzero(texts >= min(RARE, max(1, len(words) // 20)))
    number = np.full(BUCKETS, len(known))
    number[known] = np.arange(len(known))
    return number[gram], ends, known


def parted(scores: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The threshold that gives the greatest share of toxic texts found less COST times the share of false alarms, in the middle of where it holds; and that value."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], toxic[order]
    worth = np.r_[0.0, np.cumsum(np.where(y == 1, 1 / max(1, (y == 1).sum()), -COST / max(1, (y == 0).sum())))]
    edge = np.r_[True, s[1:] != s[:-1], True]
    at = int(np.argmax(np.where(edge, worth, -np.inf)))
    high, low = (s[at - 1] if at else s[0] + 2), (s[at] if at < len(s) else s[-1] - 2)
    return float(high + low) / 2, float(worth[at])


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """Adam on the windows of the learned texts; gradients go to the chosen windows' subwords."""
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w, _ in groupby(WORD.findall(t.lower()))], np.int32) for t in texts]
    kept = [k for k, w in enumerate(words) if len(w)]
    words, y = [words[k] for k in kept], np.array([toxic[k] for k in kept])
    if len(set(y)) < 2:
        return Model(np.zeros(BUCKETS), -np.inf)
    gram, bag, known = flat_bags(vocabulary, words)
    flat, ends = np.concatenate(words), np.cumsum([len(w) for w in words])
    starts, n = np.r_[0, ends[:-1]], len(words)
    nth = np.empty(n, int)  # within its class, in random order
    for k in (0, 1):
        of = np.flatnonzero(y == k)
        nth[rng.permutation(of)] = np.arange(len(of))
    learned = np.flatnonzero((nth % FOLD != 0) | (min((y == 0).sum(), (y == 1).sum()) < FOLD))
    fold = np.flatnonzero(nth % FOLD == 0) if len(learned) < n else np.arange(n)
    embeddings, weights, bias = rng.normal(0, 0.1, (len(known) + 1, DIMENSION)), rng.normal(0, 0.1, (DIMENSION, 2)), np.zeros(2)
    embeddings[-1] = 0
    # each class's weight: as if toxic texts were WEIGHT times as frequent in the sample
    share = np.where(y[learned] == 1, WEIGHT, 1.0)
    share /= share.sum()
    held = {k: np.zeros_like(v) for k, v in (("e", embeddings), ("e2", embeddings), ("w", weights), ("w2", weights), ("b", bias), ("b2", bias))}
    best: tuple[float, Model] | None = None
    for step in range(1, ROUNDS + 1):
        worth = np.add.reduceat((embeddings @ (weights[:, 1] - weights[:, 0]))[gram], bag[:-1]) / np.diff(bag)
        size = np.minimum(ends - starts, WINDOW)[learned]
        if step > RANDOM_ROUNDS:
            begin = tops(worth[flat], ends)[1][learned]
        else:
            begin = starts[learned] + (rng.random(len(learned)) * ((ends - starts)[learned] - size + 1)).astype(int)
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        word = flat[at]
        g = bag[word + 1] - bag[word]
        subword = gram[np.repeat(bag[word] - (np.cumsum(g) - g), g) + np.arange(g.sum())]
        text = np.repeat(np.repeat(np.arange(len(learned)), size), g)
        part = (rng.random(len(subword)) >= DROPPED) / (1 - DROPPED) / (np.repeat(g, g) * size[text])
        x = np.stack([np.bincount(text, part * embeddings[subword, d], len(learned)) for d in range(DIMENSION)], 1)
        logits = x @ weights + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(learned)), y[learned]] -= 1
        p *= share[:, None]
        back = p @ weights.T
        ge = np.stack([np.bincount(subword, part * back[text, d], len(embeddings)) for d in range(DIMENSION)], 1)
        ge[-1] = 0
        for name, value, grad in (("e", embeddings, ge), ("w", weights, x.T @ p), ("b", bias, p.sum(0))):
            held[name] = 0.9 * held[name] + 0.1 * grad
            held[f"{name}2"] = 0.99 * held[f"{name}2"] + 0.01 * grad**2
            value *= 1 - DECAY * (name == "e")  # else subwords seen seldom keep what they learnt
            value -= RATE * (held[name] / (1 - 0.9**step)) / (np.sqrt(held[f"{name}2"] / (1 - 0.99**step)) + 1e-8)
        if step > RANDOM_ROUNDS and step % LOOK == 0:
            margin = embeddings @ (weights[:, 1] - weights[:, 0])
            scores = tops((np.add.reduceat(margin[gram], bag[:-1]) / np.diff(bag))[flat], ends)[0]
            threshold, value = parted(scores[fold], y[fold])
            if best is None or value > best[0]:
                whole = np.zeros(BUCKETS)
                whole[known] = margin[:-1]
                best = value, Model(whole, -threshold)
    return best[1]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The rows that the model must not learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, positive: int = POSITIVE, negative: int = NEGATIVE) -> Model:
    """A model of `toxic` from a bounded sample of the labelled rows that are not held out."""
    each = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]"))
    fit_in = F.octet_length("text") <= TRAIN_BYTES
    known = each.where("toxic in (0, 1)").join(texts.where(fit_in).select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    some = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(most) for k, most in ((1, positive), (0, negative))]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in some[0].union(some[1]).collect()], "doc_id long, toxic int")
    sizes = texts.where(fit_in).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", order.alias("at"), F.xxhash64("text").alias("hash"), F.octet_length("text").alias("n")).distinct()
    rows = [r for k, most in ((1, positive), (0, negative)) for r in sizes.where(F.col("toxic") == k).orderBy("at", "doc_id", "hash").limit(most).collect()]
    picked, seen = [], 0
    for r in sorted(rows, key=lambda r: (r["at"], r["doc_id"], r["hash"])):
        if seen + r["n"] <= TRAIN_BYTES:  # what does not fit is left out, and the rest still taken
            seen += r["n"]
            picked.append((r["doc_id"], r["hash"], r["toxic"]))
    if len({y for *_, y in picked}) < 2:
        found = {r["toxic"] for r in each.where("toxic in (0, 1)").join(texts.select("doc_id"), "doc_id", "left_semi").select("toxic").distinct().collect()}
        if len(found) == 2:
            raise ValueError(f"labels of both classes exist, but no text of one of them fits into {TRAIN_BYTES} bytes")
        return fit([], [])
    few = docs.sparkSession.createDataFrame(picked, "doc_id long, hash long, toxic int").select(F.col("doc_id").alias("__id"), "hash", "toxic")  # at most positive + negative rows
    taken = texts.where(fit_in).join(F.broadcast(few), (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("hash")))
    sample = sorted({(r["doc_id"], r["text"], r["toxic"]) for r in taken.groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).collect()})
    return fit([t for _, t, _ in sample], [int(y) for *_, y in sample])


def scored(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), score: str = "score", predicted: str = "predicted") -> DataFrame:
    """`keep`, and under the given names the score (0 to 1) and what is predicted (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        worth = Words(shared.value)
        return lambda texts: [[shared.value.score(worth, t) for t in texts]]

    return map_texts(docs, text, keep, f"{score} double", make).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))
