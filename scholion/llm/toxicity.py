"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (with marks for its start and end) and itself, hashed to
``BUCKETS`` embeddings; its vector is their mean, so a misspelling that was never seen still shares
most n-grams with the word it hides. A text is the mean of its different words' vectors, one that
occurs c times with the weight 1 + 0.3 ln c, and of ``PADDING`` zero vectors, lest chance sway a text of
a few words or of one line many times; a softmax over two classes reads it. Embeddings and softmax are trained together by limited-memory BFGS with a
quadratic penalty on a sample of labelled rows: at most ``SAMPLE`` of each class, those with the least
hash of their id, one text of each, of at most ``SAMPLE_CHARS`` characters in all. Both classes weigh the same, so a
score is the probability for classes of equal size.

Everything is linear before the softmax, so a worker scores a word once, keeps the score (for up to
``CACHE_WORDS`` words), and a text of any length costs one sum over all its words.

Defined cases: a null text or one without a word has the score of the bias alone; without labelled
rows of both classes the score is the toxic share (0 without rows); repeated rows repeat, ids and
labels may be null; ties of the ids' hash go to the lesser id; very long texts are scored whole, and learnt from whole
where they fit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder, small_batches

SAMPLE = 1500
SAMPLE_CHARS = 16_000_000
BUCKETS = 1 << 16
DIMS = 4
GRAMS = (3, 4)
STEPS = 50
HISTORY = 8
PENALTY = 2e-3
SCALE = 400.0
PADDING = 80
SEED = 5
CACHE_WORDS = 500_000
FIT_WORDS = 50_000
THRESHOLD = 0.7
FOLDS, HELD = 3, 1

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if isinstance(text, str) else []


def shares_of(text: str | None) -> tuple[dict[str, float], float]:
    """Weight of each different word, and what to divide by."""
    share = {w: 1.0 if c == 1 else 1.0 + 0.3 * math.log(c) for w, c in Counter(words_of(text)).items()}
    return share, sum(share.values()) + PADDING


def subwords(word: str) -> list[int]:
    """Buckets of the word and of its n-grams. A word of over 64 characters adds n-grams all along."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode("utf-8")) & (BUCKETS - 1) for g in grams]


class Bags:
    """Texts as sparse rows of bucket weights; products with dense matrices from either side."""

    def __init__(self, columns: list[np.ndarray], weights: list[np.ndarray], width: int):
        sizes = np.array([len(c) for c in columns], np.int64)
        self.col, self.weight = np.concatenate(columns), np.concatenate(weights)
        self.start, self.width = np.cumsum(sizes) - sizes, width
        by = np.argsort(self.col, kind="stable").astype(np.int32)
        self.t_row, self.t_weight = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[by], self.weight[by]
        self.used, self.t_start = np.unique(self.col[by], return_index=True)

    def dot(self, m: np.ndarray) -> np.ndarray:
        return np.column_stack([np.add.reduceat(np.ascontiguousarray(m[:, k])[self.col] * self.weight, self.start) for k in range(m.shape[1])])

    def t_dot(self, m: np.ndarray) -> np.ndarray:
        out = np.zeros((self.width, m.shape[1]), np.float32)
        for k in range(m.shape[1]):
            out[self.used, k] = np.add.reduceat(np.ascontiguousarray(m[:, k])[self.t_row] * self.t_weight, self.t_start)
        return out


def bag_of(text: str | None, known: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights: the mean over its words of the mean over their n-grams."""
    share, total = shares_of(text)
    share = share or {"": 0.0}
    if len(known) > FIT_WORDS:
        known.clear()
    parts = [known[w] if w in known else known.setdefault(w, np.array(subwords(w), np.int32)) for w in share]
    values = np.repeat([v / total / len(p) for v, p in zip(share.values(), parts, strict=True)], [len(p) for p in parts])
    ids, back = np.unique(np.concatenate(parts), return_inverse=True)
    return ids, np.bincount(back, weights=values).astype(np.float32)


def minimise(f, x: np.ndarray, steps: int) -> np.ndarray:
    """Limited-memory BFGS with backtracking; ``f`` gives value and gradient."""
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    value, g = f(x)
    for _ in range(steps):
        d, kept = -g, []
        for s, y, r in reversed(past):
            a = r * float(s @ d)
            d = d - a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            d = d * (float(s @ y) / float(y @ y))
        for (s, y, r), a in zip(past, reversed(kept), strict=True):
            d = d + (a - r * float(y @ d)) * s
        slope = float(g @ d)
        if slope >= 0:
            past, d, slope = [], -g, -float(g @ g)
        step = 1.0 if past else min(1.0, 1.0 / (float(np.linalg.norm(g)) + 1e-12))
        for _ in range(20):
            new, (then, h) = x + step * d, f(x + step * d)
            if then <= value + 1e-4 * step * slope:
                break
            step *= 0.5
        else:
            break
        s, y = step * d, h - g
        if float(s @ y) > 1e-10:
            past = [*past, (s, y, 1.0 / float(s @ y))][-HISTORY:]
        done = value - then < 1e-5 * max(1e-3, abs(value))
        x, value, g = new, then, h
        if done:
            break
    return x


class Model:
    """gram: logit (toxic minus not) that each bucket adds; bias. A quarter of a MB."""

    def __init__(self, gram: np.ndarray | None, bias: float):
        self.gram, self.bias = gram, bias

    def word(self, word: str) -> float:
        return float(self.gram[subwords(word)].mean())

    def scorer(self):
        """A function from texts to scores, with a cache of words of its own."""
        model = self

        class Words(dict):
            def __missing__(self, w: str) -> float:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                v = model.word(w)
                if len(w) <= 64:
                    self[w] = v
                return v

        get = Words().__getitem__

        def score(text: str | None) -> float:
            share, total = shares_of(text) if model.gram is not None else ({}, 1.0)
            x = model.bias + sum([get(w) * v for w, v in share.items()]) / total
            return float(1.0 / (1.0 + np.exp(-min(max(x, -40.0), 40.0))))

        return score

    def column(self, texts: Column) -> Column:
        model = self

        @F.pandas_udf("double")
        def run(batch: pd.Series) -> pd.Series:
            score = cached_scorer(model)
            return pd.Series([score(t) for t in batch], dtype="float64")

        return run(texts)


_SCORERS: dict[bytes, object] = {}


def cached_scorer(model: Model):
    """One scorer for each worker process and model, kept from batch to batch and task to task."""
    key = b"" if model.gram is None else zlib.crc32(model.gram.tobytes()).to_bytes(4, "big")
    key += repr(model.bias).encode()
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = model.scorer()
    return _SCORERS[key]


def split(x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, weights and biases of the softmax, out of one vector."""
    cut_e, cut_w = buckets * DIMS, buckets * DIMS + DIMS * 2
    return x[:cut_e].reshape(buckets, DIMS), x[cut_e:cut_w].reshape(DIMS, 2), x[cut_w:]


def objective(bags: Bags, y: np.ndarray):
    """The balanced cross-entropy with its penalty, and its gradient, as a function of that vector."""
    target = np.eye(2, dtype=np.float32)[y]
    balance = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)[:, None]
    cut_w = bags.width * DIMS + DIMS * 2

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        e, w, b = split(x, bags.width)
        h = bags.dot(e)
        z = h @ w + b
        z = z - z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        value = -float((balance * target * np.log(p + 1e-12)).sum()) + 0.5 * PENALTY * float((x[:cut_w] ** 2).sum())
        d = (p - target) * balance
        g = np.concatenate([bags.t_dot(d @ w.T).ravel(), (h.T @ d).ravel(), d.sum(0)])
        g[:cut_w] += PENALTY * x[:cut_w]
        return value, g

    return loss


def folded(e: np.ndarray, w: np.ndarray, b: np.ndarray) -> Model:
    """All is linear before the softmax: what each bucket adds to the difference of the two classes."""
    return Model(((e @ w)[:, 1] - (e @ w)[:, 0]) * SCALE, float(b[1] - b[0]))


def train(texts: list[str], labels: list[int], share: float | None = None) -> Model:
    """Fit embeddings and softmax; ``share``: of label 1 among all labelled rows, the score where one class is missing."""
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        s = (float(y.mean()) if len(y) else 0.0) if share is None else share
        return Model(None, float(np.log(max(s, 1e-6) / max(1 - s, 1e-6))))
    known: dict[str, np.ndarray] = {}
    rows = [bag_of(t, known) for t in texts]
    known.clear()
    bags = Bags([r[0] for r in rows], [r[1] * np.float32(SCALE) for r in rows], BUCKETS)
    del rows
    loss = objective(bags, y)
    rng = np.random.default_rng(SEED)
    first = np.concatenate([rng.normal(scale=0.01, size=BUCKETS * DIMS), rng.normal(scale=1.0, size=DIMS * 2), np.zeros(2)]).astype(np.float32)
    return folded(*split(minimise(loss, first, STEPS), BUCKETS))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from labelled rows that are not held out; see the module for the bounds."""
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    known = known.filter(remainder(F.col("doc_id"), FOLDS) != HELD)
    there = known.join(docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")), "doc_id")
    shares = {r["label"]: r["count"] for r in there.groupBy("label").count().collect()}
    least = [F.xxhash64("doc_id"), F.col("doc_id")]
    one = there.groupBy("doc_id", "label").agg(F.max("n").alias("n"))
    some = one.filter("label = 1").orderBy(*least).limit(SAMPLE).union(one.filter("label = 0").orderBy(*least).limit(SAMPLE)).collect()
    # what fits is chosen by length, before any text is read
    chosen, total = [], 0
    for r in sorted(some, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["label"])):
        if total + r["n"] <= SAMPLE_CHARS:
            chosen.append((r["doc_id"], r["label"]))
            total += r["n"]
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, label int")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["label"]))
    texts, ys = [r["text"] for r in rows], [r["label"] for r in rows]
    n = sum(shares.values())
    return train(texts, ys, shares.get(1, 0) / n if n else 0.0)


def narrow(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, score all rows; the scoring itself doesn't shuffle."""
    small_batches(docs.sparkSession)
    rows = narrow(docs)
    scored = rows.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), fit(rows, labels).column(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
