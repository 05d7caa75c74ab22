"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of a whole text (byte classes, words, lines, entropy) are standardised with the means
and deviations of the labelled rows. ``cos`` of ``FEATURES`` random projections of them approximates
a Gaussian kernel. Each partition sums its share of the normal equations; the sums are added in two
shuffles by matrix row, so the driver gets one matrix, however many rows there are. The raw scores of
the labelled rows are counted on a grid of ``1 / GRID`` and an isotonic fit over the grid's counts
makes them probabilities. All labelled rows take part; nothing is sampled.

Defined cases: null counts as empty; an empty text has all statistics 0 and a score like any other;
without labelled rows, or with one class only, every score is that class's share (0.5 without rows);
several labels of one id count once each; repeated rows repeat, and equal texts have equal scores; very long
texts are rows like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, encode, remainder, small_batches

FEATURES = 192
RIDGE = 0.1
GAMMA_SCALE = 0.25
GRID = 500
#: Groups of partitions whose sums are added first.
LOTS = 256
SEED = 11
THRESHOLD = 0.7
FOLDS, HELD = 4, 2

_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        0 if _c in " \t\r" else 1 if _c == "\n" else 2 if "a" <= _c <= "z" else 3 if "A" <= _c <= "Z" else 4 if "0" <= _c <= "9"
        else 5 if _c in ".,;:" else 6 if _c in "!?" else 7 if _c in "'\"()-" else 8 if _b < 32 or _b == 127 else 9 if _b < 128 else 10 if _b < 0xC0 else 11
    )
N_CLASSES = 12
N_STATS = N_CLASSES + 12


def statistics(raw: bytes) -> np.ndarray:
    """The statistics of one text; all 0 for an empty one."""
    out = np.zeros(N_STATS)
    if not raw:
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    out[:N_CLASSES] = np.sqrt(np.bincount(_CLASS, weights=counts, minlength=N_CLASSES) / n)
    p = counts[counts > 0] / n
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    k, kinds = max(1, len(words)), set(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    out[N_CLASSES:] = [
        np.log1p(n), -(p * np.log2(p)).sum(), np.log1p(sizes.mean()), sizes.std() / (1 + sizes.mean()), np.log1p(sizes.max()),
        len(kinds) / k, np.log1p(len(kinds)) / np.log1p(k), len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)),
        np.sqrt(counts[124] / k), np.sqrt(sum(counts[b] for b in b"#$%&*@^~_<>{}[]\\/+=") / n), np.log1p(k / max(1, len(lines))),
    ]
    return out


def statistics_of(texts: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([statistics(raw) for raw in encode(batch)])

    return run(texts)


class Model:
    """Standardisation, projections, weights, calibration; a few hundred kB."""

    def __init__(self, mean, deviation, weights, raw_at, share_at, constant=None):
        self.mean, self.deviation, self.weights = mean, deviation, weights
        self.raw_at, self.share_at, self.constant = raw_at, share_at, constant

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.deviation) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.interp(self.raw(stats), self.raw_at, self.share_at)

    def column(self, texts: Column) -> Column:
        @F.pandas_udf("double")
        def score(batch: pd.Series) -> pd.Series:
            return pd.Series(self.score(np.array([statistics(raw) for raw in encode(batch)]).reshape(-1, N_STATS)))

        return score(texts)


def projections() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(scale=GAMMA_SCALE / np.sqrt(N_STATS) * 2, size=(N_STATS, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)


def fourier(stats: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Random Fourier features and an intercept."""
    w, b = projections()
    x = np.clip((stats - mean) / deviation, -8, 8)
    return np.hstack([np.sqrt(2.0 / FEATURES) * np.cos(x @ w + b), np.ones((len(x), 1))])


def isotonic(values: list[float], ones: list[float], counts: list[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators over values in order: (value, share) of each pool's ends."""
    pools: list[list[float]] = []  # first value, last value, ones, count
    for v, a, n in zip(values, ones, counts, strict=True):
        pools.append([v, v, a, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    x, y = [], []
    for lo, hi, a, n in pools:
        for v in dict.fromkeys((lo, hi)):
            x.append(v)
            y.append(a / n)
    return x, y


def fit(rows: DataFrame) -> Model:
    """``rows``: stats array<double>, label int (0 or 1), already materialised."""
    one = rows.agg(
        F.count("*").alias("n"), F.sum("label").alias("ones"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)], *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)],
    ).first()
    if not one["n"] or one["ones"] in (0, one["n"]):
        return Model(None, None, None, None, None, constant=one["ones"] / one["n"] if one["n"] else 0.5)
    mean = np.array([one[f"m{i}"] for i in range(N_STATS)])
    deviation = np.array([max(one[f"s{i}"], 1e-3) for i in range(N_STATS)])
    size = FEATURES + 1

    def sums(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = fourier(np.stack(batch["stats"].to_numpy()), mean, deviation)
            total += z.T @ np.column_stack([z, batch["label"].to_numpy(np.float64)])
        yield pd.DataFrame({"at": range(size), "lot": TaskContext.get().partitionId() % LOTS, "row": list(total)})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": group["at"].iloc[:1], "lot": group["lot"].iloc[:1], "row": [np.sum(np.stack(group["row"].to_numpy()), axis=0)]})

    schema = "at int, lot int, row array<double>"
    parts = rows.select("stats", "label").mapInPandas(sums, schema).groupBy("at", "lot").applyInPandas(add, schema)  # no group has a row of every partition
    whole = np.stack([r["row"] for r in parts.groupBy("at").applyInPandas(add, schema).orderBy("at").collect()])
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(whole[:, :size] + penalty, whole[:, size])
    plain = Model(mean, deviation, weights, None, None)

    def graded(batches):
        for batch in batches:
            raw = plain.raw(np.stack(batch["stats"].to_numpy()))
            yield pd.DataFrame({"cell": np.rint(np.clip(raw, -1, 2) * GRID).astype(np.int32), "label": batch["label"]})

    cells = rows.select("stats", "label").mapInPandas(graded, "cell int, label int").groupBy("cell").agg(F.sum("label").alias("a"), F.count("*").alias("n")).orderBy("cell").collect()
    x, y = isotonic([r["cell"] / GRID for r in cells], [r["a"] for r in cells], [r["n"] for r in cells])
    return Model(mean, deviation, weights, x, y)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from."""
    doc_id = F.col("doc_id").cast("long")
    known = labels.select(doc_id.alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    return docs.join(known.filter(remainder(F.col("doc_id"), FOLDS) != HELD), "doc_id").select("stats", "label")


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of every row, materialised: a few hundred bytes a row."""
    small_batches(docs.sparkSession)
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), statistics_of(F.col(text_col)).alias("stats")))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the statistics it was fit on."""
    stats = with_statistics(docs)
    return fit(cut(labelled(stats, labels, "quality"))), stats


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every row of ``docs``."""
    model, stats = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batch: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.stack(batch.to_numpy())))

    scored = stats.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), score("stats").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
