"""Quality classifier: random Fourier features of document statistics, ridge regression by
partition-summed normal equations, isotonic calibration.

Steps
1. `document_statistics`: one pass over whole texts; per document, shares of character classes and
   shape statistics (word variety, repeated lines, ...). Its small rows are written once and reused.
2. Scaling and kernel width come from a bounded sample of labelled rows (`Config.scale_rows`).
3. Every partition of the labelled training rows sums its own Z'Z and Z'y; the sums meet row by row of
   the matrix, so no task holds more than partitions x one matrix row.
4. Isotonic calibration (pool adjacent violators) runs over a histogram of raw scores on a fixed grid,
   so that its driver-side input has at most `Config.grid` + 1 rows whatever the corpus size.

Null texts count as empty; an empty text has all-zero statistics and gets the score of that point.
Rows without a label, or with a null one, never reach the fit. With no labelled row at all, or one class
only, the score is the (smoothed) share of label 1, 0.5 if there is none. Repeated rows of one doc_id in
`labels` are averaged (ties of 0 and 1 give 0.5). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, slices, write_table

#: Character classes of UTF-8 bytes. Fixed values: (class, bytes).
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b" \t",
    b"\n\r",
    b".",
    b",;:",
    b"!",
    b"?",
    b"|",
    b"*#$%&@^~+=<>\\/_`",
    b"()[]{}\"'-",
    bytes(range(0xC0, 0x100)),
    bytes(range(0x80, 0xC0)),
]
N_CLASS = len(CLASSES) + 1
_CLASS_OF = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES):
    _CLASS_OF[list(_bytes)] = _k
#: Pairs of classes of adjacent bytes whose shares are statistics of their own.
PAIRS = [(0, 10), (5, 10), (10, 10), (10, 3), (1, 1), (1, 7), (7, 7), (3, 9), (9, 3), (0, 0), (3, 1), (0, 1), (4, 4)]
N_STATS = N_CLASS + len(PAIRS) + 7


@dataclass(frozen=True)
class Config:
    """features: random Fourier features. scale_rows: labelled rows at most for scaling and kernel width.
    ridge: penalty per training row. grid: bins of the calibration histogram. seed: of the frequencies."""

    features: int = 256
    scale_rows: int = 4000
    ridge: float = 1e-4
    grid: int = 2000
    seed: int = 7
    width: float = 1.0


def statistics_of(texts: list[str]) -> np.ndarray:
    """(n, N_STATS) statistics of whole texts; all arithmetic is per document, so batches don't matter."""
    return np.vstack([_statistics(texts[a:b]) for a, b in slices(texts)] or [np.zeros((0, N_STATS))])


def _statistics(texts: list[str]) -> np.ndarray:
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    n = len(raw)
    out = np.zeros((n, N_STATS))
    sizes = np.array([len(b) for b in raw], np.int64)
    if not sizes.sum():
        return out
    cls = _CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(n, dtype=np.int64), sizes)
    size = np.maximum(sizes, 1)[:, None]
    out[:, :N_CLASS] = np.bincount(doc * N_CLASS + cls, minlength=n * N_CLASS).reshape(n, N_CLASS) / size
    pair = cls[:-1].astype(np.int64) * N_CLASS + cls[1:]
    slot = np.full(N_CLASS * N_CLASS, -1, np.int64)
    for k, (a, b) in enumerate(PAIRS):
        slot[a * N_CLASS + b] = k
    at = slot[pair]
    inside = (doc[:-1] == doc[1:]) & (at >= 0)
    out[:, N_CLASS : N_CLASS + len(PAIRS)] = np.bincount(doc[:-1][inside] * len(PAIRS) + at[inside], minlength=n * len(PAIRS)).reshape(n, -1) / size
    out[:, : N_CLASS + len(PAIRS)] **= 0.5
    base = N_CLASS + len(PAIRS)
    for i, t in enumerate(raw):
        words = t.split()
        lines = t.split(b"\n")
        if words:
            first = words[0]
            out[i, base : base + 7] = (
                np.log1p(len(words)) / 5,
                len(set(words)) / len(words) ** 0.9,
                min(len(t) / len(words), 40) ** 0.5 / 3,
                1 - len(set(lines)) / len(lines),
                np.log1p(len(t) / len(lines)) / 5,
                words.count(first) / len(words),
                sum(map(eq, words, words[1:])) / len(words),
            )
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<float> of every document: one narrow pass, no shuffle."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = statistics_of(p["text"].tolist()).astype(np.float32)
            yield pd.DataFrame({"doc_id": p["doc_id"], "stats": list(s)})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, stats array<float>")


class QualityModel:
    """Scaling, frequencies, ridge weights and calibration steps; a few hundred kB whatever the corpus."""

    def __init__(self, mean, scale, freq, phase, weights, steps):
        self.mean, self.scale, self.freq, self.phase, self.weights, self.steps = mean, scale, freq, phase, weights, steps

    def lift(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features with a constant column."""
        z = np.cos((stats - self.mean) / self.scale @ self.freq + self.phase) * np.sqrt(2 / self.freq.shape[1])
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1."""
        at, p = self.steps
        return np.interp(self.raw(stats), at, p) if len(at) else np.full(len(stats), p[0])


def _isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to y with weights w."""
    blocks: list[list[float]] = []
    for v, k in zip(y, w, strict=True):
        blocks.append([v, k, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, k2, n2 = blocks.pop()
            v1, k1, n1 = blocks.pop()
            blocks.append([(v1 * k1 + v2 * k2) / (k1 + k2), k1 + k2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, config: Config = Config()) -> QualityModel:
    """stats: (doc_id, stats) of the training documents. labels: (doc_id, label 0/1)."""
    spark = stats.sparkSession
    lab = labels.select("doc_id", F.col("label").cast("double").alias("label")).where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("label").alias("label"))
    train = write_table(stats.select("doc_id", "stats").join(lab, "doc_id").select("doc_id", "stats", "label"), "quality-train")
    sample = train.orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(config.scale_rows).toPandas()
    rng = np.random.default_rng(config.seed)
    y = sample["label"].to_numpy(float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    empty = np.zeros(N_STATS), np.ones(N_STATS), np.zeros((N_STATS, config.features)), np.zeros(config.features), np.zeros(config.features + 1)
    if len(y) == 0 or y.min() == y.max():
        return QualityModel(*empty, (np.empty(0), np.array([share])))
    x = np.stack(sample["stats"].to_numpy()).astype(float)
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.02)
    u = (x - mean) / scale
    far = np.sqrt(((u[rng.permutation(len(u))] - u) ** 2).sum(1))
    sigma = config.width * max(np.median(far), 1e-3)
    model = QualityModel(mean, scale, rng.normal(0, 1 / sigma, (N_STATS, config.features)), rng.uniform(0, 2 * np.pi, config.features), empty[4], (np.empty(0), np.array([share])))
    shared = spark.sparkContext.broadcast(model)
    d = config.features + 1

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = np.zeros((d, d + 1))
        for p in parts:
            z = shared.value.lift(np.stack(p["stats"].to_numpy()).astype(float))
            a[:, :d] += z.T @ z
            a[:, d] += z.T @ p["label"].to_numpy(float)
        yield pd.DataFrame({"row": np.arange(d), "sums": list(a)})

    def total(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"row": p["row"].iloc[:1], "sums": [np.stack(p["sums"].to_numpy()).sum(0)]})

    schema = "row int, sums array<double>"
    got = train.mapInPandas(partial, schema).groupBy("row").applyInPandas(total, schema).toPandas().sort_values("row")
    a = np.stack(got["sums"].to_numpy())
    n = a[d - 1, d - 1]
    model.weights = np.linalg.solve(a[:, :d] + config.ridge * n * np.eye(d), a[:, d])
    shared = spark.sparkContext.broadcast(model)

    def bins(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((config.grid + 1, 2))
        for p in parts:
            s = np.clip(np.rint((shared.value.raw(np.stack(p["stats"].to_numpy()).astype(float)) + 0.5) / 2 * config.grid), 0, config.grid).astype(int)
            np.add.at(total, s, np.stack([np.ones(len(p)), p["label"].to_numpy(float)], 1))
        k = np.flatnonzero(total[:, 0])
        yield pd.DataFrame({"bin": k, "n": total[k, 0], "pos": total[k, 1]})

    h = train.mapInPandas(bins, "bin int, n double, pos double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).orderBy("bin").toPandas()
    w = h["n"].to_numpy()
    fitted = _isotonic(h["pos"].to_numpy() / w, w)
    at = h["bin"].to_numpy() / config.grid * 2 - 0.5
    model.steps = at, np.clip(fitted, 0, 1)
    return model


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score of every document, from whole texts in one narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"], "score": shared.value.score(statistics_of(p["text"].tolist()))})

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")


def score_statistics(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score from rows that document_statistics made."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = np.stack(p["stats"].to_numpy()).astype(float) if len(p) else np.zeros((0, N_STATS))
            yield pd.DataFrame({"doc_id": p["doc_id"], "score": shared.value.score(s)})

    return stats.select("doc_id", "stats").mapInPandas(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, config: Config = Config(), threshold: float = 0.3) -> DataFrame:
    """The whole operator: learn from labelled rows outside fold 0, score every document.

    Returns doc_id, held_out, score, predicted."""
    stats = write_table(document_statistics(docs), "quality-stats")
    model = fit(stats.where(fold("doc_id") != 0), labels, config)
    out = score_statistics(stats, model)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, config: Config = Config(), threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts, whole rows with all their columns, without a shuffle of texts."""
    stats = write_table(document_statistics(docs), "quality-stats")
    model = fit(stats.where(fold("doc_id") != 0), labels, config)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            s = shared.value.score(statistics_of(p["text"].tolist()))
            yield p[s >= threshold]

    bounded_batches(docs.sparkSession)
    return docs.mapInPandas(run, docs.schema)
