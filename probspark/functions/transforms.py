"""Invertible data transforms: fit with one aggregate, apply as Column expressions. Missing cells stay null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rng import uniform
from .stats import balanced, known


class Transform:
    """fit(df) -> self, forward(df) and backward(df) over the same columns."""

    def __init__(self, cols: Sequence[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame) -> Transform:
        return self

    def _map(self, df: DataFrame, f) -> DataFrame:
        return df.withColumns({c: f(i, known(c)) for i, c in enumerate(self.cols)})


class Normalizer(Transform):
    """Min-max scaling of all cells into an interval; values outside the fitted range are clipped if asked."""

    def __init__(self, cols: Sequence[str], interval: tuple[float, float] = (0.0, 1.0), clip: bool = False):
        super().__init__(cols)
        if interval[0] >= interval[1]:
            raise ValueError("interval must grow")
        self.a, self.b, self.clip = *interval, clip

    def fit(self, df: DataFrame) -> Normalizer:
        r = df.agg(F.min(F.least(*[known(c) for c in self.cols], F.lit(None).cast("double"))).alias("lo"), F.max(F.greatest(*[known(c) for c in self.cols], F.lit(None).cast("double"))).alias("hi")).first()
        self.lo, self.hi = r["lo"], r["hi"]
        return self

    def forward(self, df: DataFrame) -> DataFrame:
        def f(i: int, x: Column) -> Column:
            y = (x - self.lo) / (self.hi - self.lo)
            y = F.when(x.isNotNull(), F.greatest(F.least(y, F.lit(1.0)), F.lit(0.0))) if self.clip else y
            return y * (self.b - self.a) + self.a

        return self._map(df, f)

    def backward(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda i, x: (x - self.a) / (self.b - self.a) * (self.hi - self.lo) + self.lo)


class Standardizer(Transform):
    """(x - mean) / (population sigma + eps), per feature or over all cells."""

    def __init__(self, cols: Sequence[str], per_feature: bool = True, eps: float = 1e-7):
        super().__init__(cols)
        self.per_feature, self.eps = per_feature, eps

    def fit(self, df: DataFrame) -> Standardizer:
        r = df.agg(*[f(known(c)).alias(f"{n}{i}") for i, c in enumerate(self.cols) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]).first()
        n, m, s = ([r[f"{k}{i}"] for i in range(len(self.cols))] for k in "nms")
        if not self.per_feature:
            mean = sum(a * b for a, b in zip(n, m, strict=True)) / sum(n)
            sigma = math.sqrt(sum(a * (v * v + (b - mean) ** 2) for a, b, v in zip(n, m, s, strict=True)) / sum(n))
            m, s = [mean] * len(m), [sigma] * len(s)
        self.mean, self.sigma = m, s
        return self

    def forward(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda i, x: (x - self.mean[i]) / (self.sigma[i] + self.eps))

    def backward(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda i, x: x * (self.sigma[i] + self.eps) + self.mean[i])


class Quantizer(Transform):
    """[0, 1] to 2^bits levels; backward adds uniform noise keyed by a row key."""

    def __init__(self, cols: Sequence[str], bits: int = 5, key: str | None = None, seed: int = 42):
        super().__init__(cols)
        self.levels, self.key, self.seed = 2**bits, key, seed

    def forward(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda i, x: F.when(x.isNotNull(), F.greatest(F.least(F.floor(x * self.levels), F.lit(self.levels - 1)), F.lit(0))).cast("double") / (self.levels - 1))

    def backward(self, df: DataFrame) -> DataFrame:
        noise = (lambda i: uniform(self.seed, self.key, F.lit(i))) if self.key else (lambda i: F.lit(0.0))
        return self._map(df, lambda i, x: (x * (self.levels - 1) + noise(i)) / self.levels)


class Logit(Transform):
    """x' = a + (1 - 2a) x, then log(x' / (1 - x'))."""

    def __init__(self, cols: Sequence[str], alpha: float = 0.05):
        super().__init__(cols)
        if not 0 < alpha < 1:
            raise ValueError("alpha must be in (0, 1)")
        self.alpha = alpha

    def _inner(self, x: Column) -> Column:
        return self.alpha + (1 - 2 * self.alpha) * x

    def forward(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda i, x: F.ln(self._inner(x)) - F.ln(1 - self._inner(x)))

    def backward(self, df: DataFrame) -> DataFrame:
        return self._map(df, lambda i, x: (1 / (1 + F.exp(-x)) - self.alpha) / (1 - 2 * self.alpha))

    def log_det(self) -> Column:
        """log |det| of forward at the untransformed columns."""
        return balanced([-F.ln(self._inner(known(c))) - F.ln(1 - self._inner(known(c))) for c in self.cols]) + len(self.cols) * math.log(1 - 2 * self.alpha)


class Chain(Transform):
    """Transforms one after another; backward in reverse."""

    def __init__(self, *steps: Transform):
        self.steps = steps

    def fit(self, df: DataFrame) -> Chain:
        for s in self.steps:
            df = s.fit(df).forward(df)
        return self

    def forward(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.forward(df)
        return df

    def backward(self, df: DataFrame) -> DataFrame:
        for s in reversed(self.steps):
            df = s.backward(df)
        return df


def one_hot(col: str, domain: Sequence, prefix: str | None = None) -> list[Column]:
    """One 0/1 column for each value of the domain, in its order; null stays null."""
    return [F.when(F.col(col).isNull(), None).otherwise((F.col(col) == v).cast("int")).alias(f"{prefix or col}_{k}") for k, v in enumerate(domain)]


def mixed_one_hot(cols: Sequence[str], doms: Sequence) -> list[Column]:
    """One-hot for domains of more than two values; others pass (a continuous (min, max) has two, an unknown one is None)."""
    return [c for name, d in zip(cols, doms, strict=True) for c in (one_hot(name, d) if d is not None and len(d) > 2 else [F.col(name)])]


def flatten(col: str) -> Column:
    """Array of arrays to array."""
    return F.flatten(col)


def reshape(col: str, rows: int, width: int) -> Column:
    """Flat array to rows of that width."""
    return F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice(F.col(col), i * width + 1, width))


def random_flip(col: str, key: str, seed: int = 42, p: float = 0.5) -> Column:
    """Array reversed with probability p, by the row's key."""
    return F.when(uniform(seed, key) < p, F.reverse(col)).otherwise(F.col(col))


def squeeze_order(c: int, h: int, w: int) -> list[int]:
    """Positions, in a flat (c, h, w) image, of the cells of its (4c, h/2, w/2) rearrangement: each channel becomes
    four, one for each corner of the 2 x 2 blocks."""
    return [k * h * w + (2 * y + dy) * w + 2 * x + dx for k in range(c) for dy in (0, 1) for dx in (0, 1) for y in range(h // 2) for x in range(w // 2)]


def squeeze(col: str, c: int, h: int, w: int) -> Column:
    return F.array(*[F.element_at(col, i + 1) for i in squeeze_order(c, h, w)])


def unsqueeze(col: str, c: int, h: int, w: int) -> Column:
    """Inverse of squeeze; c, h, w of the original image."""
    inverse = {src: k for k, src in enumerate(squeeze_order(c, h, w))}
    return F.array(*[F.element_at(col, inverse[i] + 1) for i in range(c * h * w)])


ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky-relu": lambda x: F.when(x > 0, x).otherwise(x * 0.01),
    "softplus": lambda x: F.log1p(F.exp(x)),
    "tanh": F.tanh,
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
}


def activation(name: str):
    """Column function by name."""
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name}")
    return ACTIVATIONS[name]
