"""Two lowerings of one circuit program: Spark columns, and NumPy arrays inside Arrow batches.

A program calls the same few operations on either. `Columns` binds every intermediate value to a column of its
layer (one projection per layer), so shared sub-circuits are worked out once and Catalyst sees plain expressions;
`Arrays` evaluates at once. Missing cells are null in one and NaN in the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..functions.stats import balanced, known

FLOOR = -1e31


class Columns:
    """Lowering to DataFrame projections."""

    def __init__(self, df: DataFrame, names: dict[int, str], key: str | None = None, seed: int = 42):
        self.df, self.names, self.key, self.seed = df, names, key, seed
        self.kept = list(df.columns)
        self.waiting: dict[str, Column] = {}
        self.made = 0
        # cells in one projection, so that no leaf works them out again
        self.cells = {var: self.bind(known(name)) for var, name in names.items()}
        self.flush()

    def x(self, var: int) -> Column:
        return self.cells[var]

    def const(self, v: float) -> Column:
        return F.lit(float(v))

    def missing(self, x: Column) -> Column:
        return x.isNull()

    def where(self, c: Column, a: Column, b: Column) -> Column:
        return F.when(c, a).otherwise(b)

    def table(self, x: Column, values: list[float], other: float) -> Column:
        """values[x] for whole x in range, else other."""
        if len(values) <= 16:
            out = F.when(x == 0.0, float(values[0]))
            for k, v in enumerate(values[1:], 1):
                out = out.when(x == float(k), float(v))
            return out.otherwise(float(other))
        cases = F.element_at(F.array(*[F.lit(float(v)) for v in values]), (x + 1).cast("int"))
        return F.when((x >= 0) & (x < len(values)) & (x == F.floor(x)), cases).otherwise(float(other))

    def steps(self, x: Column, breaks: list[float], values: list[float]) -> Column:
        """values[k] where breaks[k] <= x < breaks[k + 1]; the last value from its break on."""
        out = F.lit(float(values[-1]))
        if len(values) > 1:
            lo, width = breaks[0], (breaks[-1] - breaks[0]) / len(values)
            at = F.greatest(F.least(F.floor((x - lo) / width), F.lit(len(values) - 1)), F.lit(0)).cast("int")
            out = F.element_at(F.array(*[F.lit(float(v)) for v in values]), at + 1)
        return out

    def add(self, terms: list[Column]) -> Column:
        return balanced(terms)

    def either(self, terms: list[Column]) -> Column:
        return balanced(terms, lambda a, b: a | b)

    def both(self, a: Column, b: Column) -> Column:
        return a & b

    def exp(self, x: Column) -> Column:
        return F.exp(x)

    def lse(self, terms: list[Column]) -> Column:
        if len(terms) == 1:
            return terms[0]
        top = self.bind(F.greatest(*terms), now=True)
        return top + F.ln(balanced([F.exp(t - top) for t in terms]))

    def greatest(self, terms: list[Column]) -> Column:
        return F.greatest(*terms) if len(terms) > 1 else terms[0]

    def floor(self, x: Column) -> Column:
        return F.greatest(x, F.lit(FLOOR))

    def argmax(self, terms: list[Column]) -> Column:
        """Position of the greatest; the first of equals."""
        if len(terms) == 1:
            return F.lit(0)
        top = self.bind(F.greatest(*terms), now=True)
        return F.coalesce(*[F.when(t == top, F.lit(i)) for i, t in enumerate(terms)])

    def is_(self, branch: Column, i: int) -> Column:
        return branch == i

    def true(self) -> Column:
        return F.lit(True)

    def uniform(self, *where: int) -> Column:
        if self.key is None:
            raise ValueError("sampling needs a row key")
        return uniform(self.seed, self.key, *[F.lit(w) for w in where])

    def below(self, u: Column, cuts: list[Column]) -> Column:
        """Number of cuts (growing) at or below u."""
        return F.coalesce(*[F.when(u < c, F.lit(i)) for i, c in enumerate(cuts)], F.lit(len(cuts)))

    def normal(self, u: Column, v: Column) -> Column:
        return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * np.pi * v)

    def bind(self, value: Column, now: bool = False) -> Column:
        name = f"__{self.made}"
        self.made += 1
        self.waiting[name] = value
        if now:
            self.flush()
        return F.col(name)

    def flush(self) -> None:
        if self.waiting:
            self.df = self.df.withColumns(self.waiting)
            self.waiting = {}

    def result(self, **values: Column) -> DataFrame:
        self.flush()
        return self.df.withColumns(values).select(*self.kept, *[k for k in values if k not in self.kept])


class Arrays:
    """Evaluation over one batch."""

    def __init__(self, x: dict[int, np.ndarray], n: int, uniforms=None):
        self.data, self.n, self.uniforms = x, n, uniforms

    def x(self, var: int) -> np.ndarray:
        return self.data[var]

    def const(self, v: float) -> np.ndarray:
        return np.full(self.n, float(v))

    def missing(self, x: np.ndarray) -> np.ndarray:
        return np.isnan(x)

    def where(self, c, a, b):
        return np.where(c, a, b)

    def table(self, x, values, other):
        ok = (x >= 0) & (x < len(values)) & (x == np.floor(x))
        return np.where(ok, np.asarray(values, float)[np.where(ok, x, 0).astype(int)], other)

    def steps(self, x, breaks, values):
        width = (breaks[-1] - breaks[0]) / len(values)
        at = np.floor((np.where(np.isnan(x), breaks[0], x) - breaks[0]) / (width or 1.0))
        return np.asarray(values, float)[np.clip(at, 0, len(values) - 1).astype(int)]

    def add(self, terms):
        return balanced(terms)

    def either(self, terms):
        return balanced(terms, lambda a, b: a | b)

    def both(self, a, b):
        return a & b

    def exp(self, x):
        return np.exp(x)

    def lse(self, terms):
        t = np.stack(terms)
        top = t.max(0)
        return top + np.log(np.exp(t - top).sum(0))

    def greatest(self, terms):
        return np.max(terms, axis=0)

    def floor(self, x):
        return np.maximum(x, FLOOR)

    def argmax(self, terms):
        return np.stack(terms).argmax(0)

    def is_(self, branch, i):
        return branch == i

    def true(self):
        return np.ones(self.n, bool)

    def uniform(self, *where):
        return self.uniforms(*where)

    def below(self, u, cuts):
        return np.sum([u >= c for c in cuts], 0) if cuts else np.zeros(self.n, int)

    def normal(self, u, v):
        return np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * v)

    def bind(self, value, now=False):
        return value

    def flush(self):
        pass
