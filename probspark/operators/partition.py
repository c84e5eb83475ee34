"""Partitions of a binary table: rows by conjunctions, variables by scope. Only the description is kept, the rows stay
in their table; its predicate is one filter that reaches the scan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import balanced

#: (variable, value) pairs that hold together.
Conjunction = tuple[tuple[int, int], ...]


@dataclass(frozen=True)
class Partition:
    """Rows for which all conjunctions `inside` hold and none of `outside`, and the variables of `scope`. Rows with a
    null in a variable of any of them belong to no partition."""

    scope: tuple[int, ...]
    inside: tuple[Conjunction, ...] = ()
    outside: tuple[Conjunction, ...] = ()

    def where(self, cols: Sequence[str]) -> Column:
        holds = lambda conj: balanced([F.col(cols[v]) == x for v, x in conj], lambda a, b: a & b)
        every = [*map(holds, self.inside), *(~holds(c) for c in self.outside)]
        return balanced(every, lambda a, b: a & b) if every else F.lit(True)

    def slice(self, df: DataFrame, cols: Sequence[str]) -> DataFrame:
        return df.where(self.where(cols)).select(*[cols[v] for v in self.scope])

    def assignments(self, df: DataFrame, cols: Sequence[str], vs: Sequence[int], min_rows: int = 1) -> DataFrame:
        """Assignments of vs that at least min_rows rows hold, with n."""
        own = self.slice(df, cols).groupBy(*[cols[v] for v in vs]).agg(F.count(F.lit(1)).alias("n"))
        return own.where(F.col("n") >= min_rows)

    def split_rows(self, vs: Sequence[int], kept: Sequence[Sequence[int]]) -> list[Partition]:
        """The rows with none of the kept assignments of vs, then those of each."""
        conj = [tuple(zip(vs, a, strict=True)) for a in kept]
        rest = Partition(self.scope, self.inside, (*self.outside, *conj))
        return [rest, *[Partition(self.scope, (*self.inside, c), self.outside) for c in conj]]

    def split_cols(self, vs: Sequence[int]) -> tuple[Partition, Partition]:
        """The variables vs, and the others."""
        parts = [tuple(v for v in self.scope if (v in vs) == inner) for inner in (True, False)]
        return Partition(parts[0], self.inside, self.outside), Partition(parts[1], self.inside, self.outside)
