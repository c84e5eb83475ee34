"""How five well-known continuous data sets are prepared: columns left out, noise, splits, standardisation.

Noise and splits are functions of a row's key and a seed, so they are the same under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..functions.stats import known
from ..functions.transforms import Standardizer
from .arrays import read_hdf5

Parts = dict[str, DataFrame]


def parts(df: DataFrame, keys: Sequence[str], seed: int = 42) -> Parts:
    """A tenth for tests, a tenth of the rest for validation, the others for training, by the keys' uniform."""
    u = uniform(seed, *keys)
    return {"train": df.where(u < 0.81), "valid": df.where((u >= 0.81) & (u < 0.9)), "test": df.where(u >= 0.9)}


def part_of(keys: Sequence[str], seed: int = 42):
    """The part's name as a column."""
    u = uniform(seed, *keys)
    return F.when(u < 0.81, "train").when(u < 0.9, "valid").otherwise("test")


#: Width of the noise of the six columns that are left.
POWER_NOISE = (0.001, 0.01, 1.0, 1.0, 1.0, 0.0)


def power(df: DataFrame, cols: Sequence[str], keys: Sequence[str], seed: int = 42) -> DataFrame:
    """keys and six of eight columns: the second and the fourth go, the others get uniform noise of their own width."""
    if len(cols) != 8:
        raise ValueError("eight columns are needed")
    left = [c for i, c in enumerate(cols) if i not in (1, 3)]
    noisy = [(F.col(c) + F.lit(w) * uniform(f"{seed}-noise{j}", *keys)).alias(c) if w else F.col(c).cast("double").alias(c) for j, (c, w) in enumerate(zip(left, POWER_NOISE, strict=True))]
    return df.select(*[k for k in keys if k not in left], *noisy)


def drop_correlated_in_turn(df: DataFrame, cols: Sequence[str], most: float = 0.98) -> list[str]:
    """Columns left when, again and again, the first one that correlates above `most` with another goes. As a partner before
    it is gone by then, a column goes if and only if it has one after it."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    r = df.agg(*[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first() if pairs else {}
    gone = {i for i, j in pairs if (r[f"r{i}_{j}"] or 0.0) > most}
    return [c for i, c in enumerate(cols) if i not in gone]


def gas(df: DataFrame, cols: Sequence[str], keys: Sequence[str], left_out: Sequence[str] = ("Meth", "Eth", "Time")) -> DataFrame:
    """keys and the columns that tell something: some named ones go, then correlated ones in turn."""
    return df.select(*keys, *drop_correlated_in_turn(df, [c for c in cols if c not in left_out]))


def drop_recurring(df: DataFrame, cols: Sequence[str], most: int = 5) -> list[str]:
    """Columns whose smallest value occurs at most `most` times: two aggregates over the table, for all columns at once."""
    low = df.agg(*[F.min(known(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    if low is None or not cols:
        return list(cols)
    n = df.agg(*[F.count(F.when(known(c) == low[f"m{i}"], 1)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if n[f"n{i}"] <= most]


def hepmass(train: DataFrame, test: DataFrame, label: str, cols: Sequence[str], keys: Sequence[str], seed: int = 42, most: int = 5) -> Parts:
    """Rows of class 1 without the label; columns that recur in the training rows go from all parts; a tenth of the training
    rows validates. `test` may have further columns."""
    signal = lambda df: df.where(F.col(label) == 1)
    left = drop_recurring(signal(train), cols, most)
    u = uniform(seed, *keys)
    own, far = signal(train).select(*keys, *left), signal(test).select(*keys, *left)
    return {"train": own.where(u < 0.9), "valid": own.where(u >= 0.9), "test": far}


def bsds300(spark: SparkSession, path: str) -> Parts:
    """Its HDF5 file has the parts as data sets."""
    return {part: read_hdf5(spark, path, name) for part, name in (("train", "train"), ("valid", "validation"), ("test", "test"))}


def standardised(found: Parts, cols: Sequence[str]) -> Parts:
    """All parts by the mean and the standard deviation of the training rows."""
    scaler = Standardizer(cols).fit(found["train"])
    return {name: scaler.forward(df) for name, df in found.items()}


def target_of(df: DataFrame, label: str, keep: bool) -> DataFrame:
    """A supervised table without its target, or as it is."""
    return df if keep else df.drop(label)


#: Sizes of number kinds in bytes.
SIZES = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8}


def as_kind(df: DataFrame, cols: Sequence[str], kind: str = "float") -> DataFrame:
    """Columns cast where they don't fit the kind: a floating kind takes whole numbers and smaller floating ones to itself,
    a whole kind takes floating and smaller whole ones; larger ones of the same family stay."""
    from ..plans.validate import checks_kinds

    if not checks_kinds():
        return df
    floating = kind in ("float", "double")
    have = dict(df.dtypes)
    fits = lambda c: (have[c] in ("float", "double")) == floating and SIZES.get(have[c], 0) >= SIZES[kind]
    return df.withColumns({c: F.col(c).cast(kind) for c in cols if not fits(c)})
