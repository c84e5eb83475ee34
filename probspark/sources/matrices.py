"""Data matrices: readers, missing values, preparation recipes, and the test fixtures over the driver's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..functions.stats import balanced, known


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",", kind: str = "double") -> DataFrame:
    """Delimited numbers without a header as typed columns."""
    return spark.read.csv(path, sep=sep, schema=", ".join(f"`{c}` {kind}" for c in columns))


def read_binary(spark: SparkSession, folder: str, name: str, columns: Sequence[str], sep: str = ",") -> dict[str, DataFrame]:
    """The train, valid and test parts `<name>.<part>.data` of a binary data set."""
    return {part: read_csv(spark, f"{folder}/{name}.{part}.data", columns, sep, "int") for part in ("train", "valid", "test")}


def as_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NaN to null, once, at ingress."""
    return df.withColumns({c: known(c) for c in cols})


def features(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """float features, and a bigint label if there is one."""
    out = [F.col(c).cast("float").alias(c) for c in cols]
    return df.select(*out, *([F.col(label).cast("long").alias(label)] if label else []))


def classes(df: DataFrame, label: str) -> list[int]:
    """Sorted labels; their number is small by nature."""
    return sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())


def dictionary(df: DataFrame, col: str) -> dict:
    """value -> 0 .. k - 1 in order of the values, for text columns of few values."""
    values = [r[0] for r in df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col).collect()]
    return {v: i for i, v in enumerate(values)}


def encode(col: str, codes: dict):
    """A text column by its codes; unknown values are missing."""
    return balanced([F.when(F.col(col) == v, F.lit(i)) for v, i in codes.items()], lambda a, b: F.coalesce(a, b))


def hash_split(df: DataFrame, key: str, shares: Sequence[float] = (0.8, 0.1, 0.1), seed: int = 42) -> list[DataFrame]:
    """Disjoint parts by the key's uniform: stable under any partitioning."""
    u, out, low = uniform(seed, key), [], 0.0
    for i, s in enumerate(shares):
        high = 1.0 if i == len(shares) - 1 else low + s
        out.append(df.where((u >= low) & (u < high)))
        low = high
    return out


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """About the share of every label's rows, and the rest."""
    u = uniform(seed, label, key)
    return df.where(u < share), df.where(u >= share)


def drop_correlated(df: DataFrame, cols: Sequence[str], most: float = 0.98) -> list[str]:
    """Columns left after dropping, again and again, the column with the most partners of correlation above `most`."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    r = df.agg(*[F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in pairs]).first() if pairs else {}
    near = {(i, j) for i, j in pairs if abs(r[f"r{i}_{j}"] or 0.0) > most}
    left = set(range(len(cols)))
    while near:
        worst = max(sorted(left), key=lambda k: (sum(k in p for p in near), -k))
        left.discard(worst)
        near = {p for p in near if worst not in p}
    return [cols[i] for i in sorted(left)]


def drop_repetitive(df: DataFrame, cols: Sequence[str], most: int) -> list[str]:
    """Columns whose commonest value occurs at most `most` times: one count of the cells of all columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), known(c).alias("v")) for i, c in enumerate(cols)])
    counts = df.select(F.explode(cells).alias("k")).groupBy("k.i", "k.v").agg(F.count(F.lit(1)).alias("n"))
    top = {r["i"]: r["n"] for r in counts.groupBy("i").agg(F.max("n").alias("n")).collect()}
    return [c for i, c in enumerate(cols) if top.get(i, 0) <= most]


# --- fixtures ------------------------------------------------------------------------------------------------------

B6 = [f"x{i}" for i in range(6)]
B6_SQL = "SELECT CAST(l_quantity > 25 AS INT) AS x0, CAST(l_discount > 0.05 AS INT) AS x1, CAST(l_tax > 0.04 AS INT) AS x2, CAST(l_extendedprice > 53000 AS INT) AS x3, CAST(l_returnflag = 'R' AS INT) AS x4, CAST(l_linestatus = 'F' AS INT) AS x5 FROM lineitem"
E4 = [f"x{i}" for i in range(4)]
E4_SQL = "SELECT event_id, CAST(value > 10 AS INT) AS x0, CAST(event_type IN ('click', 'view') AS INT) AS x1, CAST(user_id % 2 AS INT) AS x2, CAST(event_id % 3 = 0 AS INT) AS x3 FROM events"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six binary features of lineitem."""
    c = F.col
    exprs = [c("l_quantity") > 25, c("l_discount") > 0.05, c("l_tax") > 0.04, c("l_extendedprice") > 53000, c("l_returnflag") == "R", c("l_linestatus") == "F"]
    return load(spark, sf_dir, "lineitem").select(*[e.cast("int").alias(n) for e, n in zip(exprs, B6, strict=True)])


def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four binary features of events, by event_id."""
    c = F.col
    exprs = [c("value") > 10, c("event_type").isin("click", "view"), c("user_id") % 2, c("event_id") % 3 == 0]
    return load(spark, sf_dir, "events").select("event_id", *[e.cast("int").alias(n) for e, n in zip(exprs, E4, strict=True)])


def every_assignment(spark: SparkSession, d: int, names: Sequence[str] | None = None) -> DataFrame:
    """All 2^d rows of d binary features, made from bits of a range."""
    names = names or [f"x{i}" for i in range(d)]
    return spark.range(2**d).select(*[F.shiftright("id", i).bitwiseAND(1).cast("int").alias(n) for i, n in enumerate(names)])


def row_numbers(df: DataFrame, partition: str, order: Sequence[str]) -> DataFrame:
    """Numbers within each value of partition."""
    return df.withColumn("row", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
