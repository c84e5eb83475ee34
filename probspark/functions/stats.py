"""Sufficient statistics as Spark aggregations.

Every function makes one pass with partial sums (or two, where a second one needs the first one's extremes) and
returns a small DataFrame in long format, keyed by feature positions. Binary features hold 0/1; a null or NaN cell
counts in no sum. Ordered statistics never sort the table in one task: distinct values are counted first, and
running sums go bucket by bucket (`cumulative`).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Machine epsilon of 32-bit floats, added to every cell of a G-test table.
EPS32 = float(np.finfo(np.float32).eps)


def known(c: str | Column) -> Column:
    """The value, or null where it is NaN: both mark a missing cell."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def ln(c: Column, floor: float = -1e31) -> Column:
    """Natural logarithm with a floor for zero (Spark's own is null there)."""
    return F.when(c > 0, F.ln(c)).otherwise(floor)


def long(row: DataFrame, items: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """One row of columns to rows; items: (keys..., column)."""
    structs = [F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(item, names, strict=True)]) for item in items]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def balanced(terms: Sequence[Column], op=lambda a, b: a + b) -> Column:
    """Fold in a balanced tree: deep chains overflow the stack of the analyser."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [op(terms[i], terms[i + 1]) if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def prior_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """feature, n0, n1."""
    row = df.agg(*[F.sum(F.lit(1) - F.col(c)).cast("long").alias(f"a{i}") for i, c in enumerate(cols)], *[F.sum(c).cast("long").alias(f"b{i}") for i, c in enumerate(cols)])
    return long(row, [(i, F.col(f"a{i}"), F.col(f"b{i}")) for i in range(len(cols))], ("feature", "n0", "n1"))


def _pair_row(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    d = len(cols)
    sums = [F.sum(F.col(cols[i]) * F.col(cols[j])).cast("long").alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    return df.agg(F.count(F.lit(1)).alias("n"), *sums)


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """i, j, ci, cj, both, n of all ordered pairs i != j. Only column references are exploded; whatever is worked out of
    them is columns of these few rows, so no expression repeats for every pair."""
    c = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
    d = range(len(cols))
    return long(_pair_row(df, cols), [(i, j, c(i, i), c(j, j), c(i, j), F.col("n")) for i in d for j in d if i != j], ("i", "j", "ci", "cj", "both", "n"))


#: Rows of each cell (k, l) of a pair.
CELLS = {(0, 0): "n - ci - cj + both", (0, 1): "cj - both", (1, 0): "ci - both", (1, 1): "both"}


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """i, j, k, l, m (rows), n (all rows)."""
    cell = [F.struct(F.lit(k).alias("k"), F.lit(l).alias("l"), F.expr(m).alias("m")) for (k, l), m in CELLS.items()]
    return _pairs(df, cols).select("i", "j", "n", F.explode(F.array(*cell)).alias("c")).select("i", "j", "c.k", "c.l", "c.m", "n")


def joint_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """i, j, k, l, n: rows with feature i = k and feature j = l, for all ordered pairs i != j; one aggregate of d(d+1)/2 sums."""
    return _cells(df, cols).select("i", "j", "k", "l", F.col("m").alias("n"))


def priors(df: DataFrame, cols: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """feature, value, p with Laplace smoothing (c + 2 alpha) / (n + 4 alpha)."""
    row = long(_pair_row(df, cols), [(i, F.col(f"c{i}_{i}"), F.col("n")) for i in range(len(cols))], ("feature", "c", "n"))
    p1 = (F.col("c") + 2 * alpha) / (F.col("n") + 4 * alpha)
    values = F.array(*[F.struct(F.lit(v).alias("value"), p.alias("p")) for v, p in ((0, 1 - p1), (1, p1))])
    return row.select("feature", F.explode(values).alias("v")).select("feature", "v.value", "v.p")


def joints(df: DataFrame, cols: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """i, j, k, l, p: smoothed joint probabilities (c + alpha) / (n + 4 alpha)."""
    return _cells(df, cols).select("i", "j", "k", "l", ((F.col("m") + alpha) / (F.col("n") + 4 * alpha)).alias("p"))


def mutual_information(df: DataFrame, cols: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """i, j, mi in nats for all ordered pairs; smoothed as `priors` and `joints`."""
    one = lambda c: (F.col(c) + 2 * alpha) / (F.col("n") + 4 * alpha)
    p = _pairs(df, cols).select("i", "j", one("ci").alias("pi"), one("cj").alias("pj"), *[((F.expr(m) + alpha) / (F.col("n") + 4 * alpha)).alias(f"p{k}{l}") for (k, l), m in CELLS.items()])
    side = lambda c, v: F.col(c) if v else 1 - F.col(c)
    return p.select("i", "j", balanced([F.col(f"p{k}{l}") * (F.ln(f"p{k}{l}") - F.ln(side("pi", k) * side("pj", l))) for k, l in CELLS]).alias("mi"))


def pair_counts(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """n and the d x d matrix of co-occurrence sums on the driver (features, not rows, bound its size)."""
    r = _pair_row(df, cols).first()
    d = len(cols)
    m = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            m[i, j] = m[j, i] = r[f"c{i}_{j}"] or 0
    return int(r["n"]), m


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """As pair_counts, for many features: partial X'X per partition, summed row by row."""
    import pandas as pd
    from pyspark import TaskContext

    d = len(cols)

    def part(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            x = np.column_stack([b[list(cols)].to_numpy(float), np.ones(len(b))])
            total += x.T @ x
        yield pd.DataFrame({"row": np.arange(d + 1), "branch": TaskContext.get().partitionId() // 128, "sums": list(total)})

    def add(p):
        return pd.DataFrame({"row": p["row"].iloc[:1], "branch": p["branch"].iloc[:1], "sums": [np.stack(p["sums"].to_numpy()).sum(0)]})

    schema = "row int, branch int, sums array<double>"
    own = df.select(*cols)
    made = own.mapInPandas(part, schema)
    if own.rdd.getNumPartitions() > 128:  # partials of 128 tasks meet first
        made = made.groupBy("row", "branch").applyInPandas(add, schema)
    got = made.groupBy("row").applyInPandas(add, schema).toPandas().sort_values("row")
    m = np.stack(got["sums"].to_numpy()) if len(got) else np.zeros((d + 1, d + 1))
    return int(m[d, d]), m[:d, :d]


def priors_joints_np(n: int, m: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """priors (d, 2) and joints (d, d, 2, 2) from pair counts, by the same smoothing."""
    c = np.diag(m)
    p1 = (c + 2 * alpha) / (n + 4 * alpha)
    pri = np.stack([1 - p1, p1], 1)
    ci, cj = c[:, None], c[None, :]
    jo = np.stack([np.stack([n - ci - cj + m, cj - m], -1), np.stack([ci - m, m], -1)], -2)
    jo = (jo + alpha) / (n + 4 * alpha)
    for i in range(len(c)):
        jo[i, i] = np.diag(pri[i])
    return pri, jo


def mutual_information_np(pri: np.ndarray, jo: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = jo * (np.log(jo) - np.log(pri[:, None, :, None] * pri[None, :, None, :]))
    mi = np.nan_to_num(mi).sum((2, 3))
    np.fill_diagonal(mi, 0)
    return mi


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """value, n of the present values."""
    return df.select(known(col).alias("value")).where("value is not null").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def gini(df: DataFrame, col: str) -> DataFrame:
    """gini = 1 - sum p^2 of a discrete column."""
    return value_counts(df, col).agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def entropy(df: DataFrame, col: str) -> DataFrame:
    """Entropy in bits of a discrete column."""
    n = value_counts(df, col)
    return n.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def cumulative(counts: DataFrame, buckets: int = 256) -> DataFrame:
    """value, n to value, n, upto (running sum by value). Ranges between sampled quantiles of the distinct values are
    window groups of their own, however the values lie; only the at most `buckets` totals meet in one task."""
    cuts = counts.agg(F.approx_percentile("value", [k / buckets for k in range(1, buckets)], F.lit(20 * buckets)).alias("q")).first()["q"]
    borders = F.lit(sorted({*(cuts or [])})).cast("array<double>") if cuts else F.array().cast("array<double>")
    rows = counts.withColumn("bucket", F.size(F.filter(borders, lambda b: b <= F.col("value").cast("double"))))
    totals = rows.groupBy("bucket").agg(F.sum("n").alias("t"))
    before = totals.select("bucket", (F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).alias("before"))
    w = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("own", F.sum("n").over(w)).join(F.broadcast(before), "bucket").select("value", "n", (F.col("own") + F.col("before")).alias("upto"))


def quantiles(df: DataFrame, col: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation, from running counts of the distinct values."""
    counts = value_counts(df, col)
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return [math.nan] * len(shares)
    at = [q * (total - 1) for q in shares]
    ranks = [math.floor(x) for x in at] + [math.ceil(x) for x in at]
    row = cumulative(counts).agg(*[F.min(F.when(F.col("upto") > k, F.col("value"))).alias(f"v{i}") for i, k in enumerate(ranks)]).first()
    return [row[i] + (row[i + len(at)] - row[i]) * (x - math.floor(x)) for i, x in enumerate(at)]


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """value, p: share of rows at or below each present value (rank method max)."""
    counts = value_counts(df, col)
    total = counts.agg(F.sum("n")).first()[0]
    return cumulative(counts).select("value", (F.col("upto") / F.lit(total)).alias("p"))


def ranked(df: DataFrame, col: str, out: str, heavy: float = 1 / 256, salts: int = 256) -> DataFrame:
    """df with the share of rows at or below the row's value (null where it is missing).

    Values that hold `heavy` of the rows or more, at most 1 / heavy of them, are looked up in a broadcast map. The others are
    joined with their ranks; there, the rows of heavy values and missing cells go under keys of their own, dealt by the row's
    hash, so no key of the join holds more than `heavy` of the rows."""
    counts = stored(value_counts(df, col), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranks = stored(cumulative(counts).select("value", "n", (F.col("upto") / F.lit(max(1, total))).alias("p")), "ranks")
    common = {r["value"]: r["p"] for r in ranks.where(F.col("n") >= F.lit(heavy * total)).collect()}
    x = known(col)
    common_map = F.create_map(*[F.lit(y) for pair in common.items() for y in pair]).cast("map<double,double>") if common else F.create_map().cast("map<double,double>")
    looked = F.element_at(common_map, x)
    # a struct key keeps null and NaN cells comparable and spreads what needs no join
    alone = F.when(x.isNull() | looked.isNotNull(), F.pmod(F.xxhash64(*df.columns), F.lit(salts)).cast("int") + 1).otherwise(0)
    rest = ranks.where(F.col("n") < F.lit(heavy * total)).select(F.col("value").alias("__value"), F.lit(0).alias("__alone"), F.col("p").alias("__p"))
    made = df.withColumns({"__x": F.when(alone == 0, x).otherwise(0.0), "__own": alone, out: looked})
    made = made.join(rest, (F.col("__x") == F.col("__value")) & (F.col("__own") == F.col("__alone")), "left")
    return made.withColumn(out, F.coalesce(out, "__p")).drop("__x", "__own", "__value", "__alone", "__p")


def mean_quantiles(df: DataFrame, col: str, q: int) -> DataFrame:
    """chunk, mean: rows in order of value cut into q chunks, the first n mod q one longer; mean of each."""
    counts = value_counts(df, col)
    n = counts.agg(F.sum("n")).first()[0] or 0
    if n < q:
        raise ValueError("fewer values than quantiles")
    small, longer = n // q, n % q
    cut = longer * (small + 1)
    # ranks are 1-based; a run of equal values covers (upto - n, upto]
    chunk = lambda r: F.when(r <= cut, F.floor((r - 1) / (small + 1))).otherwise(longer + F.floor((r - 1 - cut) / F.lit(small)))
    first = lambda k: F.when(k < longer, k * (small + 1)).otherwise(k * small + longer)
    runs = cumulative(counts).withColumn("chunk", F.explode(F.sequence(chunk(F.col("upto") - F.col("n") + 1).cast("int"), chunk(F.col("upto")).cast("int"))))
    inside = F.least("upto", first(F.col("chunk") + 1)) - F.greatest(F.col("upto") - F.col("n"), first(F.col("chunk")))
    return runs.groupBy("chunk").agg((F.sum(F.col("value") * inside) / F.sum(inside)).alias("mean"))


def cumulative_by(counts: DataFrame, key: str, buckets: int = 256) -> DataFrame:
    """key, value, n to key, value, n, upto (running sum of each key by value), total of the key. As `cumulative`, with cuts
    for each key; keys are columns of a table, so their cuts and totals are few (keys * buckets) and broadcast. The cuts are
    stored before use: a sketch depends on the order in which its parts meet, and rows and totals must see the same cuts."""
    cuts = counts.groupBy(key).agg(F.approx_percentile("value", [k / buckets for k in range(1, buckets)], F.lit(20 * buckets)).alias("cuts"), F.sum("n").alias("total"))
    cuts = cuts.withColumn("cuts", F.array_distinct("cuts"))
    # a value is held against every 16th cut, then against the cuts between two of those
    groups = F.transform(F.sequence(F.lit(0), F.floor(F.size("cuts") / 16).cast("int")), lambda k: F.slice("cuts", k * 16 + 1, F.lit(16)))
    cuts = stored(cuts.select(key, "total", F.filter("cuts", lambda _, i: i % 16 == 15).alias("heads"), groups.alias("groups")), "cuts")
    upto = lambda c: F.size(F.filter(c, lambda b: b <= F.col("value")))
    rows = counts.join(F.broadcast(cuts), key).withColumn("group", upto("heads"))
    rows = rows.withColumn("bucket", F.col("group") * 16 + upto(F.col("groups")[F.col("group")])).drop("heads", "groups", "group")
    totals = rows.groupBy(key, "bucket").agg(F.sum("n").alias("t"))
    before = totals.select(key, "bucket", (F.sum("t").over(Window.partitionBy(key).orderBy("bucket")) - F.col("t")).alias("before"))
    w = Window.partitionBy(key, "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    made = rows.withColumn("own", F.sum("n").over(w)).join(F.broadcast(before), [key, "bucket"])
    return made.select(key, "value", "n", (F.col("own") + F.col("before")).alias("upto"), "total")


def mean_quantiles_by(long: DataFrame, key: str, col: str, q: int) -> DataFrame:
    """key, chunk, mean: `mean_quantiles` of every key of a long table, all in one plan. Null and NaN values don't count;
    a key with fewer than q values raises ValueError."""
    counts = long.select(key, known(col).alias("value")).where("value IS NOT NULL").groupBy(key, "value").agg(F.count(F.lit(1)).alias("n"))
    runs = cumulative_by(counts, key)
    small, longer = F.floor(F.col("total") / q), F.col("total") % q
    first = lambda k: k * small + F.least(k, longer)
    cut = longer * (small + 1)
    chunk = lambda r: F.when(r <= cut, F.floor((r - 1) / (small + 1))).otherwise(longer + F.floor((r - 1 - cut) / small))
    enough = F.when(F.col("total") < q, F.raise_error(F.lit("fewer values than quantiles")).cast("long")).otherwise(F.col("upto"))
    runs = runs.withColumn("upto", enough)
    runs = runs.withColumn("chunk", F.explode(F.sequence(chunk(F.col("upto") - F.col("n") + 1).cast("int"), chunk(F.col("upto")).cast("int"))))
    inside = F.least("upto", first(F.col("chunk") + 1)) - F.greatest(F.col("upto") - F.col("n"), first(F.col("chunk")))
    return runs.groupBy(key, "chunk").agg((F.sum(F.col("value") * inside) / F.sum(inside)).alias("mean"))


def _edges(df: DataFrame, col: str, rule: str) -> tuple[float, float, int, int]:
    """lo, hi, bins, n by Freedman-Diaconis (`fd`) or Scott."""
    x = known(col)
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.stddev_pop(x).alias("s")).first()
    if not r["n"]:
        return 0.0, 0.0, 1, 0
    lo, hi, n = r["lo"], r["hi"], r["n"]
    if rule == "fd":
        q1, q3 = quantiles(df, col, (0.25, 0.75))
    width = 2 * (q3 - q1) * n ** (-1 / 3) if rule == "fd" else (24 * math.pi**0.5 / n) ** (1 / 3) * r["s"]
    bins = max(1, math.ceil((hi - lo) / width)) if width > 0 and hi > lo else 1
    return lo, hi, bins, n


def histogram(df: DataFrame, col: str, rule: str = "fd") -> DataFrame:
    """bin (from 0), lo, hi, n; equal widths by rule, the last bin closed, empty bins included."""
    lo, hi, bins, _ = _edges(df, col, rule)
    width = (hi - lo) / bins
    x = known(col)
    at = F.when(F.lit(hi) > F.lit(lo), F.least(F.floor((x - lo) / F.lit(width or 1.0)), F.lit(bins - 1))).otherwise(0).cast("int")
    got = df.where(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", (F.lit(lo) + F.col("bin") * width).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram_entropy(df: DataFrame, col: str) -> DataFrame:
    """Entropy in bits over Scott bins, divided by log2 of their number (0 for one bin)."""
    h = histogram(df, col, "scott").select("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))).alias("bins")).where("n > 0")
    e = F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")
    return h.agg(F.when(F.max("bins") > 1, e / F.log2(F.max("bins"))).otherwise(0.0).alias("entropy"))


def domains(df: DataFrame, cols: Sequence[str], discrete: Sequence[bool], most: int = 65_536) -> list:
    """Sorted values of discrete columns, (min, max) of continuous ones. A discrete column of over `most` values, which no
    table of probabilities would hold, raises ValueError; distinct values are found by rows that meet, not in one task."""
    ends = [e for i, c in enumerate(cols) for e in (F.min(known(c)).alias(f"a{i}"), F.max(known(c)).alias(f"b{i}")) if not discrete[i]]
    r = df.agg(*ends).first() if ends else {}
    cells = [F.struct(F.lit(i).alias("i"), known(c).alias("v")) for i, c in enumerate(cols) if discrete[i]]
    found: dict[int, list] = {i: [] for i in range(len(cols))}
    if cells:
        values = df.select(F.explode(F.array(*cells)).alias("k")).select("k.i", "k.v").where("v IS NOT NULL").distinct()
        for k in values.limit(most * len(cells) + 1).collect():
            found[k["i"]].append(k["v"])
    if any(len(v) > most for v in found.values()):
        raise ValueError(f"a discrete column has over {most} values")
    return [sorted(found[i]) if d else (r[f"a{i}"], r[f"b{i}"]) for i, d in enumerate(discrete)]


def gtest_pairs(df: DataFrame, cols: Sequence[str], sizes: Sequence[int], p: float = 5.0) -> DataFrame:
    """i < j, g, dof, independent (g < 2 dof p) of all pairs of columns coded 0 .. size - 1, from one long count."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "i int, j int, g double, dof int, independent boolean")
    # pairs are made of distinct rows only
    rows = df.groupBy(*[F.col(c).cast("int").alias(f"c{i}") for i, c in enumerate(cols)]).agg(F.count(F.lit(1)).alias("rows"))
    cell = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}").alias("a"), F.col(f"c{j}").alias("b"))
    counts = rows.select("rows", F.explode(F.array(*[cell(i, j) for i, j in pairs])).alias("c")).groupBy("c.i", "c.j", "c.a", "c.b").agg(F.sum("rows").alias("n"))
    grid = df.sparkSession.createDataFrame([(i, j, a, b) for i, j in pairs for a in range(sizes[i]) for b in range(sizes[j])], "i int, j int, a int, b int")
    full = F.broadcast(grid).join(counts, ["i", "j", "a", "b"], "left").withColumn("h", F.coalesce("n", F.lit(0)) + F.lit(EPS32))
    w = lambda *k: Window.partitionBy("i", "j", *k)
    expected = F.sum("h").over(w("a")) * F.sum("h").over(w("b")) / F.sum("h").over(w())
    g = full.withColumn("e", expected).groupBy("i", "j").agg((2 * F.sum(F.col("h") * F.ln(F.col("h") / F.col("e")))).alias("g"))
    dof = balanced([F.when((F.col("i") == i) & (F.col("j") == j), F.lit((sizes[i] - 1) * (sizes[j] - 1))) for i, j in pairs], lambda a, b: F.coalesce(a, b))
    return g.select("i", "j", "g", dof.alias("dof"), (F.col("g") < 2 * dof * p).alias("independent"))


def bdeu_roots(n: int, m: np.ndarray, ess: float) -> np.ndarray:
    """BDeu score of every binary variable without parents."""
    lg = math.lgamma
    return np.array([lg(ess) - lg(n + ess) + sum(lg(c + ess / 2) - lg(ess / 2) for c in (n - m[i, i], m[i, i])) for i in range(len(m))])


def bdeu_pairs(n: int, m: np.ndarray, ess: float) -> np.ndarray:
    """score[i, j] of variable i with parent j."""
    lg, d = math.lgamma, len(m)
    out = np.zeros((d, d))
    for i in range(d):
        for j in range(d):
            if i == j:
                continue
            for parent in (0, 1):
                total = m[j, j] if parent else n - m[j, j]
                one = m[i, j] if parent else m[i, i] - m[i, j]
                out[i, j] += lg(ess / 2) - lg(total + ess / 2) + sum(lg(c + ess / 4) - lg(ess / 4) for c in (total - one, one))
    return out


def entropy_gains(n: int, m: np.ndarray, a1: float, a2: float, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Mean entropy (nats) of the variables, and its drop after cutting on each. Smoothing (c + a1) / (n + 2 a1) for
    the mean and (c + a1) / (count + a2) inside the branches."""
    d = len(m)
    c = np.diag(m)
    h = lambda p: -(p * np.log(p) + (1 - p) * np.log(1 - p))
    mean = float(h((c + a1) / (n + a2)).mean())
    gains = np.zeros(d)
    for i in range(d):
        r = c[i] / n
        rest = [j for j in range(d) if j != i]
        on = h((m[i, rest] + a1) / (c[i] + a2)).mean() if rest else 0.0
        off = h((c[rest] - m[i, rest] + a1) / (n - c[i] + a2)).mean() if rest else 0.0
        gains[i] = mean - (r * on + (1 - r) * off)
    return mean, gains


def frechet(mean1: np.ndarray, cov1: np.ndarray, mean2: np.ndarray, cov2: np.ndarray) -> float:
    """|m1 - m2|^2 + tr(C1 + C2 - 2 (C1 C2)^1/2), by the symmetric root."""
    w, v = np.linalg.eigh((cov1 + cov1.T) / 2)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    inner = np.linalg.eigvalsh(root @ ((cov2 + cov2.T) / 2) @ root)
    return float(((mean1 - mean2) ** 2).sum() + np.trace(cov1) + np.trace(cov2) - 2 * np.sqrt(np.maximum(inner, 0)).sum())


def moments_of(df: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector, sample covariance and count of an array column, by per-partition sums."""
    import pandas as pd

    def part(batches):
        n, s, ss = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b[col].to_numpy()).astype(float)
                n, s, ss = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if ss is None else ss)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "ss": [ss.ravel()]})

    got = df.where(F.col(col).isNotNull()).select(col).mapInPandas(part, "n long, s array<double>, ss array<double>")
    # element-wise sums of fixed-size arrays, on the executors
    pos = got.select(F.posexplode(F.concat(F.array(F.col("n").cast("double")), "s", "ss"))).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").toPandas()["v"].to_numpy()
    n = int(pos[0])
    d = int(round((-1 + math.sqrt(1 + 4 * (len(pos) - 1))) / 2))
    mean, ss = pos[1 : d + 1] / n, pos[d + 1 :].reshape(d, d)
    return mean, (ss - n * np.outer(mean, mean)) / max(1, n - 1), n


def bits_per_dimension(ll: Column, size: int) -> Column:
    return -ll / F.lit(math.log(2) * size)


def score_summary(df: DataFrame, ll: str) -> DataFrame:
    """n, mean_ll, two standard errors."""
    return df.agg(F.count(ll).alias("n"), F.avg(ll).alias("mean_ll"), (2 * F.stddev_pop(ll) / F.sqrt(F.count(ll))).alias("two_se"))


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support (rows) for each class as text, then accuracy (precision and recall over all
    rows), macro and weighted averages. A ratio without rows is 0; rows without either class are left out."""
    cells = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    part = lambda c, s, g, h: F.struct(F.col(c).alias("label"), s.alias("support"), g.alias("given"), h.alias("hit"))
    n, zero = F.col("n"), F.lit(0).cast("long")
    roles = F.array(part("a", n, zero, F.when(F.col("a") == F.col("p"), n).otherwise(zero)), part("p", zero, n, zero))
    per = cells.select(F.explode(roles).alias("r")).select("r.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "given", "hit")])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    per = per.withColumn("precision", ratio(F.col("hit"), F.col("given"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    per = per.withColumn("f1", f1).withColumn("label", F.col("label").cast("string"))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    rows = {"accuracy": [F.sum("hit") / total] * 3, "macro": [F.avg(c) for c in names], "weighted": [F.sum(F.col(c) * F.col("support")) / total for c in names]}
    sums = per.agg(total.alias("support"), *[x.alias(f"{k}_{c}") for k, xs in rows.items() for c, x in zip(names, xs, strict=True)])
    sums = sums.where("support > 0")
    whole = long(sums, [(k, *[F.col(f"{k}_{c}") for c in names], F.col("support")) for k in rows], ("label", *names, "support"))
    return per.select("label", *names, "support").unionByName(whole)
