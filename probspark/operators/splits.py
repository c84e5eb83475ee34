"""Row and column splits for structure learning.

A row split adds an integer column to a slice; a column split labels its variables 0/1 (or more). Statistics come
from Spark aggregates; only numbers per variable or pair of variables reach the driver.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rng import uniform
from ..functions.transforms import mixed_one_hot
from ..sources.tables import stored

OUT = "__cluster"


def _features(df: DataFrame, cols, domains, scope) -> tuple[DataFrame, list[str]]:
    """One-hot where a domain has more than two values, as numbered double columns."""
    own = [cols[v] for v in scope]
    made = mixed_one_hot(own, [domains[v] for v in scope])
    names = [f"__f{i}" for i in range(len(made))]
    return df.withColumns({n: F.coalesce(stats.known(c), F.lit(0.0)) for n, c in zip(names, made, strict=True)}), names


def _ml(df: DataFrame, names: list[str], estimator) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    data = VectorAssembler(inputCols=names, outputCol="__v").transform(df)
    return data, estimator.setFeaturesCol("__v").setPredictionCol(OUT)


def _best(data: DataFrame, models, loss) -> DataFrame:
    """data with the labels of the model of least loss; the vectors are made and kept once for all starts."""
    kept = data.persist()
    try:
        best = min((model.fit(fit_on) for model, fit_on in models(kept)), key=loss)
    finally:
        kept.unpersist()
    return best.transform(data)


def _plus_plus(x: np.ndarray, w: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n centres drawn one after the other, by weight and squared distance to those there are."""
    at = [int(rng.choice(len(x), p=w / w.sum()))]
    far = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < n:
        p = w * far
        at.append(int(rng.choice(len(x), p=p / p.sum() if p.sum() > 0 else w / w.sum())))
        far = np.minimum(far, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def _lloyd_sums(rows: DataFrame, names: list[str], centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each start's centres (starts, n, d): rows taken, their sums, and the start's total squared distance. One pass for
    all starts; every task gives one partial for each number, and the sums run where rows meet by number."""
    starts, n, d = centres.shape

    def part(batches):
        total = np.zeros((starts, n, d + 2))
        for b in batches:
            x, w = b[names].to_numpy(float), b["__n"].to_numpy(float)
            for s in range(starts):
                far = (x * x).sum(1)[:, None] - 2 * x @ centres[s].T + (centres[s] ** 2).sum(1)[None]
                near = far.argmin(1)
                weighted = np.column_stack([x * w[:, None], w, w * np.maximum(far[np.arange(len(x)), near], 0)])
                for k in range(n):
                    total[s, k] += weighted[near == k].sum(0)
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    got = rows.mapInPandas(part, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")
    total = (got["v"].to_numpy() if len(got) else np.zeros(starts * n * (d + 2))).reshape(starts, n, d + 2)
    return total[:, :, d], total[:, :, :d], total[:, :, d + 1].sum(1)


def _centres(drawn: DataFrame, names: list[str], seed: int, n: int, starts: int, rounds: int = 20, first: int = 10_000) -> np.ndarray | None:
    """The best start's centres (n, d); None without rows."""
    rows = drawn.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")).persist()
    try:
        seen = rows.orderBy(F.xxhash64(*names), *names).limit(first).toPandas()
        if not len(seen):
            return None
        x, w = seen[names].to_numpy(float), seen["__n"].to_numpy(float)
        spread = np.average((x - np.average(x, 0, w)) ** 2, 0, w).mean()
        centres = np.stack([_plus_plus(x, w, min(n, len(x)), np.random.default_rng(seed + s)) for s in range(starts)])
        for _ in range(rounds):
            taken, sums, _ = _lloyd_sums(rows, names, centres)
            moved = np.where(taken[:, :, None] > 0, sums / np.maximum(taken, 1)[:, :, None], centres)
            far = ((moved - centres) ** 2).sum((1, 2)).max()
            centres = moved
            if far <= 1e-4 * spread:
                break
        return centres[_lloyd_sums(rows, names, centres)[2].argmin()]
    finally:
        rows.unpersist()


def kmeans(df, cols, kinds, domains, scope, key, seed=42, n=2, starts=5, sample: int | None = None, rounds: int = 20, first: int = 10_000) -> DataFrame:
    """k-means; the best of several starts, which all move in the same passes over the distinct feature rows with their counts.

    The starts' centres come from `first` distinct rows, drawn by hash and by their counts; all rows move them, up to
    `rounds` times or until no start's centres move by more than a hundredth of the mean deviation. A centre without rows stays. sample: rows (about) to move them by, all rows are assigned."""
    made, names = _features(df, cols, domains, scope)
    drawn = made
    if sample is not None:
        drawn = made.where(uniform(seed, key) < min(1.0, sample / max(1, made.count())))
    best = _centres(drawn, names, seed, n, starts, rounds, first)
    return df.withColumn(OUT, F.lit(0)) if best is None else made.withColumn(OUT, _nearest(names, best)).drop(*names)


def _nearest(names: list[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre, the first of equally near ones."""
    far = [stats.balanced([(F.col(c) - float(v)) ** 2 for c, v in zip(names, x, strict=True)]) for x in centres]
    if len(far) == 1:
        return F.lit(0)
    low = F.least(*far)
    return F.coalesce(*[F.when(f == low, i) for i, f in enumerate(far)])


def kmeans_minibatch(df, cols, kinds, domains, scope, key, seed=42, n=2, batch=100_000, steps=10) -> DataFrame:
    """k-means by mini-batches: each step draws about `batch` rows of the whole table by their key's hash, and a centre
    moves towards the mean of the rows it takes, by their share of all rows it has taken so far."""
    from pyspark.ml.clustering import KMeans

    made, names = _features(df, cols, domains, scope)
    kept = made.select(key, *names).persist()
    try:
        share = min(1.0, batch / max(1, kept.count()))
        draw = lambda s: kept.where(uniform(f"{seed}|{s}", key) < share)
        data, est = _ml(draw(0), names, KMeans(k=n, seed=seed, initSteps=2, maxIter=1))
        centres = np.array(est.fit(data).clusterCenters())
        taken = np.zeros(len(centres))
        for s in range(1, steps + 1):
            sums = draw(s).groupBy(_nearest(names, centres).alias(OUT)).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in names])
            for r in sums.collect():  # one row for each centre
                k = r[OUT]
                taken[k] += r["n"]
                centres[k] += (np.array([r[c] for c in names]) - r["n"] * centres[k]) / taken[k]
    finally:
        kept.unpersist()
    return made.withColumn(OUT, _nearest(names, centres)).drop(*names)


def gmm(df, cols, kinds, domains, scope, key, seed=42, n=2, starts=3) -> DataFrame:
    """Gaussian mixture; the best of several seeds."""
    from pyspark.ml.clustering import GaussianMixture

    made, names = _features(df, cols, domains, scope)
    data, _ = _ml(made, names, GaussianMixture())
    models = lambda kept: ((GaussianMixture(k=n, seed=seed + s, maxIter=15, featuresCol="__v", predictionCol=OUT), kept) for s in range(starts))
    return _best(data, models, lambda m: -m.summary.logLikelihood).drop("__v", "probability", *names)


def dbscan(df, cols, kinds, domains, scope, key, seed=42, least=5) -> DataFrame:
    """Density clusters of whole-number rows at a distance under one: equal rows met at least `least` times; the rest is -1."""
    if any(kinds[v].kind != "discrete" for v in scope):
        raise ValueError("density clusters need discrete variables")
    own = [cols[v] for v in scope]
    groups = df.groupBy(*own).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    labels = _numbered(groups, [F.desc("__n"), *own]).drop("__n")
    return df.join(labels, own, "left").withColumn(OUT, F.coalesce(OUT, F.lit(-1)))


def _numbered(df: DataFrame, order: list) -> DataFrame:
    """df with its row number from 0 in that order as a label: sorted ranges keep their own numbers, and one count for
    each range, not the rows, gives the offsets."""
    ranges = stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in ranges.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0] + [n for _, n in sizes])
    offsets = df.sparkSession.createDataFrame([(p, int(o)) for (p, _), o in zip(sizes, before[:-1], strict=True)], "__part long, __before long")
    numbered = ranges.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(OUT, (F.col("__before") + place).cast("int")).drop("__at", "__part", "__before")


def _merged(means: list[np.ndarray], weight: list[float], n: int) -> np.ndarray:
    """Cluster of each cell after merging, each time, the two clusters whose union adds least variance."""
    means, weight = list(means), list(weight)
    members = [[i] for i in range(len(means))]
    while len(means) > n:
        m, q = np.array(means), np.array(weight)
        d = ((m[:, None] - m[None]) ** 2).sum(2) * (q[:, None] * q[None]) / (q[:, None] + q[None])
        np.fill_diagonal(d, np.inf)
        i, j = sorted(np.unravel_index(d.argmin(), d.shape))
        means[i] = (m[i] * q[i] + m[j] * q[j]) / (q[i] + q[j])
        weight[i] += weight[j]
        members[i] += members[j]
        del means[j], weight[j], members[j]
    out = np.zeros(sum(map(len, members)), int)
    for k, own in enumerate(members):
        out[own] = k
    return out


def ward(df, cols, kinds, domains, scope, key, seed=42, n=2, most=800) -> DataFrame:
    """Agglomerative clusters of least variance over distinct rows with their counts. Up to `most` distinct rows are
    the cells that are merged; more of them are first gathered, all and with their counts, into `most` cells by
    k-means, whose weighted means are then merged. Only cells reach the driver."""
    from pyspark.ml.clustering import KMeans

    if any(kinds[v].kind != "discrete" for v in scope):
        raise ValueError("agglomeration needs discrete variables")
    made, names = _features(df, cols, domains, scope)
    distinct = made.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("__w")).persist()
    try:
        many = distinct.count() > most
        if many:
            data, est = _ml(distinct, names, KMeans(k=most, seed=seed, initSteps=2, maxIter=10, weightCol="__w"))
            model = est.setPredictionCol("__cell").fit(data)
            means = [(F.sum(F.col(c) * F.col("__w")) / F.sum("__w")).alias(c) for c in names]
            cells = model.transform(data).groupBy("__cell").agg(*means, F.sum("__w").alias("__w")).orderBy("__cell").toPandas()
        else:
            cells = distinct.orderBy(F.desc("__w"), *names).toPandas()
    finally:
        distinct.unpersist()
    labels = _merged([*cells[names].to_numpy(float)], [*cells["__w"].to_numpy(float)], n)
    by = ["__cell"] if many else names
    schema = ", ".join([f"{c} {'int' if many else 'double'}" for c in by] + [f"{OUT} int"])
    map_ = df.sparkSession.createDataFrame(cells[by].assign(**{OUT: labels.astype("int32")}), schema)
    if many:
        made = model.transform(_ml(made, names, est)[0]).drop("__v")
    return made.join(F.broadcast(map_), by).drop(*names, "__cell")


def random_rows(df, cols, kinds, domains, scope, key, seed=42) -> DataFrame:
    """Two parts by a Beta(2, 2) share and the rows' uniforms."""
    p = np.random.default_rng(seed).beta(2, 2)
    return df.withColumn(OUT, (uniform(seed, key) < float(p)).cast("int"))


def rdc_rows(df, cols, kinds, domains, scope, key, seed=42, n=2, starts=5) -> DataFrame:
    """k-means over random sine features of the ranks."""
    own = [cols[v] for v in scope]
    made, names = rdc_features(df, own, rdc_weights(len(own), seed))
    best = _centres(made, names, seed, n, starts)
    made = made.withColumn(OUT, F.lit(0) if best is None else _nearest(names, best))
    return made.select(*df.columns, OUT)


SPLIT_ROWS = {"kmeans": kmeans, "kmeans_mb": kmeans_minibatch, "gmm": gmm, "dbscan": dbscan, "wald": ward, "rdc": rdc_rows, "random": random_rows}


def slice_weights(df: DataFrame, label: str = OUT) -> DataFrame:
    """label, n, weight of the parts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.col("n") / F.lit(df.count()))


# --- columns -------------------------------------------------------------------------------------------------------


def coded(df: DataFrame, cols, kinds, domains, scope) -> tuple[DataFrame, list[str], list[int]]:
    """Discrete variables by position in their domain, continuous ones by Freedman-Diaconis bins."""
    exprs, names, sizes = {}, [], []
    for v in scope:
        name = f"__b{v}"
        x = stats.known(cols[v])
        if kinds[v].kind == "discrete":
            exprs[name] = F.coalesce(*[F.when(x == float(d), i) for i, d in enumerate(domains[v])])
            sizes.append(len(domains[v]))
        else:
            lo, hi, bins, _ = stats._edges(df, cols[v], "fd")
            exprs[name] = F.least(F.floor((x - lo) / ((hi - lo) / bins or 1.0)), F.lit(bins - 1)).cast("int")
            sizes.append(bins)
        names.append(name)
    return df.withColumns(exprs).dropna(subset=names), names, sizes


def _g_matrices(df, cols, kinds, domains, scope, p) -> tuple[np.ndarray, np.ndarray]:
    """dependent (bool) and G minus its bound, for all pairs."""
    if len({kinds[v].kind for v in scope}) > 1:
        raise ValueError("G-tests need variables of one kind")
    made, names, sizes = coded(df, cols, kinds, domains, scope)
    d = len(scope)
    dep, g = np.zeros((d, d), bool), np.zeros((d, d))
    for r in stats.gtest_pairs(made, names, sizes, p).collect():
        dep[r["i"], r["j"]] = dep[r["j"], r["i"]] = not r["independent"]
        g[r["i"], r["j"]] = g[r["j"], r["i"]] = r["g"]
    return dep, g


def _closure(dep: np.ndarray, start: int, allowed: set[int]) -> set[int]:
    found, queue = {start}, deque([start])
    while queue:
        i = queue.popleft()
        for j in sorted(allowed - found):
            if dep[i, j]:
                found.add(j)
                queue.append(j)
    return found


def gvs(df, cols, kinds, domains, scope, seed=42, p=5.0) -> list[int]:
    """Variables that dependence chains tie to a random one, against the rest."""
    dep, _ = _g_matrices(df, cols, kinds, domains, scope, p)
    start = int(np.random.default_rng(seed).integers(len(scope)))
    inside = _closure(dep, start, set(range(len(scope))))
    return [int(i in inside) for i in range(len(scope))]


def _random_subset(n: int, seed: int) -> list[int]:
    return sorted(np.random.default_rng(seed).choice(n, max(2, math.isqrt(n)), replace=False).tolist()) if n > 1 else [0]


def rgvs(df, cols, kinds, domains, scope, seed=42, p=5.0) -> list[int]:
    """The same over a random subset of about the square root; others go at random."""
    rng, subset = np.random.default_rng(seed), _random_subset(len(scope), seed)
    dep, _ = _g_matrices(df, cols, kinds, domains, [scope[i] for i in subset], p)
    inside = _closure(dep, int(rng.integers(len(subset))), set(range(len(subset))))
    if len(inside) == len(subset):
        return [0] * len(scope)
    labels = {subset[i]: int(i in inside) for i in range(len(subset))}
    return [labels.get(i, int(rng.integers(2))) for i in range(len(scope))]


def wrgvs(df, cols, kinds, domains, scope, seed=42, p=5.0) -> list[int]:
    """As rgvs, but a variable outside the subset joins the side of its strongest G."""
    subset = _random_subset(len(scope), seed)
    dep, g = _g_matrices(df, cols, kinds, domains, scope, p)
    inside = {subset[i] for i in _closure(dep[np.ix_(subset, subset)], int(np.random.default_rng(seed).integers(len(subset))), set(range(len(subset))))}
    outside = set(subset) - inside
    if not outside:
        return [0] * len(scope)
    strongest = lambda i, side: max(g[i, j] for j in side)
    return [int(i in inside) if i in subset else int(strongest(i, inside) > strongest(i, outside)) for i in range(len(scope))]


def _by_value(df, cols, kinds, scope, measure_discrete, measure_continuous, bound) -> list[int]:
    low = [(measure_discrete if kinds[v].kind == "discrete" else measure_continuous)(df, cols[v]).first()[0] < bound for v in scope]
    return [int(x) for x in low]


def entropy_split(df, cols, kinds, domains, scope, seed=42, e=0.3) -> list[int]:
    """Variables of low entropy apart from the rest."""
    return _by_value(df, cols, kinds, scope, stats.entropy, stats.histogram_entropy, e)


def entropy_adaptive(df, cols, kinds, domains, scope, seed=42, e=0.3, size: int | None = None) -> list[int]:
    """The bound shrinks with the slice's share of `size` rows."""
    n = df.count()
    return entropy_split(df, cols, kinds, domains, scope, seed, max(1e-7, e * n / (size or n)))


def _histogram_gini(df: DataFrame, col: str) -> DataFrame:
    h = stats.histogram(df, col, "scott")
    return h.agg((1 - F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("gini"))


def gini_split(df, cols, kinds, domains, scope, seed=42, e=0.3) -> list[int]:
    return _by_value(df, cols, kinds, scope, stats.gini, _histogram_gini, e)


def gini_adaptive(df, cols, kinds, domains, scope, seed=42, e=0.3, size: int | None = None) -> list[int]:
    n = df.count()
    return gini_split(df, cols, kinds, domains, scope, seed, max(1e-7, e * n / (size or n)))


def random_cols(df, cols, kinds, domains, scope, seed=42) -> list[int]:
    rng = np.random.default_rng(seed)
    p = rng.beta(2, 2)
    return (rng.random(len(scope)) < p).astype(int).tolist()


def rdc_weights(d: int, seed: int = 42, k: int = 20, s: float = 1 / 6) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slopes and offsets of the random features of each column."""
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, math.sqrt(s), k), rng.normal(0, math.sqrt(s), k)) for _ in range(d)]


def rdc_features(df: DataFrame, own: Sequence[str], weights: list[tuple[np.ndarray, np.ndarray]], nl=F.sin) -> tuple[DataFrame, list[str]]:
    """Random non-linear features of each column's empirical distribution; missing cells take the middle rank."""
    names = []
    for i, c in enumerate(own):
        df = stats.ranked(df, c, f"__rank{i}")
        new = {f"__r{i}_{j}": nl(F.coalesce(f"__rank{i}", F.lit(0.5)) * float(w) + float(b)) for j, (w, b) in enumerate(zip(*weights[i], strict=True))}
        df = df.withColumns(new)
        names += list(new)
    return df, names


def rdc_scores(df: DataFrame, own: Sequence[str], seed: int = 42, k: int = 20, s: float = 1 / 6) -> np.ndarray:
    """Greatest canonical correlation of the features of every pair: one Gram matrix by partition sums, then small
    singular value problems."""
    made, names = rdc_features(df.select(*own), own, rdc_weights(len(own), seed, k, s))
    with_one = made.withColumn("__one", F.lit(1.0))
    n, g = stats.gram(with_one, [*names, "__one"])
    mean = g[-1, :-1] / n
    cov = g[:-1, :-1] / n - np.outer(mean, mean)
    d = len(own)
    roots = []
    for i in range(d):
        block = cov[i * k : (i + 1) * k, i * k : (i + 1) * k]
        val, vec = np.linalg.eigh(block)
        keep = val > max(1e-9, 1e-7 * val.max())
        roots.append(vec[:, keep] / np.sqrt(val[keep]))
    out = np.eye(d)
    for i in range(d):
        for j in range(i + 1, d):
            c = roots[i].T @ cov[i * k : (i + 1) * k, j * k : (j + 1) * k] @ roots[j]
            out[i, j] = out[j, i] = min(1.0, float(np.linalg.svd(c, compute_uv=False)[0])) if c.size else 0.0
    return out


def rdc_cols(df, cols, kinds, domains, scope, seed=42, d=0.3) -> list[int]:
    """Components of the graph of pairs that correlate above d."""
    near = rdc_scores(df, [cols[v] for v in scope], seed) > d
    label = [-1] * len(scope)
    for i in range(len(scope)):
        if label[i] < 0:
            for j in _closure(near, i, set(range(len(scope)))):
                label[j] = i
    order = {v: k for k, v in enumerate(dict.fromkeys(label))}
    return [order[v] for v in label]


SPLIT_COLS = {"gvs": gvs, "rgvs": rgvs, "wrgvs": wrgvs, "ebvs": entropy_split, "ebvs_ae": entropy_adaptive, "gbvs": gini_split, "gbvs_ag": gini_adaptive, "rdc": rdc_cols, "random": random_cols}

__all__ = ["OUT", "SPLIT_COLS", "SPLIT_ROWS", "coded", "rdc_features", "rdc_scores", "rdc_weights", "slice_weights"]
