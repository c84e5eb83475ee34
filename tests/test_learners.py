"""Learners whose result no SQL gives, against plain versions over arrays: cutset networks by three scores, rank
dependence, Fréchet distance, independence splits."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.operators import learn, splits
from probspark.plans.nodes import Bernoulli, Categorical, Gaussian, number
from probspark.plans.rewrite import prune
from probspark.operators import inference
from probspark.queries import QUERIES
from probspark.sources.matrices import E4, e4, load


@pytest.fixture(scope="module")
def table(spark, sf):
    return e4(spark, sf).orderBy("event_id").toPandas()[E4].to_numpy()


def prim(w):
    inside, parent = [0], {0: -1}
    while len(inside) < len(w):
        _, j, p = min((-w[p][j], j, inside.index(p)) for p in inside for j in range(len(w)) if j not in inside)
        parent[j] = inside[p]
        inside.append(j)
    return [parent[j] for j in range(len(w))]


def smoothed(x, alpha):
    """P(x_i = a, x_j = b) and P(x_i = a), with alpha added to every pair of values."""
    n, d = x.shape
    pri = np.array([[(sum(x[:, i] == a) + 2 * alpha) / (n + 4 * alpha) for a in (0, 1)] for i in range(d)])
    jo = np.array([[[[(sum((x[:, i] == a) & (x[:, j] == b)) + alpha) / (n + 4 * alpha) for b in (0, 1)] for a in (0, 1)] for j in range(d)] for i in range(d)])
    return pri, jo


def tree_ll(x, rows, parent, alpha):
    """Log likelihood of rows under the tree fitted on x."""
    pri, jo = smoothed(x, alpha)
    out = np.zeros(len(rows))
    for i, p in enumerate(parent):
        for r, row in enumerate(rows):
            if p < 0:
                out[r] += math.log(pri[i][row[i]])
            else:
                given = jo[i][p][:, row[p]] / pri[p][row[p]]
                out[r] += math.log(given[row[i]] / given.sum())
    return out


def mutual(x, alpha):
    pri, jo = smoothed(x, alpha)
    d = x.shape[1]
    return [[sum(jo[i][j][a][b] * math.log(jo[i][j][a][b] / (pri[i][a] * pri[j][b])) for a in (0, 1) for b in (0, 1)) if i != j else 0 for j in range(d)] for i in range(d)]


def entropy(x, a1, a2):
    h = lambda p: -(p * math.log(p) + (1 - p) * math.log(1 - p))
    return sum(h((x[:, j].sum() + a1) / (len(x) + a2)) for j in range(x.shape[1])) / x.shape[1]


def gains(x, a1, a2):
    out = []
    for i in range(x.shape[1]):
        rest = np.delete(x, i, 1)
        share = x[:, i].mean()
        parts = [entropy(rest[x[:, i] == k], a1, a2) if rest.shape[1] else 0.0 for k in (0, 1)]
        out.append(entropy(x, a1, a2) - (1 - share) * parts[0] - share * parts[1])
    return out


def bdeu(x, parent, ess):
    lg, total = math.lgamma, 0.0
    for i, p in enumerate(parent):
        groups = [x] if p < 0 else [x[x[:, p] == k] for k in (0, 1)]
        e = ess / len(groups)
        for g in groups:
            total += lg(e) - lg(len(g) + e) + sum(lg((g[:, i] == a).sum() + e / 2) - lg(e / 2) for a in (0, 1))
    return total


def bd_tree(x, ess):
    d = x.shape[1]
    alone = [bdeu(x[:, [i]], [-1], ess) for i in range(d)]
    pair = lambda i, j: bdeu(x[:, [i, j]], [1, -1], ess) - alone[j] - alone[i]
    w = [[(pair(i, j) + pair(j, i)) / 2 if i != j else 0 for j in range(d)] for i in range(d)]
    parent = prim(w)
    return parent, bdeu(x, parent, ess)


def grow(x, rows, scope, decide, depth=0):
    """Log likelihoods of rows; decide(x, depth) gives ('tree', parent, alpha), ('one', p) or ('cut', i, weights)."""
    kind, *what = decide(x, depth)
    if kind == "tree":
        return tree_ll(x, rows, *what)
    if kind == "one":
        return np.array([math.log(what[0] if r[0] else 1 - what[0]) for r in rows])
    i, w = what
    out = np.empty(len(rows))
    for k in (0, 1):
        mine = rows[:, i] == k
        out[mine] = math.log(w[k]) + grow(np.delete(x[x[:, i] == k], i, 1), np.delete(rows[mine], i, 1), scope, decide, depth + 1)
    return out


def learned(query, spark, sf):
    return QUERIES[query](spark, sf).orderBy("event_id").toPandas()["ll"].to_numpy()


def test_cutset_network_by_entropy(spark, sf, table):
    alpha = 0.01

    def decide(x, depth):
        n, d = x.shape
        if n > 10 and d > 1:
            g = gains(x, 2 * alpha, 4 * alpha)
            i = int(np.argmax(g))
            if entropy(x, 2 * alpha, 4 * alpha) >= 0.01 and g[i] > 0:
                one = x[:, i].sum()
                return "cut", i, [(n - one + alpha) / (n + 2 * alpha), (one + alpha) / (n + 2 * alpha)]
        if d == 1:
            return "one", (x[:, 0].sum() + alpha) / (n + 2 * alpha)
        w = mutual(x, alpha)
        return "tree", prim(w), alpha

    assert np.allclose(learned("cnet_score", spark, sf), grow(table, table, E4, decide), atol=1e-6)


def test_cutset_network_by_bdeu(spark, sf, table):
    def decide(x, depth):
        n, d = x.shape
        e = 0.1 / 2**depth
        if d == 1 or n == 0:
            return "one", (x[:, 0].sum() + e / 4) / (n + e / 2)
        parent, best = bd_tree(x, e)
        out = ("tree", parent, e / 4)
        g = gains(x, e / 2, e)
        for i in sorted(range(d), key=lambda i: (-g[i], i))[:10]:
            one = x[:, i].sum()
            value = bdeu(x[:, [i]], [-1], e) + sum(bd_tree(np.delete(x[x[:, i] == k], i, 1), e / 2)[1] for k in (0, 1))
            if value > best + 1e-9:
                best, out = value, ("cut", i, [(n - one + e / 2) / (n + e), (one + e / 2) / (n + e)])
        return out

    assert np.allclose(learned("cnet_bd_score", spark, sf), grow(table, table, E4, decide), atol=1e-6)


def test_cutset_network_by_bic(spark, sf, table):
    alpha, penalty = 0.01, 0.5 * math.log(len(table))

    def fitted(x):
        n, d = x.shape
        if d == 1:
            p = (x[:, 0].sum() + alpha) / (n + 2 * alpha)
            return ("one", p), sum(math.log(p if v else 1 - p) for v in x[:, 0]) - penalty
        # trees may differ in their root only: the score is the same for all of them
        parent = prim(mutual(x, alpha))
        return ("tree", parent, alpha), tree_ll(x, x, parent, alpha).sum() - penalty * (2 * d - 1)

    def decide(x, depth):
        n, d = x.shape
        out, best = fitted(x)
        if d > 1 and n:
            g = gains(x, 2 * alpha, 4 * alpha)
            for i in sorted(range(d), key=lambda i: (-g[i], i))[:5]:
                one = x[:, i].sum()
                if one in (0, n):
                    continue
                w = [(n - one + alpha) / (n + 2 * alpha), (one + alpha) / (n + 2 * alpha)]
                value = (n - one) * math.log(w[0]) + one * math.log(w[1]) - penalty + sum(fitted(np.delete(x[x[:, i] == k], i, 1))[1] for k in (0, 1))
                if value > best + 1e-9:
                    best, out = value, ("cut", i, w)
        return out

    got, want = learned("cnet_bic_score", spark, sf), grow(table, table, E4, decide)
    assert got.mean() == pytest.approx(want.mean(), abs=1e-3)


def test_rank_dependence(spark, sf):
    """Canonical correlations by orthonormal bases of the features themselves."""
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    x = load(spark, sf, "lineitem").select(*cols).toPandas().to_numpy()
    bases = []
    for c, (w, b) in zip(x.T, splits.rdc_weights(3), strict=True):
        rank = np.searchsorted(np.sort(c), c, "right") / len(c)
        f = np.sin(rank[:, None] * w + b)
        u, s, _ = np.linalg.svd(f - f.mean(0), full_matrices=False)
        bases.append(u[:, s > 1e-4 * s[0]])
    for r in QUERIES["rdc_pairs"](spark, sf).collect():
        want = np.linalg.svd(bases[r["i"]].T @ bases[r["j"]], compute_uv=False)[0]
        assert r["rdc"] == pytest.approx(min(1.0, want), abs=0.02)


def test_rank_clusters(spark):
    rng = np.random.default_rng(0)
    side = rng.random(600) < 0.5
    x = np.where(side[:, None], rng.uniform(0, 1, (600, 2)), rng.uniform(20, 30, (600, 2)))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    got = splits.SPLIT_ROWS["rdc"](df, ["a", "b"], [Gaussian] * 2, [(0.0, 30.0)] * 2, [0, 1], "id")
    assert got.columns == [*df.columns, splits.OUT]
    label = got.orderBy("id").toPandas()[splits.OUT].to_numpy()
    assert max((label == side).mean(), (label != side).mean()) > 0.95


def test_frechet_distance(spark, sf):
    t = load(spark, sf, "embeddings").toPandas()
    x, y = (np.stack(t["embedding"][m]).astype(float) for m in (t["label"] < 5, t["label"] >= 5))
    a, b = np.cov(x.T), np.cov(y.T)
    root = np.sqrt(np.maximum(np.linalg.eigvals(a @ b).real, 0)).sum()
    want = ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * root
    assert QUERIES["fid_embeddings"](spark, sf).first()["fid"] == pytest.approx(want, abs=2e-3)


def g_dependent(x, i, j, p=5.0):
    n = np.array([[((x[:, i] == a) & (x[:, j] == b)).sum() for b in (0, 1)] for a in (0, 1)]) + float(np.finfo(np.float32).eps)
    e = n.sum(1, keepdims=True) * n.sum(0, keepdims=True) / n.sum()
    return 2 * (n * np.log(n / e)).sum() >= 2 * p


def test_independence_split(spark, sf):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    x = np.stack([a, a ^ (rng.random(800) < 0.1), b, b ^ (rng.random(800) < 0.1), rng.integers(0, 2, 800)], 1)
    df = spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"x{i} int" for i in range(5)))
    cols = [f"x{i}" for i in range(5)]
    for seed in range(4):
        got = splits.SPLIT_COLS["gvs"](df, cols, [Bernoulli] * 5, [[0, 1]] * 5, list(range(5)), seed=seed)
        start = int(np.random.default_rng(seed).integers(5))
        inside, grown = {start}, True
        while grown:
            more = {j for i in inside for j in range(5) if j not in inside and g_dependent(x, i, j)}
            grown = bool(more)
            inside |= more
        assert got == [int(i in inside) for i in range(5)]


def test_learned_circuits_are_normalised(spark, sf):
    """All assignments of a learned circuit over binary variables sum to one, for every pair of splits."""
    df = e4(spark, sf)
    every = spark.createDataFrame([(i, *r) for i, r in enumerate(itertools.product([0, 1], repeat=4))], "event_id long, " + ", ".join(f"{c} int" for c in E4))
    names = {i: c for i, c in enumerate(E4)}
    for rows, cols in (("kmeans", "rdc"), ("rdc", "ebvs"), ("random", "rgvs"), ("gmm", "gbvs"), ("dbscan", "wrgvs")):
        root = number(prune(learn.learn_spn(df, E4, [Bernoulli] * 4, [[0, 1]] * 4, "event_id", learn_leaf="mle", split_rows=rows, split_cols=cols, min_rows=300)))
        total = inference.likelihood(every, root, names).agg(F.sum("likelihood")).first()[0]
        assert total == pytest.approx(1.0, abs=1e-6), (rows, cols)
    assert Categorical
