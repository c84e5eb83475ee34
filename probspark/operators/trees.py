"""Chow-Liu trees and cutset networks over binary features, learned from Spark counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..plans.nodes import Bernoulli, ChowLiu, Node, Product, Sum, number
from .inference import log_likelihood


def spanning_tree(weights: np.ndarray, root: int) -> list[int]:
    """Parents in a maximum spanning tree that grows from root; ties go to the lower positions."""
    d = len(weights)
    parent = [-1] * d
    best = {j: (weights[root, j], root) for j in range(d) if j != root}
    while best:
        j = max(best, key=lambda k: (best[k][0], -k))
        parent[j] = best.pop(j)[1]
        for k in best:
            if weights[j, k] > best[k][0]:
                best[k] = weights[j, k], j
    return parent


def tree_parameters(parent: Sequence[int], pri: np.ndarray, jo: np.ndarray) -> np.ndarray:
    """log P(x_i = k | x_parent = l) from priors and joints, normalised over k."""
    out = np.empty((len(parent), 2, 2))
    for i, p in enumerate(parent):
        cpt = np.stack([pri[i], pri[i]]) if p < 0 else jo[i, p].T / pri[p][:, None]
        out[i] = np.log(cpt / cpt.sum(1, keepdims=True))
    return out


def tree_from_counts(n: int, m: np.ndarray, scope: Sequence[int], alpha: float = 0.1, root: int | None = None, seed: int = 42, parent: Sequence[int] | None = None) -> ChowLiu:
    pri, jo = stats.priors_joints_np(n, m, alpha)
    if parent is None:
        r = int(np.random.default_rng(seed).integers(len(scope))) if root is None else root
        parent = spanning_tree(stats.mutual_information_np(pri, jo), r)
    return ChowLiu(scope, parent, tree_parameters(parent, pri, jo))


def counts_of(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """Pair counts by plain sums, or by partial Gram matrices where there are many features."""
    return stats.pair_counts(df, cols) if len(cols) <= 60 else stats.gram(df, cols)


def learn_tree(df: DataFrame, cols: Sequence[str], scope: Sequence[int] | None = None, alpha: float = 0.1, root: int | None = None, seed: int = 42) -> ChowLiu:
    """Chow-Liu tree of maximum mutual information: one aggregate, then work on d x d numbers."""
    n, m = counts_of(df, cols)
    return tree_from_counts(n, m, list(range(len(cols))) if scope is None else scope, alpha, root, seed)


def tree_table(df: DataFrame, tree: ChowLiu, names: dict[int, str], key: str) -> DataFrame:
    """Log likelihood of complete rows in long form: cells joined with the broadcast table of conditional
    probabilities (4 rows for each variable), then summed by row."""
    spark = df.sparkSession
    cpt = spark.createDataFrame([(j, l, k, float(tree.logp[j, l, k])) for j in range(len(tree.scope)) for l in (0, 1) for k in (0, 1)], "var int, up int, val int, logp double")
    cell = lambda j, p: F.struct(F.lit(j).alias("var"), (F.lit(0) if p < 0 else F.col(names[tree.scope[p]]).cast("int")).alias("up"), F.col(names[tree.scope[j]]).cast("int").alias("val"))
    cells = df.select(key, F.explode(F.array(*[cell(j, p) for j, p in enumerate(tree.parent)])).alias("c")).select(key, "c.*")
    return cells.join(F.broadcast(cpt), ["var", "up", "val"]).groupBy(key).agg(F.sum("logp").alias("ll"))


def _where(conj: list[tuple[str, int]]) -> Column:
    return stats.balanced([F.col(c) == v for c, v in conj], lambda a, b: a & b) if conj else F.lit(True)


def _cnet(df: DataFrame, cols: Sequence[str], scope: list[int], conj: list, decide) -> Node:
    """Grow a cutset network: decide(n, m, scope, depth) gives (tree, None) or (None, (variable, weights))."""
    own = df.where(_where(conj))
    n, m = counts_of(own, [cols[v] for v in scope])
    tree, cut = decide(n, m, scope, len(conj), own)
    if cut is None:
        return tree
    var, weights = cut
    rest = [v for v in scope if v != var]
    kids = []
    for k in (0, 1):
        below = _cnet(df, cols, rest, [*conj, (cols[var], k)], decide)
        kids.append(Product([Bernoulli(var, float(k)), below]))
    return Sum(weights, kids)


def _leaf(n: int, m: np.ndarray, scope: list[int], alpha: float, seed: int) -> Node:
    if len(scope) == 1:
        return Bernoulli(scope[0], (m[0, 0] + alpha) / (n + 2 * alpha))
    return tree_from_counts(n, m, scope, alpha, seed=seed)


def learn_cnet(df: DataFrame, cols: Sequence[str], alpha: float = 0.01, min_rows: int = 10, min_features: int = 1, min_entropy: float = 0.01, seed: int = 42) -> Node:
    """Cutset network by entropy gain, as a circuit: cuts are sums over indicator products, ends are Chow-Liu trees."""

    def decide(n, m, scope, depth, own):
        if n > min_rows and len(scope) > min_features:
            mean, gains = stats.entropy_gains(n, m, 2 * alpha, 4 * alpha)
            i = int(gains.argmax())
            if mean >= min_entropy and gains[i] > 0:
                one = m[i, i]
                w = np.array([n - one + alpha, one + alpha]) / (n + 2 * alpha)
                return None, (scope[i], w)
        return _leaf(n, m, scope, alpha, seed), None

    return number(_cnet(df, cols, list(range(len(cols))), [], decide))


def candidate_cuts(n: int, m: np.ndarray, ess: float, k: int) -> list[int]:
    """The k variables of greatest entropy gain; ties by position."""
    _, gains = stats.entropy_gains(n, m, ess / 2, ess)
    return sorted(range(len(m)), key=lambda i: (-gains[i], i))[:k]


def bayesian_tree(n: int, m: np.ndarray, scope: list[int], ess: float) -> tuple[ChowLiu, float]:
    """Tree of greatest BDeu score over edges, its score, parameters with alpha = ess / 4."""
    roots, pairs = stats.bdeu_roots(n, m, ess), stats.bdeu_pairs(n, m, ess)
    gain = pairs - roots[:, None]
    parent = spanning_tree((gain + gain.T) / 2, 0)
    score = tree_score(roots, pairs, parent)
    return tree_from_counts(n, m, scope, ess / 4, parent=parent), score


def tree_score(roots: np.ndarray, pairs: np.ndarray, parent: Sequence[int]) -> float:
    return float(sum(roots[i] if p < 0 else pairs[i, p] for i, p in enumerate(parent)))


def learn_cnet_bd(df: DataFrame, cols: Sequence[str], ess: float = 0.1, candidates: int = 10) -> Node:
    """Cutset network by BDeu: a cut is taken if it scores above the tree; the sample size halves with every level."""

    def decide(n, m, scope, depth, own):
        e = ess / 2**depth
        if len(scope) == 1 or n == 0:
            return _leaf(n, m, scope, e / 4, 0), None
        tree, score = bayesian_tree(n, m, scope, e)
        best, names = (score, None), [cols[v] for v in scope]
        lg = math.lgamma
        for i in candidate_cuts(n, m, e, candidates):
            one = m[i, i]
            total = lg(e) - lg(n + e) + sum(lg(c + e / 2) - lg(e / 2) for c in (n - one, one))
            rest = [j for j in range(len(scope)) if j != i]
            for k in (0, 1):
                nk, mk = _branch_counts(own, names, i, k, rest)
                total += bayesian_tree(nk, mk, [scope[j] for j in rest], e / 2)[1] if rest else 0.0
            if total > best[0] + 1e-9:
                best = total, (scope[i], np.array([n - one + e / 2, one + e / 2]) / (n + e))
        return (tree, None) if best[1] is None else (None, best[1])

    return number(_cnet(df, cols, list(range(len(cols))), [], decide))


def learn_cnet_bic(df: DataFrame, cols: Sequence[str], alpha: float = 0.01, candidates: int = 5) -> Node:
    """Cutset network by BIC: log likelihood less half ln N for each free parameter."""
    total = df.count()
    penalty = 0.5 * math.log(max(total, 2))

    def fitted(n, m, scope) -> tuple[Node, float]:
        leaf = _leaf(n, m, scope, alpha, 0)
        # the log likelihood of the data under the tree needs its counts only
        if isinstance(leaf, Bernoulli):
            p = min(max(leaf.p, 1e-12), 1 - 1e-12)
            ll = m[0, 0] * math.log(p) + (n - m[0, 0]) * math.log(1 - p)
        else:
            ll = 0.0
            for i, p in enumerate(leaf.parent):
                one = m[i, i]
                if p < 0:
                    ll += one * leaf.logp[i, 0, 1] + (n - one) * leaf.logp[i, 0, 0]
                else:
                    both, up = m[i, p], m[p, p]
                    ll += both * leaf.logp[i, 1, 1] + (up - both) * leaf.logp[i, 1, 0] + (one - both) * leaf.logp[i, 0, 1] + (n - up - one + both) * leaf.logp[i, 0, 0]
        return leaf, ll - penalty * (2 * len(scope) - 1)

    def decide(n, m, scope, depth, own):
        leaf, score = fitted(n, m, scope)
        best = score, None
        if len(scope) > 1 and n:
            for i in candidate_cuts(n, m, 4 * alpha, candidates):
                one = m[i, i]
                if one in (0, n):
                    continue
                w = np.array([n - one + alpha, one + alpha]) / (n + 2 * alpha)
                rest = [j for j in range(len(scope)) if j != i]
                value = (n - one) * math.log(w[0]) + one * math.log(w[1]) - penalty
                for k in (0, 1):
                    nk, mk = _branch_counts(own, [cols[v] for v in scope], i, k, rest)
                    value += fitted(nk, mk, [scope[j] for j in rest])[1]
                if value > best[0] + 1e-9:
                    best = value, (scope[i], w)
        return (leaf, None) if best[1] is None else (None, best[1])

    return number(_cnet(df, cols, list(range(len(cols))), [], decide))


def _branch_counts(own: DataFrame, names: Sequence[str], i: int, k: int, rest: list[int]) -> tuple[int, np.ndarray]:
    return counts_of(own.where(F.col(names[i]) == k), [names[j] for j in rest])


def mean_log_likelihood(df: DataFrame, root: Node, names: dict[int, str]) -> float:
    return log_likelihood(df, root, names).agg(F.avg("ll")).first()[0]
