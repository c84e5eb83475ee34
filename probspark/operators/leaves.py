"""Leaf learning: maximum likelihood fits from one aggregate per slice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..plans.nodes import Bernoulli, Categorical, Gaussian, Isotonic, Leaf, Node, Product, Uniform
from .trees import learn_tree


def fit_leaves(df: DataFrame, cols: Sequence[str], kinds: Sequence[type], domains: Sequence, scope: Sequence[int], alpha: float = 0.1) -> list[Leaf]:
    """One leaf for each variable of scope; all but isotonic ones come from a single aggregate."""
    exprs = [F.count(F.lit(1)).alias("n")]
    for v in scope:
        x, k = stats.known(cols[v]), kinds[v]
        exprs.append(F.count(x).alias(f"n{v}"))
        if k is Bernoulli:
            if list(domains[v]) != [0, 1]:
                raise ValueError("a Bernoulli leaf needs the domain [0, 1]")
            exprs.append(F.sum(x).alias(f"s{v}"))
        elif k is Categorical:
            exprs += [F.count(F.when(x == float(d), 1)).alias(f"c{v}_{i}") for i, d in enumerate(domains[v])]
        elif k is Gaussian:
            exprs += [F.avg(x).alias(f"m{v}"), F.stddev_pop(x).alias(f"s{v}")]
        elif k is Uniform:
            exprs += [F.min(x).alias(f"lo{v}"), F.max(x).alias(f"hi{v}")]
    r = df.agg(*exprs).first()
    out = []
    for v in scope:
        n, k = r[f"n{v}"], kinds[v]
        if k is Bernoulli:
            out.append(Bernoulli(v, ((r[f"s{v}"] or 0) + alpha) / (n + 2 * alpha)))
        elif k is Categorical:
            size = len(domains[v])
            out.append(Categorical(v, (np.array([r[f"c{v}_{i}"] for i in range(size)]) + alpha) / (n + size * alpha)))
        elif k is Gaussian:
            out.append(Gaussian(v, r[f"m{v}"] or 0.0, max(r[f"s{v}"] or 0.0, 1e-5)))
        elif k is Uniform:
            out.append(Uniform(v, r[f"lo{v}"], max(r[f"hi{v}"] - r[f"lo{v}"], 1e-12)))
        elif k is Isotonic:
            out.append(fit_isotonic(df, cols[v], v, alpha))
        else:
            raise ValueError(f"no fit for {k.__name__}")
    return out


def fit_isotonic(df: DataFrame, col: str, scope: int, alpha: float = 0.1) -> Isotonic:
    h = stats.histogram(df, col, "fd").orderBy("bin").collect()
    n, bins = sum(x["n"] for x in h), len(h)
    p = np.array([(x["n"] + alpha) / (n + bins * alpha) for x in h])
    breaks = [h[0]["lo"], *[x["hi"] for x in h]]
    if breaks[-1] <= breaks[0]:
        breaks = [breaks[0] - 0.5, breaks[0] + 0.5]
    return Isotonic(scope, p / p.sum(), breaks)


def factorise(df: DataFrame, cols, kinds, domains, scope, alpha: float = 0.1) -> Node:
    """Independent leaves, or the leaf itself."""
    leaves = fit_leaves(df, cols, kinds, domains, scope, alpha)
    return leaves[0] if len(leaves) == 1 else Product(leaves)


def learn_mle(df, cols, kinds, domains, scope, alpha: float = 0.1, **_) -> Node:
    return factorise(df, cols, kinds, domains, scope, alpha)


def learn_isotonic(df, cols, kinds, domains, scope, alpha: float = 0.1, **_) -> Node:
    """Isotonic leaves for continuous variables, fitted ones for the others."""
    forced = [Isotonic if k.kind == "continuous" else k for k in kinds]
    return factorise(df, cols, forced, domains, scope, alpha)


def learn_binary_clt(df, cols, kinds, domains, scope, alpha: float = 0.1, to_pc: bool = False, seed: int = 42, **_) -> Node:
    if any(kinds[v] is not Bernoulli for v in scope):
        raise ValueError("trees need Bernoulli variables")
    if len(scope) == 1:
        return learn_mle(df, cols, kinds, domains, scope, alpha)
    tree = learn_tree(df, [cols[v] for v in scope], scope, alpha, seed=seed)
    if not to_pc:
        return tree
    from ..plans.rewrite import to_circuit

    return to_circuit(tree)


LEARN_LEAF = {"mle": learn_mle, "isotonic": learn_isotonic, "binary-clt": learn_binary_clt}
