"""Queries over circuits: likelihoods with missing cells summed out, most probable completions, samples, gradients,
moments. `lowering` chooses Spark columns (small circuits; no Python, pruning and predicates stay visible) or array
kernels (any size); both run without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..plans.backends import Arrays, Columns
from ..plans.nodes import ChowLiu, Leaf, Node, Sum, layers, number, post_order, safe_log
from ..plans.validate import check

SMALL = 120


def leaf_log(b, n: Leaf):
    """Log density of a leaf, 0 where its cells are missing."""
    return n.log(b, b.x)


def inner_log(b, n: Node, children: list):
    """Log of a weighted sum, or of a product, from the logs of the children."""
    return b.lse([v + safe_log(w) for w, v in zip(n.weights, children, strict=True)]) if isinstance(n, Sum) else b.add(children)


def inner_max(b, n: Node, children: list):
    """As `inner_log` with the greatest weighted child in place of the sum."""
    return b.greatest([v + safe_log(w) for w, v in zip(n.weights, children, strict=True)]) if isinstance(n, Sum) else b.add(children)


def _forward(b, root: Node, leaf: Callable = leaf_log, inner: Callable = inner_log) -> dict[int, object]:
    """Value of every node, by id; log likelihoods by default."""
    ll: dict[int, object] = {}
    for layer in reversed(layers(root)):
        for n in layer:
            v = leaf(b, n) if isinstance(n, Leaf) else inner(b, n, [ll[c.id] for c in n.children])
            ll[n.id] = b.bind(b.floor(v))
        b.flush()
    return ll


def _gradients(b, root: Node, ll: dict) -> dict[int, object]:
    """Log of the derivative of the root by every node."""
    into: dict[int, list] = {root.id: [b.const(0.0)]}
    g: dict[int, object] = {}
    for layer in layers(root):
        for n in layer:
            g[n.id] = b.bind(b.lse(into[n.id]))
        b.flush()
        for n in layer:
            for i, c in enumerate(n.children):
                flow = g[n.id] + (safe_log(n.weights[i]) if isinstance(n, Sum) else ll[n.id] - ll[c.id])
                into.setdefault(c.id, []).append(b.bind(flow))
        b.flush()
    return g


def best_branch(b, n: Sum, children: list):
    """The first of the greatest weighted children."""
    return b.argmax([v + safe_log(w) for w, v in zip(n.weights, children, strict=True)])


def drawn_branch(b, n: Sum, children: list):
    """A child drawn by posterior."""
    terms = [v + safe_log(w) for w, v in zip(n.weights, children, strict=True)]
    total = b.bind(b.lse(terms), now=True)
    shares = [b.exp(t - total) for t in terms]
    return b.below(b.uniform(n.id), [b.add(shares[: i + 1]) for i in range(len(shares) - 1)])


def leaf_mode(b, n: Leaf) -> dict:
    """Mode of each of the leaf's variables."""
    return n.fill(b, b.x, None)


def leaf_draw(b, n: Leaf) -> dict:
    """A draw of each of the leaf's variables."""
    return n.fill(b, b.x, lambda k: b.uniform(n.id, k))


def _complete(b, root: Node, branch: Callable, fill: Callable, leaf: Callable = leaf_log, inner: Callable = inner_log) -> dict[int, object]:
    """Filled value of every variable: branches top down, then leaves where their mask holds."""
    ll = _forward(b, root, leaf, inner)
    mask: dict[int, list] = {root.id: [b.true()]}
    filled: dict[int, list] = {}
    for layer in layers(root):  # a projection for the layer's masks, and one for its branches
        reached = {n.id: b.bind(b.either(mask[n.id])) if len(mask[n.id]) > 1 else mask[n.id][0] for n in layer}
        b.flush()
        taken = {n.id: b.bind(branch(b, n, [ll[c.id] for c in n.children])) for n in layer if isinstance(n, Sum)}
        b.flush()
        for n in layer:
            m = reached[n.id]
            if isinstance(n, Leaf):
                for var, value in fill(b, n).items():
                    filled.setdefault(var, []).append((m, value))
                continue
            for i, c in enumerate(n.children):
                mask.setdefault(c.id, []).append(b.bind(b.both(m, b.is_(taken[n.id], i))) if n.id in taken else m)
        b.flush()
    out = {}
    for var, options in filled.items():
        value = b.x(var)
        for m, v in options:
            value = b.where(b.both(m, b.missing(b.x(var))), v, value)
        out[var] = value
    return out


def _uniforms(keys: np.ndarray, seed: int) -> Callable:
    """The same numbers as functions.rng.uniform, for array kernels."""
    import hashlib

    def draw(*where: int) -> np.ndarray:
        tail = "|".join(str(w) for w in where)
        return np.array([int(hashlib.md5(f"{seed}|{k}|{tail}".encode()).hexdigest()[:8], 16) for k in keys]) / 4294967296.0

    return draw


def _run(df: DataFrame, root: Node, names: dict[int, str], program, out: list[str], lowering: str, key: str | None = None, seed: int = 42) -> DataFrame:
    """program(backend) gives {name: value}; out lists the added or replaced double columns."""
    number(root)
    check(root)
    missing = [v for v in root.scope if v not in names]
    if missing:
        raise ValueError(f"no column for variables {missing}")
    if lowering == "auto":
        lowering = "columns" if len(post_order(root)) <= SMALL else "kernel"
    if lowering == "columns":
        b = Columns(df, {v: names[v] for v in root.scope}, key, seed)
        return b.result(**{k: v + 0.0 for k, v in program(b).items()})
    used = [names[v] for v in root.scope]
    shared = df.sparkSession.sparkContext.broadcast((root, names))
    new = [c for c in out if c not in df.columns]
    own = [f.name for f in df.schema if f.name not in out]
    replaced = [c for c in df.columns if c in out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in own] + [f"`{c}` double" for c in [*replaced, *new]])

    def kernel(batches):
        r, names_ = shared.value
        for p in batches:
            x = {v: p[c].to_numpy(dtype=float, na_value=np.nan) for v, c in names_.items() if c in used}
            b = Arrays(x, len(p), _uniforms(p[key].to_numpy(), seed) if key else None)
            values = program_for(b, r)
            yield pd.concat([p[own], pd.DataFrame({c: np.broadcast_to(values[c], len(p)) for c in [*replaced, *new]}, index=p.index)], axis=1)

    program_for = lambda b, r: program(b, r)
    return df.mapInPandas(kernel, schema).select(*df.columns, *new)


def log_likelihood(df: DataFrame, root: Node, names: dict[int, str], out: str = "ll", lowering: str = "auto") -> DataFrame:
    """Adds the log likelihood of each row; missing cells are summed out."""
    return _run(df, root, names, lambda b, r=root: {out: _forward(b, r)[r.id]}, [out], lowering)


def likelihood(df: DataFrame, root: Node, names: dict[int, str], out: str = "likelihood", lowering: str = "auto") -> DataFrame:
    return _run(df, root, names, lambda b, r=root: {out: b.exp(_forward(b, r)[r.id])}, [out], lowering)


def mpe(df: DataFrame, root: Node, names: dict[int, str], lowering: str = "auto") -> DataFrame:
    """Missing cells filled: sums follow their best weighted child by likelihood, leaves give their modes."""
    return _run(df, root, names, lambda b, r=root: {names[v]: x for v, x in _complete(b, r, best_branch, leaf_mode).items()}, [names[v] for v in root.scope], lowering)


def sample(df: DataFrame, root: Node, names: dict[int, str], key: str, seed: int = 42, lowering: str = "auto") -> DataFrame:
    """Missing cells drawn from the circuit given the others; numbers depend on seed and the row's key only."""
    return _run(df, root, names, lambda b, r=root: {names[v]: x for v, x in _complete(b, r, drawn_branch, leaf_draw).items()}, [names[v] for v in root.scope], lowering, key, seed)


def evaluate(df: DataFrame, root: Node, names: dict[int, str], leaf: Callable = leaf_log, inner: Callable = inner_log, out: str = "value", nodes: bool = False, lowering: str = "auto") -> DataFrame:
    """Adds the value of the root under functions of one's own, bottom up: leaf(b, node) and inner(b, node, children's values).

    b is the lowering: it has the cells (b.x(variable), missing where b.missing holds) and the operations of `Columns` and
    `Arrays`, so a function written with them runs as columns and as a kernel; one that is written for arrays takes
    lowering="kernel". nodes: also every node's value, as <out>_<id>."""
    number(root)
    ids = sorted(n.id for n in post_order(root))

    def program(b, r=root):
        found = _forward(b, r, leaf, inner)
        return {out: found[r.id]} | ({f"{out}_{i}": found[i] for i in ids} if nodes else {})

    return _run(df, root, names, program, [out, *[f"{out}_{i}" for i in ids if nodes]], lowering)


def descend(
    df: DataFrame, root: Node, names: dict[int, str], leaf: Callable = leaf_log, inner: Callable = inner_log, branch: Callable = best_branch, fill: Callable = leaf_mode,
    key: str | None = None, seed: int = 42, lowering: str = "auto",
) -> DataFrame:
    """Missing cells filled top down under functions of one's own: after `evaluate`, branch(b, sum, children's values) numbers
    the child that a sum follows, and fill(b, leaf) gives {variable: value} for the leaves that are reached. `key` names the
    rows for b.uniform(...)."""
    program = lambda b, r=root: {names[v]: x for v, x in _complete(b, r, branch, fill, leaf, inner).items()}
    return _run(df, root, names, program, [names[v] for v in root.scope], lowering, key, seed)


def node_values(df: DataFrame, root: Node, names: dict[int, str], gradients: bool = False, lowering: str = "auto") -> DataFrame:
    """Adds ll_<id> for every node, and grad_<id> if asked."""
    number(root)

    def program(b, r=root):
        ll = _forward(b, r)
        found = {f"ll_{i}": v for i, v in ll.items()}
        return found | ({f"grad_{i}": v for i, v in _gradients(b, r, ll).items()} if gradients else {})

    ids = [n.id for n in post_order(root)]
    return _run(df, root, names, program, [f"ll_{i}" for i in sorted(ids)] + ([f"grad_{i}" for i in sorted(ids)] if gradients else []), lowering)


def moments(root: Node, order: int) -> dict[int, float]:
    """Raw moment of every variable."""
    if order < 0:
        raise ValueError("order is 0 at least")
    found: dict[int, dict[int, float]] = {}
    for n in post_order(root):
        if isinstance(n, ChowLiu):
            found[id(n)] = dict(zip(n.scope, n.moment(order), strict=True))
        elif isinstance(n, Leaf):
            found[id(n)] = {n.var: n.moment(order)}
        elif isinstance(n, Sum):
            found[id(n)] = {v: float(sum(w * found[id(c)][v] for w, c in zip(n.weights, n.children, strict=True))) for v in n.scope}
        else:
            found[id(n)] = {v: m for c in n.children for v, m in found[id(c)].items()}
    return found[id(root)]


def summary_moments(root: Node) -> dict[int, dict[str, float]]:
    """Mean, variance, skewness and excess kurtosis of every variable."""
    m = [moments(root, k) for k in range(5)]
    out = {}
    for v in root.scope:
        a, b, c, d = (m[k][v] for k in (1, 2, 3, 4))
        var = b - a * a
        third = c - 3 * a * b + 2 * a**3
        fourth = d - 4 * a * c + 6 * a * a * b - 3 * a**4
        out[v] = {"mean": a, "variance": var, "skewness": third / var**1.5 if var > 0 else 0.0, "kurtosis": fourth / var**2 - 3 if var > 0 else 0.0}
    return out


def mask_cells(df: DataFrame, cols: list[str], key: str, p: float, seed: int = 42) -> DataFrame:
    """Cells hidden with probability p, by row key and place."""
    return df.withColumns({c: F.when(uniform(seed, key, F.lit(j)) <= p, None).otherwise(F.col(c)) for j, c in enumerate(cols)})
