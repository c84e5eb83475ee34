"""Learning of circuits: LearnSPN, classifiers, expectation maximisation, random (ensemble) circuits."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..plans.backends import Arrays
from ..plans.nodes import Bernoulli, Categorical, ChowLiu, Gaussian, Leaf, Node, Product, Sum, bfs, number, safe_log
from ..plans.rewrite import prune
from ..plans.validate import check
from ..sources.tables import stored
from .inference import _forward, _gradients
from .leaves import LEARN_LEAF, factorise, fit_leaves
from .partition import Partition
from .splits import OUT, SPLIT_COLS, SPLIT_ROWS
from .trees import counts_of, spanning_tree, tree_from_counts


def learn_spn(
    df: DataFrame,
    cols: Sequence[str],
    kinds: Sequence[type],
    domains: Sequence | None = None,
    key: str = "id",
    learn_leaf: str | Callable = "mle",
    split_rows: str | Callable = "kmeans",
    split_cols: str | Callable = "rdc",
    min_rows: int = 256,
    min_cols: int = 2,
    leaf_args: dict | None = None,
    rows_args: dict | None = None,
    cols_args: dict | None = None,
    seed: int = 42,
) -> Node:
    """Recursive row and column splits over slices. A slice is a DataFrame of its own: clusters of a row split are
    written together once and read back by label, column splits only select.

    Order of choice: all variables constant: leaves; some constant: they part from the rest; too few rows or
    columns, or rows that no split divides: a leaf; first, or columns that no split divides: rows; else columns."""
    leaf = LEARN_LEAF[learn_leaf] if isinstance(learn_leaf, str) else learn_leaf
    rows = SPLIT_ROWS[split_rows] if isinstance(split_rows, str) else split_rows
    columns = SPLIT_COLS[split_cols] if isinstance(split_cols, str) else split_cols
    domains = stats.domains(df, cols, [k.kind == "discrete" for k in kinds]) if domains is None else domains
    counter = itertools.count(seed)

    def grow(own: DataFrame, scope: list[int], first: bool, no_rows: bool, no_cols: bool) -> Node:
        r = own.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(stats.known(cols[v])).alias(f"v{v}") for v in scope]).first()
        n = r["n"]
        constant = [v for v in scope if abs(r[f"v{v}"] or 0.0) <= 1e-8]
        if len(constant) == len(scope):
            return factorise(own, cols, kinds, domains, scope)
        if constant:
            rest = [v for v in scope if v not in constant]
            return Product([*fit_leaves(own, cols, kinds, domains, constant), grow(own, rest, False, no_rows, no_cols)])
        if no_rows or n < min_rows or len(scope) < min_cols:
            return leaf(own, cols, kinds, domains, scope, **(leaf_args or {}))
        if no_cols or first:
            marked = stored(rows(own, cols, kinds, domains, scope, key, next(counter), **(rows_args or {})))
            sizes = {x[OUT]: x["count"] for x in marked.groupBy(OUT).count().orderBy(OUT).collect()}
            if len(sizes) < 2:
                return grow(own, scope, False, True, False)
            kids = [grow(marked.where(F.col(OUT) == k).drop(OUT), scope, False, False, False) for k in sizes]
            return Sum(np.array(list(sizes.values())) / n, kids)
        labels = columns(own, cols, kinds, domains, scope, next(counter), **(cols_args or {}))
        parts = [[v for v, x in zip(scope, labels, strict=True) if x == k] for k in sorted(set(labels))]
        if len(parts) < 2:
            return grow(own, scope, False, False, True)
        return Product([grow(own, p, False, False, False) for p in parts])

    return number(grow(df.select(key, *cols), list(range(len(cols))), True, False, False))


def learn_estimator(df, cols, kinds, domains=None, method: str = "learnspn", key: str = "id", **args) -> Node:
    """LearnSPN, a random circuit or an ensemble of them; pruned."""
    if method == "learnspn":
        return prune(learn_spn(df, cols, kinds, domains, key, **args))
    if any(k is not Bernoulli for k in kinds):
        raise ValueError("random circuits need Bernoulli variables")
    if method == "xpc":
        return prune(learn_xpc(df, cols, **args))
    if method == "ensemble-xpc":
        return prune(learn_ensemble(df, cols, **args))
    raise ValueError(f"unknown method {method}")


def learn_classifier(df, cols, kinds, class_col: int, domains=None, key: str = "id", **args) -> Node:
    """One circuit for each class, weighted by class shares; the class variable stays in every child's scope."""
    domains = stats.domains(df, cols, [k.kind == "discrete" for k in kinds]) if domains is None else domains
    counts = {r[0]: r[1] for r in df.groupBy(cols[class_col]).count().collect()}
    values = sorted(v for v in counts if v is not None)
    total = sum(counts[v] for v in values)
    kids = [learn_spn(df.where(F.col(cols[class_col]) == v), cols, kinds, domains, key, **args) for v in values]
    return number(Sum([counts[v] / total for v in values], kids))


# --- expectation maximisation --------------------------------------------------------------------------------------


def _em_sums(b: Arrays, root: Node) -> dict[str, float]:
    """Expected counts of one batch, by name."""
    ll = _forward(b, root)
    g = _gradients(b, root, ll)
    top = ll[root.id]
    out = {"ll": float(top.sum()), "n": float(b.n)}
    for n in bfs(root):
        if isinstance(n, Sum):
            for i, (w, c) in enumerate(zip(n.weights, n.children, strict=True)):
                out[f"w{n.id}_{i}"] = float(np.exp(ll[c.id] - top + g[n.id] + safe_log(w)).sum())
        elif isinstance(n, Leaf):
            s = np.exp(ll[n.id] - top + g[n.id])
            if isinstance(n, ChowLiu):
                out[f"l{n.id}_s"] = float(s.sum())
                x = {v: np.nan_to_num(b.x(v), nan=0.0) for v in n.scope}
                for i, p in enumerate(n.parent):
                    out[f"l{n.id}_s{i}"] = float((s * x[n.scope[i]]).sum())
                    if p >= 0:
                        out[f"l{n.id}_s{i}_p"] = float((s * x[n.scope[i]] * x[n.scope[p]]).sum())
                continue
            x = b.x(n.var)
            s = np.where(np.isnan(x), 0.0, s)
            x = np.nan_to_num(x, nan=0.0)
            if isinstance(n, Gaussian):  # about the mean so far: squares of large values would drown the spread
                x = x - n.mean
            out[f"l{n.id}_s"], out[f"l{n.id}_sx"], out[f"l{n.id}_sxx"] = float(s.sum()), float((s * x).sum()), float((s * x * x).sum())
            if isinstance(n, Categorical):
                for i in range(len(n.probabilities)):
                    out[f"l{n.id}_s{i}"] = float(s[x == i].sum())
    return out


def em_statistics(df: DataFrame, root: Node, names: dict[int, str]) -> DataFrame:
    """name, value: expected counts over all rows, one partial sum per partition and name."""
    number(root)
    shared = df.sparkSession.sparkContext.broadcast((root, names))

    def part(batches):
        total: dict[str, float] = {}
        r, cols = shared.value
        for p in batches:
            if len(p):
                b = Arrays({v: p[c].to_numpy(dtype=float, na_value=np.nan) for v, c in cols.items()}, len(p))
                for k, v in _em_sums(b, r).items():
                    total[k] = total.get(k, 0.0) + v
        if total:  # Arrow has no type for the columns of a partition without rows
            yield pd.DataFrame({"name": list(total), "value": list(total.values())})

    return df.select(*names.values()).mapInPandas(part, "name string, value double").groupBy("name").agg(F.sum("value").alias("value"))


def em_step(root: Node, sums: dict[str, float], step: float) -> None:
    """Move parameters towards the expected counts."""
    for n in bfs(root):
        if isinstance(n, Sum):
            new = np.array([sums.get(f"w{n.id}_{i}", 0.0) for i in range(len(n.children))]) + np.finfo(np.float32).eps
            w = (1 - step) * n.weights + step * new / new.sum()
            n.weights = w / w.sum()
        elif isinstance(n, Leaf):
            mine = f"l{n.id}_"
            n.em_update({k[len(mine) :]: v for k, v in sums.items() if k.startswith(mine)}, step)


def expectation_maximisation(df: DataFrame, root: Node, names: dict[int, str], iterations: int = 100, share: float | None = None, step: float = 0.5, random_start: bool = False, key: str | None = None, seed: int = 42) -> list[float]:
    """Fits the circuit in place; returns the mean log likelihood before each step. share: of rows drawn by key for
    each step (all rows if None). One job per step; nothing but sums moves."""
    if iterations <= 0 or not 0 < step <= 1 or (share is not None and not 0 < share < 1):
        raise ValueError("iterations > 0, 0 < step <= 1, 0 < share < 1")
    number(root)
    check(root)
    if random_start:
        rng = np.random.default_rng(seed)
        for n in bfs(root):
            if isinstance(n, Sum):
                n.weights = rng.dirichlet(np.ones(len(n.weights)))
            elif isinstance(n, Leaf):
                n.em_init(rng)
    history = []
    from ..functions.rng import uniform

    for k in range(iterations):
        batch = df if share is None else df.where(uniform(f"{seed}-{k}", key) < share)
        sums = {r["name"]: r["value"] for r in em_statistics(batch, root, names).collect()}
        if not sums:
            continue
        history.append(sums["ll"] / max(1.0, sums["n"]))
        em_step(root, sums, step)
    return history


# --- random circuits -----------------------------------------------------------------------------------------------


def greedy_order(mi: np.ndarray, length: int) -> list[int]:
    """Blocks of the variable with the most mutual information and its closest `length` - 1 others."""
    left, out = set(range(len(mi))), []
    while left:
        rest = sorted(left)
        head = max(rest, key=lambda i: (mi[i, rest].sum(), -i))
        left.discard(head)
        near = sorted(left, key=lambda j: (-mi[head, j], j))[: length - 1]
        left -= set(near)
        out += [head, *near]
    return out


def shared_trees(ends: Sequence[tuple], order: Sequence[int], conj: int, alpha: float, rng: np.random.Generator) -> dict[int, dict[int, int]]:
    """Parents of the variables (-1: root) by length of scope, for ends (scope, rows, pair counts) that all hold the
    last variables of one order. Each block of `conj` variables has one tree of maximum mutual information, summed over
    all ends, and the tree of the blocks behind it hangs from its root: trees of all lengths split scopes alike."""
    d = len(order)
    info = np.zeros((d, d))
    for scope, n, m in ends:
        info[np.ix_(scope, scope)] += stats.mutual_information_np(*stats.priors_joints_np(n, m, alpha))
    shortest = min(len(scope) for scope, _, _ in ends)
    blocks = [*(list(order[k : k + conj]) for k in range(0, d - shortest, conj)), list(order[d - shortest :])]
    up: dict[int, int] = {}
    out = {}
    for block in reversed(blocks):
        root = int(rng.integers(len(block)))
        below = next((v for v, p in up.items() if p < 0), None)
        if below is not None:
            up[below] = block[root]
        up |= {v: block[p] if p >= 0 else -1 for v, p in zip(block, spanning_tree(info[np.ix_(block, block)], root), strict=True)}
        out[len(up)] = dict(up)
    return out


def _leaf_maker(use_clt: bool, alpha: float, trees: dict[int, dict[int, int]] | None) -> Callable:
    """leaf(scope, rows, pair counts): a tree, of the shared shape if there is one, or independent variables."""

    def leaf(scope: list[int], n: int, m: np.ndarray) -> Node:
        if len(scope) == 1 or not use_clt:
            leaves = [Bernoulli(v, (m[i, i] + alpha) / (n + 2 * alpha)) for i, v in enumerate(scope)]
            return leaves[0] if len(leaves) == 1 else Product(leaves)
        if trees is None:
            return tree_from_counts(n, m, scope, alpha, root=0)
        up = trees[len(scope)]
        return tree_from_counts(n, m, scope, alpha, parent=[scope.index(up[v]) if up[v] >= 0 else -1 for v in scope])

    return leaf


def _exact(assign: Sequence[int], vs: Sequence[int]) -> list[Node]:
    return [Bernoulli(v, float(a)) for v, a in zip(vs, assign, strict=True)]


def disjunction(counts: dict[tuple, int], vs: Sequence[int], alpha: float) -> Node:
    """Distribution over the assignments of vs that occur, by their smoothed counts."""
    found = sorted(counts)
    w = np.array([counts[a] + alpha for a in found])
    kids = [Product(_exact(a, vs)) if len(vs) > 1 else _exact(a, vs)[0] for a in found]
    return kids[0] if len(kids) == 1 else Sum(w / w.sum(), kids)


def _random_parts(df: DataFrame, cols: Sequence[str], det: bool, min_rows: int, conj: int, arity: int, max_parts: int, alpha: float, rng: np.random.Generator, order: Sequence[int] | None) -> tuple[Callable, list[tuple]]:
    """A random partition of rows and variables. Returns build and ends: build(leaf) makes the circuit over it, ends
    lists (scope, rows, pair counts) of the places of its leaves."""
    if conj < 1 or not 2 <= arity <= 2**conj:
        raise ValueError("conj >= 1 and 2 <= arity <= 2 ** conj")
    budget, ends = [max_parts], []

    def end(part: Partition) -> Callable:
        n, m = counts_of(part.slice(df, cols), [cols[v] for v in part.scope])
        ends.append((list(part.scope), n, m))
        return lambda leaf: leaf(list(part.scope), n, m)

    def grow(part: Partition) -> Callable:
        if len(part.scope) <= conj or budget[0] <= 1:
            return end(part)
        vs = [v for v in order if v in part.scope][:conj] if order is not None else sorted(rng.choice(part.scope, conj, replace=False).tolist())
        counts = {tuple(r[cols[v]] for v in vs): r["n"] for r in part.assignments(df, cols, vs).collect()}
        total = sum(counts.values())
        usable = [a for a in sorted(counts) if counts[a] >= min_rows]
        rng.shuffle(usable)
        kept, left = [], total
        for a in usable:
            if len(kept) < min(arity, budget[0]) - 1 and left - counts[a] >= min_rows:
                kept.append(a)
                left -= counts[a]
        if not kept:
            return end(part)
        budget[0] -= len(kept)
        parts = [p.split_cols(vs) for p in part.split_rows(vs, kept)]
        if det:
            head = [disjunction({a: n for a, n in counts.items() if a not in kept}, vs, alpha)]
        else:
            n, m = counts_of(parts[0][0].slice(df, cols), [cols[v] for v in vs])
            head = [Bernoulli(v, (m[i, i] + alpha) / (n + 2 * alpha)) for i, v in enumerate(vs)]
        heads = [head, *[_exact(a, vs) for a in kept]]
        kids = [(h, grow(rest)) for h, (_, rest) in zip(heads, parts, strict=True)]
        weights = np.array([left, *[counts[a] for a in kept]]) / total
        return lambda leaf: Sum(weights, [Product([*h, build(leaf)]) for h, build in kids])

    return grow(Partition(tuple(range(len(cols))))), ends


def _dependence_order(df: DataFrame, cols: Sequence[str], conj: int, alpha: float) -> list[int]:
    return greedy_order(stats.mutual_information_np(*stats.priors_joints_np(*counts_of(df, cols), alpha)), conj)


def learn_xpc(df: DataFrame, cols: Sequence[str], det: bool = False, sd: bool = False, min_rows: int = 128, conj: int = 2, arity: int = 2, max_parts: int = 200, use_clt: bool = True, alpha: float = 0.01, seed: int = 42, order: Sequence[int] | None = None) -> Node:
    """Random circuit: conjunctions on drawn variables split rows; a branch keeps an exact assignment of them and goes
    on with the other variables, the rest of the rows forms a branch with its own distribution of assignments.
    sd: all branches draw along one order of variables and all leaves share one tree for each length of scope, which
    makes the circuit structured decomposable, tree leaves included."""
    rng = np.random.default_rng(seed)
    if sd and order is None:
        order = _dependence_order(df, cols, conj, alpha)
    build, ends = _random_parts(df, cols, det, min_rows, conj, arity, max_parts, alpha, rng, order if sd else None)
    trees = shared_trees(ends, order, conj, alpha, rng) if sd and use_clt else None
    return number(build(_leaf_maker(use_clt, alpha, trees)))


def learn_ensemble(df: DataFrame, cols: Sequence[str], size: int = 3, sd_level: int = 0, seed: int = 42, det: bool = False, min_rows: int = 128, conj: int = 2, arity: int = 2, max_parts: int = 200, use_clt: bool = True, alpha: float = 0.01) -> Node:
    """Uniform mixture. sd_level 0: free members; 1: each member structured, along an order of its own; 2: the whole
    mixture structured: all members use one order and one set of trees, learned from the leaves of all of them."""
    if sd_level not in (0, 1, 2):
        raise ValueError("sd_level is 0, 1 or 2")
    if sd_level == 2 and conj == 1:
        raise ValueError("along one order, conjunctions of one variable leave nothing to chance")
    args = {"det": det, "min_rows": min_rows, "conj": conj, "arity": arity, "max_parts": max_parts, "alpha": alpha}
    rngs = [np.random.default_rng(seed + k) for k in range(size)]
    if sd_level < 2:
        orders = [rng.permutation(len(cols)).tolist() for rng in rngs]
        members = [learn_xpc(df, cols, sd=sd_level == 1, seed=seed + k, use_clt=use_clt, order=orders[k], **args) for k in range(size)]
    else:
        order = _dependence_order(df, cols, conj, alpha)
        drawn = [_random_parts(df, cols, rng=rng, order=order, **args) for rng in rngs]
        trees = shared_trees([e for _, ends in drawn for e in ends], order, conj, alpha, rngs[0]) if use_clt else None
        members = [build(_leaf_maker(use_clt, alpha, trees)) for build, _ in drawn]
    return number(Sum(np.full(size, 1 / size), members)) if size > 1 else number(members[0])


def bic(ll_sum: float, n: int, parameters: int) -> float:
    return ll_sum - 0.5 * math.log(n) * parameters


__all__ = ["Gaussian", "bic", "em_statistics", "em_step", "expectation_maximisation", "learn_classifier", "learn_ensemble", "learn_estimator", "learn_spn", "learn_xpc"]
