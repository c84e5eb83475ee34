"""Rewrites that keep what a circuit computes."""

from __future__ import annotations

import numpy as np

from .nodes import Bernoulli, ChowLiu, Leaf, Node, Product, Sum, number, post_order


def _rebuild(root: Node, make) -> Node | None:
    new: dict[int, Node | None] = {}
    for n in post_order(root):
        new[id(n)] = make(n, [new[id(c)] for c in n.children])
    return new[id(root)]


def _simple(n: Node, kids: list[Node]) -> Node:
    """One child stands for its parent; products in products and sums in sums dissolve, equal children add up."""
    if len(kids) == 1:
        return kids[0]
    if isinstance(n, Product):
        return Product([g for c in kids for g in (c.children if isinstance(c, Product) else [c])])
    total: dict[int, float] = {}
    by: dict[int, Node] = {}
    for w, c in zip(n.weights, kids, strict=True):
        for v, g in zip(c.weights, c.children, strict=True) if isinstance(c, Sum) else [(1.0, c)]:
            by[id(g)] = g
            total[id(g)] = total.get(id(g), 0.0) + w * v
    w = np.array(list(total.values()))
    return list(by.values())[0] if len(by) == 1 else Sum(w / w.sum(), list(by.values()))


def prune(root: Node) -> Node:
    """Smallest circuit by local rules; the given one is left alone."""
    return number(_rebuild(root, lambda n, kids: n if isinstance(n, Leaf) else _simple(n, kids)))


def marginalize(root: Node, keep) -> Node:
    """The circuit over the kept variables only."""
    keep = set(keep)
    if not keep or not keep <= set(root.scope):
        raise ValueError("keep some of the circuit's variables")

    def make(n: Node, kids: list[Node | None]) -> Node | None:
        if isinstance(n, ChowLiu):
            inside = keep & set(n.scope)
            return n if inside == set(n.scope) else (marginalize(to_circuit(n), inside) if inside else None)
        if isinstance(n, Leaf):
            return n if set(n.scope) <= keep else None
        left = [(i, c) for i, c in enumerate(kids) if c is not None]
        if not left:
            return None
        if isinstance(n, Sum):
            return _simple(Sum(n.weights, [c for _, c in left]), [c for _, c in left])
        return _simple(n, [c for _, c in left])

    return number(_rebuild(root, make))


def to_circuit(tree: ChowLiu) -> Node:
    """The tree as a smooth, deterministic, structured-decomposable circuit with indicator leaves."""
    d = len(tree.scope)
    kids: list[list[int]] = [[] for _ in range(d)]
    for j, p in enumerate(tree.parent):
        if p >= 0:
            kids[p].append(j)
    given: dict[int, list[Node]] = {}
    for j in reversed(tree.order):
        values = []
        for k in (0, 1):
            leaf = Bernoulli(tree.scope[j], float(k))
            below = [given[c][k] for c in kids[j]]
            values.append(Product([leaf, *below]) if below else leaf)
        e = np.exp(tree.logp[j])
        given[j] = [Sum(e[l] / e[l].sum(), list(values)) for l in (0, 1)]
    return number(given[tree.root][0])
