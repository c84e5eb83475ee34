"""Circuits as node-link JSON, as edge tables, and as DOT text."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .nodes import LEAVES, ChowLiu, Leaf, Node, Product, Sum, bfs, number


def _round(v):
    if isinstance(v, (list, np.ndarray)):
        return [_round(x) for x in v]
    return round(float(v), 8) if isinstance(v, (float, np.floating)) else v


def to_dict(root: Node) -> dict:
    """{nodes, links}; links go from child to parent, with the child's place; floats keep 8 decimals."""
    number(root)
    nodes, links = [], []
    for n in bfs(root):
        entry = {"id": n.id, "class": type(n).__name__, "scope": list(n.scope)}
        if isinstance(n, Sum):
            entry["weights"] = _round(n.weights)
        elif isinstance(n, Leaf):
            entry["params"] = {k: _round(v) for k, v in n.params().items()}
        nodes.append(entry)
        links += [{"source": c.id, "target": n.id, "idx": i} for i, c in enumerate(n.children)]
    return {"directed": True, "nodes": sorted(nodes, key=lambda x: x["id"]), "links": links}


def from_dict(found: dict, leaves=()) -> Node:
    """Inverse of to_dict; leaves: further leaf classes, whose names must be new."""
    known = dict(LEAVES)
    for c in leaves:
        if c.__name__ in known:
            raise ValueError(f"leaf name {c.__name__} is taken")
        known[c.__name__] = c
    entries = {n["id"]: n for n in found["nodes"]}
    kids: dict[int, dict[int, int]] = {}
    for e in found["links"]:
        kids.setdefault(e["target"], {})[e["idx"]] = e["source"]
    made: dict[int, Node] = {}

    def make(i: int, path: tuple[int, ...] = ()) -> Node:
        if i in path:
            raise ValueError("a circuit has no cycle")
        if i not in made:
            n, below = entries[i], [make(c, (*path, i)) for _, c in sorted(kids.get(i, {}).items())]
            if n["class"] == "Sum":
                w = np.array(n["weights"])
                made[i] = Sum(w / w.sum(), below)
            elif n["class"] == "Product":
                made[i] = Product(below)
            elif n["class"] == "ChowLiu":
                made[i] = ChowLiu(n["scope"], n["params"]["tree"], n["params"]["params"])
            else:
                args = {k: v for k, v in n["params"].items() if k != "categories"}
                if n["class"] in ("Categorical", "Isotonic"):
                    key = "probabilities" if "probabilities" in args else "densities"
                    p = np.array(args[key])
                    args[key] = p / p.sum()
                made[i] = known[n["class"]](n["scope"][0] if len(n["scope"]) == 1 else n["scope"], **args)
        return made[i]

    return number(make(0))


def save(root: Node, path: str) -> None:
    with open(path, "w") as f:
        json.dump(to_dict(root), f)


def load(path: str, leaves=()) -> Node:
    with open(path) as f:
        return from_dict(json.load(f), leaves)


def edge_table(spark: SparkSession, root: Node) -> DataFrame:
    """child, parent, idx, weight (null below products)."""
    number(root)
    rows = [(c.id, n.id, i, float(n.weights[i]) if isinstance(n, Sum) else None) for n in bfs(root) for i, c in enumerate(n.children)]
    return spark.createDataFrame(rows, "child int, parent int, idx int, weight double")


def node_table(spark: SparkSession, root: Node) -> DataFrame:
    """id, class, scope."""
    number(root)
    return spark.createDataFrame([(n.id, type(n).__name__, list(n.scope)) for n in bfs(root)], "id int, class string, scope array<int>")


def dot(root: Node) -> str:
    """DOT text of a circuit, or of a tree's edges."""
    number(root)
    out = ["digraph circuit {"]
    for n in bfs(root):
        label = {"Sum": "+", "Product": "x"}.get(type(n).__name__, f"{type(n).__name__} {n.scope}")
        out.append(f'  {n.id} [label="{label}"];')
        for i, c in enumerate(n.children):
            out.append(f"  {n.id} -> {c.id}" + (f' [label="{n.weights[i]:.3f}"]' if isinstance(n, Sum) else "") + ";")
        if isinstance(n, ChowLiu):
            out += [f'  "{n.id}_{n.scope[p]}" -> "{n.id}_{n.scope[j]}";' for j, p in enumerate(n.parent) if p >= 0]
    return "\n".join([*out, "}"])
