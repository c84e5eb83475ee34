"""Properties that make queries over a circuit exact."""

from __future__ import annotations

from contextlib import contextmanager
from contextvars import ContextVar

from .nodes import ChowLiu, Node, Product, Sum, bfs, layers, of_type

_enabled: ContextVar[bool] = ContextVar("check_circuits", default=True)
_kinds: ContextVar[bool] = ContextVar("check_kinds", default=True)


@contextmanager
def checking(enabled: bool | None = None, kinds: bool | None = None):
    """Switch the validation of circuits before queries, and the casts of `as_kind`, on or off within a block (of this
    thread); what is None stays."""
    tokens = [(flag, flag.set(value)) for flag, value in ((_enabled, enabled), (_kinds, kinds)) if value is not None]
    try:
        yield
    finally:
        for flag, token in tokens:
            flag.reset(token)


def checks_kinds() -> bool:
    return _kinds.get()


def problem(root: Node, labeled=True, smooth=True, decomposable=True, structured=False) -> str | None:
    """What is wrong, or None."""
    if layers(root) is None:
        return "it has a cycle"
    nodes = list(bfs(root))
    if labeled and sorted(n.id if n.id is not None else -1 for n in nodes) != list(range(len(nodes))):
        return "ids are not 0 .. n - 1"
    for n in nodes:
        if smooth and isinstance(n, Sum):
            if len(n.weights) != len(n.children) or abs(n.weights.sum() - 1) > 1e-6:
                return f"weights of node {n.id} do not match"
            if any(set(c.scope) != set(n.scope) for c in n.children):
                return f"sum {n.id} is not smooth"
        if decomposable and isinstance(n, Product):
            union = [v for c in n.children for v in c.scope]
            if len(union) != len(set(union)) or set(union) != set(n.scope):
                return f"product {n.id} is not decomposable"
    if structured and not is_structured(root):
        return "it is not structured decomposable"
    return None


def scopes(root: Node) -> set[frozenset]:
    """Scopes of all nodes, and of the products inside tree leaves."""
    inner = {frozenset(s) for n in of_type(root, ChowLiu) for s in n.product_scopes()}
    return {frozenset(n.scope) for n in bfs(root)} | inner


def _alike(a: set[frozenset], b: set[frozenset]) -> bool:
    """Any scope of a and any of b are nested or disjoint."""
    return all(not (x & y) or x <= y or y <= x for x in a for y in b)


def is_structured(root: Node) -> bool:
    """All products split alike, those inside tree leaves too: any two scopes are nested or disjoint."""
    found = scopes(root)
    return _alike(found, found)


def are_compatible(a: Node, b: Node) -> bool:
    """Whether both circuits split common variables alike."""
    common = frozenset(a.scope) & frozenset(b.scope)
    cut = [{s & common for s in scopes(r)} for r in (a, b)]
    return _alike(*cut)


def check(root: Node, **what) -> None:
    if _enabled.get() and (found := problem(root, **what)):
        raise ValueError(f"invalid circuit: {found}")
