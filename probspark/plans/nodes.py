"""Circuit nodes and leaves.

A circuit is a rooted DAG of weighted sums, products and leaves over numbered variables. Leaves describe their
densities with the operations of a backend, so each exists as a Spark expression and as an array kernel; a custom
leaf needs the methods of `Leaf` and a name in `LEAVES` to be stored and loaded.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np

from .backends import FLOOR

#: Log density outside an isotonic leaf's range: log of the machine epsilon of 64-bit floats.
OUTSIDE = math.log(np.finfo(np.float64).eps)
#: Smoothing of EM steps: machine epsilon of 16-bit floats.
EM_ALPHA = float(np.finfo(np.float16).eps)
EPS32 = float(np.finfo(np.float32).eps)


def safe_log(p: float) -> float:
    return math.log(p) if p > 0 else FLOOR


class Node:
    """id is set by `number`; scope lists variables without repeats."""

    def __init__(self, scope, children=()):
        scope = list(scope)
        if not scope or len(set(scope)) != len(scope):
            raise ValueError("a scope has one or more different variables")
        self.id: int | None = None
        self.scope, self.children = scope, list(children)


class Sum(Node):
    """Convex combination of children over one scope."""

    def __init__(self, weights, children, scope=None):
        weights = np.asarray(weights, float)
        if not len(children) or len(weights) != len(children):
            raise ValueError("a sum needs a weight for each of its children")
        if (weights < 0).any() or not math.isclose(weights.sum(), 1.0, abs_tol=1e-6):
            raise ValueError("weights are non-negative and sum to 1")
        scope = list(children[0].scope if scope is None else scope)
        if any(set(c.scope) != set(scope) for c in children):
            raise ValueError("children of a sum share its scope")
        super().__init__(scope, children)
        self.weights = weights


class Product(Node):
    """Children over disjoint scopes."""

    def __init__(self, children, scope=None):
        if not children:
            raise ValueError("a product needs children")
        union = [v for c in children for v in c.scope]
        if len(set(union)) != len(union) or (scope is not None and set(scope) != set(union)):
            raise ValueError("children of a product have disjoint scopes that make up its own")
        super().__init__(union if scope is None else scope, children)


class Leaf(Node):
    """Distribution of one or more variables.

    log(b, get): log density with missing variables summed out. fill(b, get, u): {var: value} of the most probable
    completion, or of a sample where u(k) gives uniforms. moment(k), n_params, params and em complete it."""

    kind = "continuous"

    def __init__(self, scope):
        super().__init__([scope] if isinstance(scope, int) else scope)

    @property
    def var(self) -> int:
        return self.scope[0]

    def log(self, b, get):
        x = get(self.var)
        return b.where(b.missing(x), b.const(0.0), self.log_present(b, x))

    def log_present(self, b, x):
        raise NotImplementedError

    def fill(self, b, get, u=None):
        x = get(self.var)
        value = b.const(self.mode()) if u is None else self.draw(b, u)
        return {self.var: b.where(b.missing(x), value, x)}

    def mode(self) -> float:
        raise NotImplementedError

    def draw(self, b, u):
        raise NotImplementedError

    def moment(self, k: int) -> float:
        raise NotImplementedError

    def em_init(self, rng) -> None:
        raise NotImplementedError(f"no random start for {type(self).__name__}")

    def em_update(self, stats: dict, step: float) -> None:
        raise NotImplementedError(f"no EM step for {type(self).__name__}")


class Bernoulli(Leaf):
    kind = "discrete"

    def __init__(self, scope, p: float = 0.5):
        super().__init__(scope)
        if not 0 <= p <= 1:
            raise ValueError("p is a probability")
        self.p = float(p)

    def log_present(self, b, x):
        return b.table(x, [safe_log(1 - self.p), safe_log(self.p)], FLOOR)

    def mode(self):
        return 0.0 if self.p < 0.5 else 1.0

    def draw(self, b, u):
        return b.where(u(0) < self.p, b.const(1.0), b.const(0.0))

    def moment(self, k):
        return self.p if k else 1.0

    n_params = 1

    def params(self):
        return {"p": self.p}

    def em_init(self, rng):
        self.p = float(rng.uniform())

    def em_update(self, s, step):
        self.p = (1 - step) * self.p + step * (s["sx"] + EM_ALPHA) / (s["s"] + 2 * EM_ALPHA)


class Categorical(Leaf):
    """Categories 0 .. k - 1 (other values are coded first)."""

    kind = "discrete"

    def __init__(self, scope, probabilities):
        super().__init__(scope)
        self.probabilities = np.asarray(probabilities, float)
        if (self.probabilities < 0).any() or not math.isclose(self.probabilities.sum(), 1.0, abs_tol=1e-6):
            raise ValueError("probabilities are non-negative and sum to 1")

    def log_present(self, b, x):
        return b.table(x, [safe_log(p) for p in self.probabilities], FLOOR)

    def mode(self):
        return float(self.probabilities.argmax())

    def draw(self, b, u):
        cuts = np.cumsum(self.probabilities)[:-1]
        return b.below(u(0), [b.const(c) for c in cuts]) + b.const(0.0)

    def moment(self, k):
        return float((np.arange(len(self.probabilities)) ** k * self.probabilities).sum()) if k else 1.0

    @property
    def n_params(self):
        return 2 * len(self.probabilities)

    def params(self):
        return {"categories": list(range(len(self.probabilities))), "probabilities": self.probabilities.tolist()}

    def em_init(self, rng):
        self.probabilities = rng.dirichlet(np.ones(len(self.probabilities)))

    def em_update(self, s, step):
        k = len(self.probabilities)
        new = (np.array([s[f"s{i}"] for i in range(k)]) + EM_ALPHA) / (s["s"] + k * EM_ALPHA)
        self.probabilities = (1 - step) * self.probabilities + step * new


class Isotonic(Leaf):
    """Histogram with equal bins; values at or beyond the ends count as outside."""

    def __init__(self, scope, densities, breaks):
        super().__init__(scope)
        self.densities, self.breaks = np.asarray(densities, float), np.asarray(breaks, float)
        if len(self.breaks) != len(self.densities) + 1 or not math.isclose(self.densities.sum(), 1.0, abs_tol=1e-6):
            raise ValueError("densities sum to 1, with one break more than there are bins")

    def log_present(self, b, x):
        lo, hi = self.breaks[0], self.breaks[-1]
        logs = [safe_log(d) - math.log(max(w, 1e-300)) for d, w in zip(self.densities, np.diff(self.breaks), strict=True)]
        return b.where((x > float(lo)) & (x < float(hi)), b.steps(x, self.breaks.tolist(), logs), b.const(OUTSIDE))

    def mode(self):
        i = int(self.densities.argmax())
        return float(self.breaks[i] + self.breaks[i + 1]) / 2

    def draw(self, b, u):
        below = np.concatenate(([0.0], np.cumsum(self.densities)))
        at = b.below(u(0), [b.const(c) for c in below[1:-1]]) + b.const(0.0)
        pick = lambda v: b.table(at, list(v), 0.0)
        return pick(self.breaks[:-1]) + (u(0) - pick(below[:-1])) * pick(np.diff(self.breaks) / np.maximum(self.densities, 1e-300))

    def moment(self, k):
        lo, hi = self.breaks[:-1], self.breaks[1:]
        return float((self.densities * (hi ** (k + 1) - lo ** (k + 1)) / ((k + 1) * np.maximum(hi - lo, 1e-300))).sum()) if k else 1.0

    @property
    def n_params(self):
        return 2 * len(self.densities) + 1

    def params(self):
        return {"densities": self.densities.tolist(), "breaks": self.breaks.tolist()}


class Uniform(Leaf):
    def __init__(self, scope, start: float, width: float):
        super().__init__(scope)
        self.start, self.width = float(start), float(width)

    def log_present(self, b, x):
        inside = (x >= self.start) & (x <= self.start + self.width)
        return b.where(inside, b.const(-math.log(max(self.width, 1e-300))), b.const(FLOOR))

    def mode(self):
        return self.start

    def draw(self, b, u):
        return u(0) * self.width + self.start

    def moment(self, k):
        a, c = self.start, self.start + self.width
        return (c ** (k + 1) - a ** (k + 1)) / ((k + 1) * self.width) if k else 1.0

    n_params = 2

    def params(self):
        return {"start": self.start, "width": self.width}


class Gaussian(Leaf):
    def __init__(self, scope, mean: float, stddev: float):
        super().__init__(scope)
        if stddev < 1e-5:
            raise ValueError("stddev is 1e-5 at least")
        self.mean, self.stddev = float(mean), float(stddev)

    def log_present(self, b, x):
        z = (x - self.mean) / self.stddev
        return z * z * -0.5 - (math.log(self.stddev) + 0.5 * math.log(2 * math.pi))

    def mode(self):
        return self.mean

    def draw(self, b, u):
        return b.normal(u(0), u(1)) * self.stddev + self.mean

    def moment(self, k):
        m = [1.0, self.mean]
        for i in range(2, k + 1):
            m.append(self.mean * m[-1] + (i - 1) * self.stddev**2 * m[-2])
        return m[k]

    n_params = 2

    def params(self):
        return {"mean": self.mean, "stddev": self.stddev}

    def em_init(self, rng):
        self.mean, self.stddev = 0.1 * float(rng.normal()), 0.5 + 0.1 * math.tanh(float(rng.normal()))

    def em_update(self, s, step):
        """s: total s, sx and sxx about the mean so far."""
        total = s["s"] + EPS32
        moved = s["sx"] / total
        sd = max(math.sqrt(max((s["sxx"] - 2 * moved * s["sx"] + moved * moved * s["s"]) / total, 0.0)), 1e-5)
        self.mean, self.stddev = self.mean + step * moved, (1 - step) * self.stddev + step * sd


class ChowLiu(Leaf):
    """Tree over binary variables. parent[i] is a position in scope (-1 for the root); logp[i, l, k] is
    log P(x_i = k | x_parent = l), the root's row repeated."""

    kind = "discrete"

    def __init__(self, scope, parent, logp):
        super().__init__(scope)
        self.parent, self.logp = [int(p) for p in parent], np.asarray(logp, float)
        self.root = self.parent.index(-1)
        self.order = tree_order(self.parent)

    def product_scopes(self) -> list[tuple[int, ...]]:
        """Scopes of the products of the equivalent circuit: the variables under each node with children."""
        under: list[list[int]] = [[v] for v in self.scope]
        for j in reversed(self.order):
            if self.parent[j] >= 0:
                under[self.parent[j]] += under[j]
        return [tuple(sorted(u)) for u in under if len(u) > 1]

    def _messages(self, b, get, join):
        """Per variable the pair of upward messages to its parent's two values, and the pair at its own values."""
        d = len(self.scope)
        inbox: list[list] = [[] for _ in range(d)]
        own: list = [None] * d
        up: list = [None] * d
        lp = np.maximum(self.logp, FLOOR)
        for j in reversed(self.order):
            x = get(self.scope[j])
            arrived = [b.add([m[k] for m in inbox[j]]) if inbox[j] else b.const(0.0) for k in (0, 1)]
            own[j] = arrived
            rows = []
            for l in (0, 1):
                terms = [b.bind(arrived[k] + lp[j, l, k]) for k in (0, 1)]
                b.flush()
                hidden = join(b, terms)
                rows.append(b.bind(b.where(b.missing(x), hidden, b.where(x == 1, terms[1], terms[0]))))
                b.flush()
            up[j] = rows
            if self.parent[j] >= 0:
                inbox[self.parent[j]].append(rows)
        return own, up

    def log(self, b, get):
        _, up = self._messages(b, get, lambda b, t: b.lse(t))
        return b.floor(up[self.root][0])

    def fill(self, b, get, u=None):
        join = (lambda b, t: b.lse(t)) if u is not None else (lambda b, t: b.where(t[1] > t[0], t[1], t[0]))
        own, _ = self._messages(b, get, join)
        lp = np.maximum(self.logp, FLOOR)
        value: dict[int, object] = {}
        for j in self.order:
            x, p = get(self.scope[j]), self.parent[j]
            pick = lambda k, j=j, p=p: own[j][k] + (b.const(lp[j, 0, k]) if p < 0 else b.where(value[p] == 1, b.const(lp[j, 1, k]), b.const(lp[j, 0, k])))
            one, zero = b.bind(pick(1)), b.bind(pick(0))
            b.flush()
            if u is None:
                new = b.where(one > zero, b.const(1.0), b.const(0.0))
            else:
                # P(1) = 1 / (1 + exp(zero - one)), with the exponent kept in range
                gap = b.where(zero - one > 700.0, b.const(700.0), zero - one)
                new = b.where(u(j) * (b.exp(gap) + 1) < 1, b.const(1.0), b.const(0.0))
            value[j] = b.bind(b.where(b.missing(x), new, x))
            b.flush()
        return {self.scope[j]: value[j] for j in range(len(self.scope))}

    def marginals(self) -> np.ndarray:
        """P(x_i = 1)."""
        p = np.zeros(len(self.scope))
        e = np.exp(self.logp)
        for j in self.order:
            q = self.parent[j]
            p[j] = e[j, 0, 1] if q < 0 else (1 - p[q]) * e[j, 0, 1] + p[q] * e[j, 1, 1]
        return p

    def moment(self, k):
        return self.marginals() if k else np.ones(len(self.scope))

    @property
    def n_params(self):
        d = len(self.scope)
        return 1 + d + 4 * d

    def params(self):
        return {"root": self.root, "tree": self.parent, "params": self.logp.tolist()}

    def em_init(self, rng):
        for j in range(len(self.scope)):
            p = rng.uniform(size=2)
            if self.parent[j] < 0:
                p[:] = p[0]
            self.logp[j] = np.log(np.stack([1 - p, p], 1))

    def em_update(self, s, step):
        """s: total s, s{i} = sum s x_i, s{i}_p = sum s x_i x_parent."""
        d, total = len(self.scope), s["s"]
        prior = np.array([(s[f"s{i}"] + 2 * EM_ALPHA) / (total + 4 * EM_ALPHA) for i in range(d)])
        for i in range(d):
            p = self.parent[i]
            if p < 0:
                one = np.array([prior[i], prior[i]])
            else:
                on = s[f"s{i}_p"]
                one = (np.array([s[f"s{i}"] - on, on]) + EM_ALPHA) / (total * np.array([1 - prior[p], prior[p]]) + 4 * EM_ALPHA)
            one = np.clip(one, 1e-12, 1 - 1e-12)
            new = (1 - step) * np.exp(self.logp[i]) + step * np.stack([1 - one, one], 1)
            self.logp[i] = np.log(new / new.sum(1, keepdims=True))


#: Leaves by name, for storing and loading; custom leaves are added here or given to `load`.
LEAVES = {c.__name__: c for c in (Bernoulli, Categorical, Isotonic, Uniform, Gaussian, ChowLiu)}


def tree_order(parent: list[int]) -> list[int]:
    """Positions breadth first from the root."""
    kids: dict[int, list[int]] = {}
    for j, p in enumerate(parent):
        kids.setdefault(p, []).append(j)
    if len(kids.get(-1, [])) != 1:
        raise ValueError("a tree has one root")
    out, queue = [], deque(kids[-1])
    while queue:
        j = queue.popleft()
        out.append(j)
        queue.extend(kids.get(j, []))
    if len(out) != len(parent):
        raise ValueError("not a tree")
    return out


def bfs(root: Node) -> Iterator[Node]:
    """Every node once, breadth first."""
    seen, queue = {id(root)}, deque([root])
    while queue:
        n = queue.popleft()
        yield n
        for c in n.children:
            if id(c) not in seen:
                seen.add(id(c))
                queue.append(c)


def post_order(root: Node) -> list[Node]:
    """Children before parents, depth first."""
    out, seen, stack = [], set(), [(root, iter(root.children))]
    seen.add(id(root))
    while stack:
        n, it = stack[-1]
        c = next((c for c in it if id(c) not in seen), None)
        if c is None:
            out.append(n)
            stack.pop()
        else:
            seen.add(id(c))
            stack.append((c, iter(c.children)))
    return out


def layers(root: Node) -> list[list[Node]] | None:
    """Topological layers from the root; None if there is a cycle."""
    nodes = list(bfs(root))
    wait = {id(n): 0 for n in nodes}
    for n in nodes:
        for c in n.children:
            wait[id(c)] += 1
    layer, out, done = [root] if wait[id(root)] == 0 else [], [], 0
    while layer:
        out.append(layer)
        done += len(layer)
        nxt = []
        for n in layer:
            for c in n.children:
                wait[id(c)] -= 1
                if wait[id(c)] == 0:
                    nxt.append(c)
        layer = nxt
    return out if done == len(nodes) else None


def topological(root: Node) -> list[Node] | None:
    found = layers(root)
    return None if found is None else [n for layer in found for n in layer]


def number(root: Node) -> Node:
    """Ids in topological order, 0 for the root."""
    order = topological(root)
    if order is None:
        raise ValueError("a circuit has no cycle")
    for i, n in enumerate(order):
        n.id = i
    return root


def statistics(root: Node) -> dict[str, int]:
    """Counts of nodes, edges and parameters, and the longest path."""
    nodes = list(bfs(root))
    depth: dict[int, int] = {}
    for n in post_order(root):
        depth[id(n)] = 1 + max(depth[id(c)] for c in n.children) if n.children else 0
    leaves = [n for n in nodes if isinstance(n, Leaf)]
    sums = [n for n in nodes if isinstance(n, Sum)]
    return {"n_nodes": len(nodes), "n_sum": len(sums), "n_prod": len(nodes) - len(sums) - len(leaves), "n_leaves": len(leaves), "n_edges": sum(len(n.children) for n in nodes), "n_params": sum(len(s.weights) for s in sums) + sum(x.n_params for x in leaves), "depth": depth[id(root)]}


def of_type(root: Node, *kinds: type) -> list[Node]:
    return [n for n in bfs(root) if isinstance(n, kinds)]
