"""A small reverse-mode derivative tape over NumPy, for kernels that run inside tasks.

Only what the tensor models need: arithmetic with broadcasting, matrix products, exponentials, sums, and indexing.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

import numpy as np

_KEPT = [True]


@contextmanager
def values_only():
    """No steps are kept within: values go as soon as nothing needs them, and there are no gradients."""
    before, _KEPT[0] = _KEPT[0], False
    try:
        yield
    finally:
        _KEPT[0] = before


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """Sum a gradient over the axes that broadcasting added."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


class Var:
    """A value with the steps that made it."""

    __array_priority__ = 100

    def __init__(self, v, parents=()):
        self.v, self.parents, self.g = np.asarray(v, float), parents if _KEPT[0] else (), None

    @property
    def shape(self):
        return self.v.shape

    def __add__(self, o):
        o = as_var(o)
        return Var(self.v + o.v, [(self, lambda g: _fit(g, self.shape)), (o, lambda g: _fit(g, o.shape))])

    __radd__ = __add__

    def __neg__(self):
        return Var(-self.v, [(self, lambda g: -g)])

    def __sub__(self, o):
        return self + -as_var(o)

    def __rsub__(self, o):
        return as_var(o) + -self

    def __mul__(self, o):
        o = as_var(o)
        return Var(self.v * o.v, [(self, lambda g: _fit(g * o.v, self.shape)), (o, lambda g: _fit(g * self.v, o.shape))])

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self * as_var(o) ** -1.0

    def __pow__(self, k: float):
        return Var(self.v**k, [(self, lambda g: g * k * self.v ** (k - 1))])

    def __matmul__(self, o):
        o = as_var(o)
        t = lambda a: np.swapaxes(a, -1, -2)
        return Var(self.v @ o.v, [(self, lambda g: _fit(g @ t(o.v), self.shape)), (o, lambda g: _fit(t(self.v) @ g, o.shape))])

    def __getitem__(self, at):
        plain = all(isinstance(k, int | slice) for k in (at if isinstance(at, tuple) else (at,)))

        def back(g):
            out = np.zeros_like(self.v)
            if plain:  # no place comes twice
                out[at] = g
            else:
                np.add.at(out, at, g)
            return out

        return Var(self.v[at], [(self, back)])

    def reshape(self, *shape):
        return Var(self.v.reshape(*shape), [(self, lambda g: g.reshape(self.shape))])

    def moved(self, a: int, b: int):
        return Var(np.moveaxis(self.v, a, b), [(self, lambda g: np.moveaxis(g, b, a))])

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            return np.broadcast_to(g, self.shape)

        return Var(self.v.sum(axis=axis, keepdims=keepdims), [(self, back)])


def as_var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _unary(x: Var, v: np.ndarray, slope: Callable[[], np.ndarray]) -> Var:
    """slope: worked out when it is needed, not held."""
    return Var(v, [(x, lambda g: g * slope())])


def exp(x):
    v = np.exp(x.v)
    return _unary(x, v, lambda: v)


def log(x):
    return _unary(x, np.log(x.v), lambda: 1 / x.v)


def tanh(x):
    v = np.tanh(x.v)
    return _unary(x, v, lambda: 1 - v * v)


def relu(x):
    return _unary(x, np.maximum(x.v, 0), lambda: x.v > 0)


def sigmoid(x):
    v = 1 / (1 + np.exp(-np.clip(x.v, -500, 500)))
    return _unary(x, v, lambda: v * (1 - v))


def softplus(x):
    return _unary(x, np.logaddexp(0, x.v), lambda: 1 / (1 + np.exp(-np.clip(x.v, -500, 500))))


def lse(x: Var, axis: int) -> Var:
    """log sum exp; -inf rows stay -inf with zero slope."""
    top = np.max(x.v, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    e = np.exp(x.v - top)
    s = e.sum(axis, keepdims=True)
    with np.errstate(divide="ignore"):
        v = (np.log(s) + top).squeeze(axis)
    share = e / np.where(s > 0, s, 1.0)
    return Var(v, [(x, lambda g: np.expand_dims(g, axis) * share)])


def log_softmax(x: Var, axis: int) -> Var:
    return x - Var_expand(lse(x, axis), axis)


def Var_expand(x: Var, axis: int) -> Var:
    return Var(np.expand_dims(x.v, axis), [(x, lambda g: g.squeeze(axis))])


def concat(xs: list[Var], axis: int) -> Var:
    cuts = np.cumsum([x.shape[axis] for x in xs])[:-1]
    return Var(np.concatenate([x.v for x in xs], axis), [(x, lambda g, i=i: np.split(g, cuts, axis)[i]) for i, x in enumerate(xs)])


def permute(x: Var, order: np.ndarray) -> Var:
    """Columns of a matrix in another order."""
    inverse = np.argsort(order)
    return Var(x.v[:, order], [(x, lambda g: g[:, inverse])])


def pick(x: Var, ids: np.ndarray) -> Var:
    """Channels by number, repeats allowed: axis 1."""

    def back(g):
        out = np.zeros_like(x.v)
        for c in range(x.shape[1]):
            out[:, c] = g[:, ids == c].sum(1)
        return out

    return Var(x.v[:, ids], [(x, back)])


def floor(x: Var) -> Var:
    """Steps: no slope."""
    return Var(np.floor(x.v))


def clip(x: Var, low: float, high: float) -> Var:
    return _unary(x, np.clip(x.v, low, high), lambda: (x.v >= low) & (x.v <= high))


def pad(x: Var, widths, value: float = 0.0) -> Var:
    inner = tuple(slice(a, a + n) for (a, _), n in zip(widths, x.shape, strict=True))
    return Var(np.pad(x.v, widths, constant_values=value), [(x, lambda g: g[inner])])


def patches(x: Var, size: int) -> Var:
    """(n, h, w, c) to (n, h, w, size * size * c): the square of odd size around each cell, row by row, zeros outside."""
    n, h, w, c = x.shape
    r = size // 2
    padded = np.pad(x.v, ((0, 0), (r, r), (r, r), (0, 0)))
    at = [(k, slice(k // size, k // size + h), slice(k % size, k % size + w)) for k in range(size * size)]
    out = np.empty((n, h, w, size * size, c))
    for k, i, j in at:
        out[:, :, :, k] = padded[:, i, j]

    def back(g):
        total, g = np.zeros((n, h + 2 * r, w + 2 * r, c)), g.reshape(n, h, w, size * size, c)
        for k, i, j in at:
            total[:, i, j] += g[:, :, :, k]
        return total[:, r : r + h, r : r + w]

    return Var(out.reshape(n, h, w, -1), [(x, back)])


def standardised(x: Var, eps: float) -> tuple[Var, np.ndarray, np.ndarray]:
    """(rows, channels, cells) less each channel's mean, by the root of its variance and eps; mean and variance."""
    share = 1 / (x.shape[0] * x.shape[2])
    mean = x.v.sum((0, 2), keepdims=True) * share
    u = x.v - mean
    var = np.einsum("rck,rck->c", u, u)[None, :, None] * share
    low = (var + eps) ** -0.5
    u *= low

    def back(g):
        out = g - g.sum((0, 2), keepdims=True) * share
        out -= u * (np.einsum("rck,rck->c", g, u)[None, :, None] * share)
        out *= low
        return out

    return Var(u, [(x, back)]), mean.ravel(), var.ravel()


def recomputed(f: Callable, p: dict, x: Var) -> Var:
    """f(p, x), keeping its inputs and result only: the steps between are made again for the gradients, so one such part
    at a time is held."""
    fresh = lambda: ({k: Var(as_var(v).v) for k, v in p.items()}, Var(x.v))
    with values_only():
        v = f(*fresh()).v
    found: dict = {}

    def slopes(g):
        q, y = fresh()
        backward(f(q, y), g)
        found.update({k: np.zeros_like(a.v) if a.g is None else a.g for k, a in q.items()})
        return np.zeros_like(y.v) if y.g is None else y.g

    return Var(v, [(x, slopes), *[(a, lambda g, k=k: found.pop(k)) for k, a in p.items() if isinstance(a, Var)]])


def backward(out: Var, seed: np.ndarray | float = 1.0) -> None:
    """Sets g on the leaves that out depends on; the g of steps between goes once it was passed on."""
    order, seen = [], set()
    stack = [(out, False)]
    while stack:
        x, done = stack.pop()
        if done:
            order.append(x)
        elif id(x) not in seen:
            seen.add(id(x))
            stack.append((x, True))
            stack.extend((p, False) for p, _ in x.parents)
    out.g = np.broadcast_to(np.asarray(seed, float), out.shape).copy()
    for x in reversed(order):
        for p, f in x.parents if x.g is not None else ():
            step = f(x.g)
            p.g = step if p.g is None else p.g + step  # never changed in place: views of one another may stand here
        if x.parents:
            x.g = None
