"""Tensor models: randomised and spatial sum-product networks, and normalizing flows.

A model has `params` (name -> array) and `log_prob(p, x)` over a batch, written once with the derivative tape.
Parameters live on the driver and are broadcast; `score` maps partitions, `train` adds up the gradients of
partitions and steps an optimiser on the driver. NaN cells are summed out where the model allows it.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..functions.stats import balanced, classification_report, mean_quantiles_by
from ..functions.transforms import squeeze_order
from ..plans import tape as t
from ..plans.tape import Var
from ..sources.tables import shared_folder, stored

LOG2PI = math.log(2 * math.pi)

#: Rows that are scored together: what a network makes of them stays in the processor's cache.
ROWS = 128

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of counters (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) & _MASK
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed_uniforms(keys: np.ndarray, stream: int, n: int) -> np.ndarray:
    """(rows, n) numbers in [0, 1) from each row's 64-bit key and a stream's number: the same wherever a row is."""
    at = _mixed(np.arange(n, dtype=np.uint64) + _mixed(np.array([stream], np.uint64)))
    with np.errstate(over="ignore"):
        mixed = _mixed(np.asarray(keys).astype(np.int64).view(np.uint64)[:, None] + at[None])
    return (mixed >> np.uint64(11)).astype(float) * 2.0**-53


class Dropout:
    """Which nodes stay for a row in a step: a function of the row's key, the step and the layer only, so every partitioning
    and every retry draws the same."""

    def __init__(self, keys: np.ndarray, step: int):
        self.keys, self.step = keys, step

    def keep(self, layer: int, shape: Sequence[int], rate: float) -> np.ndarray:
        u = keyed_uniforms(self.keys, (self.step << 16) + layer, int(np.prod(shape)))
        return (u >= rate).reshape(len(self.keys), *shape)

    def inputs(self, x: Var, layer: int, rate: float, axis: int) -> Var:
        """Inputs of sums along axis, dropped ones at log 0; where all would go, all stay."""
        stay = self.keep(layer, x.shape[1:], rate)
        stay |= ~stay.any(axis, keepdims=True)
        return x + np.where(stay, 0.0, -np.inf)


class Model:
    """params, log_prob(p, x) -> Var (rows, classes), constrain()."""

    params: dict[str, np.ndarray]
    classes = 1
    in_dropout: float | None = None
    sum_dropout: float | None = None
    drop: Dropout | None = None

    def log_prob(self, p: dict[str, Var], x: np.ndarray) -> Var:
        raise NotImplementedError

    def constrain(self) -> None:
        """Bring parameters back into their range after a step."""

    def batch_layers(self) -> dict[str, object]:
        """Layers that normalise by the moments of a training batch, by the prefix of their parameters."""
        return {}

    def couplings(self) -> dict[str, object]:
        """Layers with batch layers inside them, by the prefix of their parameters."""
        return {}

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Log likelihoods (rows, classes), block by block."""
        p = {k: Var(v) for k, v in self.params.items()}
        with t.values_only():
            return np.concatenate([self.log_prob(p, x[k : k + ROWS]).v for k in range(0, max(1, len(x)), ROWS)])

    def loss(self, p: dict[str, Var], x: np.ndarray, y: np.ndarray | None) -> Var:
        """Negative log likelihood, or cross entropy of the classes' posteriors; summed over rows."""
        ll = self.log_prob(p, x)
        if y is None:
            return -(ll.sum() if self.classes == 1 else t.lse(ll, 1).sum())
        return -(ll[np.arange(len(y)), y.astype(int)] - t.lse(ll, 1)).sum()

    def gradients(self, x: np.ndarray, y: np.ndarray | None, drop: Dropout | None = None, batch: bool = False) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients. drop: masks of this step. batch: x is one batch, by whose moments layers normalise; these come
        back, times the rows, in place of the moments' gradients."""
        p = {k: Var(v) for k, v in self.params.items()}
        layers = self.batch_layers() if batch else {}
        for layer in layers.values():
            layer.record = {}
        self.drop = drop
        try:
            out = self.loss(p, x, y)
            seen = {f"{k}.{m}": v * len(x) for k, layer in layers.items() for m, v in layer.record.items()}
            t.backward(out)  # parts of it may run the layers again
        finally:
            self.drop = None
            for layer in layers.values():
                layer.record = None
        return float(out.v), {k: np.zeros_like(v.v) if v.g is None else v.g for k, v in p.items()} | seen


def _rate(rate: float | None) -> float | None:
    if rate is not None and not 0 < rate < 1:
        raise ValueError("a dropout rate is between 0 and 1")
    return rate


# --- leaves of tensor networks -------------------------------------------------------------------------------------


class TensorLeaf:
    """A family of densities of one variable whose parameters are arrays of one shape. A subclass of one's own serves as
    `leaf` of RatSpn and DgcSpn."""

    def start(self, shape: tuple[int, ...], rng: np.random.Generator, place) -> dict[str, np.ndarray]:
        """First parameters. place(table) brings a (batch, variables) table into the shape."""
        raise NotImplementedError

    def log_prob(self, p: dict[str, Var], v: Var) -> Var:
        """v broadcasts against the parameters."""
        raise NotImplementedError

    def mode(self, p: dict[str, np.ndarray]) -> np.ndarray:
        raise NotImplementedError

    def sample(self, p: dict[str, np.ndarray], uniforms) -> np.ndarray:
        """uniforms() gives fresh numbers in [0, 1) of the parameters' shape."""
        raise NotImplementedError

    def constrain(self, p: dict[str, np.ndarray]) -> None:
        """Bring parameters back into their range, in place."""


class GaussianLeaf(TensorLeaf):
    """loc: None for standard normal starts, (a, b) for uniform ones, or a table (batch, variables), for example of
    `mean_quantile_table`. scale: `ones` or `random` at the start and trained along, or `fixed` at 1."""

    def __init__(self, loc: np.ndarray | tuple[float, float] | None = None, scale: str = "ones"):
        if scale not in ("ones", "random", "fixed"):
            raise ValueError("scale is ones, random or fixed")
        if isinstance(loc, tuple) and not loc[0] < loc[1]:
            raise ValueError("a uniform range is a pair (a, b) with a < b")
        self.loc, self.scale = loc, scale

    def start(self, shape, rng, place):
        if self.loc is None:
            loc = rng.normal(0, 1, shape)
        elif isinstance(self.loc, tuple):
            loc = rng.uniform(*self.loc, shape)
        else:
            loc = np.array(place(np.asarray(self.loc, float)))
        out = {"loc": loc}
        if self.scale != "fixed":
            out["scale"] = np.ones(shape) if self.scale == "ones" else 0.5 + 0.1 * np.tanh(rng.normal(size=shape))
        return out

    def log_prob(self, p, v):
        if "scale" not in p:
            z = v - p["loc"]
            return -0.5 * (z * z) - 0.5 * LOG2PI
        z = (v - p["loc"]) / p["scale"]
        return -0.5 * (z * z) - t.log(p["scale"]) - 0.5 * LOG2PI

    def mode(self, p):
        return p["loc"]

    def sample(self, p, uniforms):
        u, w = uniforms(), uniforms()
        return p["loc"] + p.get("scale", 1.0) * np.sqrt(-2 * np.log(1 - u)) * np.cos(2 * np.pi * w)

    def constrain(self, p):
        if "scale" in p:
            p["scale"] = np.maximum(p["scale"], 1e-5)


class BernoulliLeaf(TensorLeaf):
    def start(self, shape, rng, place):
        return {"logit": rng.normal(0, 0.5, shape)}

    def log_prob(self, p, v):
        return v * p["logit"] - t.softplus(p["logit"])

    def mode(self, p):
        return (p["logit"] >= 0).astype(float)

    def sample(self, p, uniforms):
        return (uniforms() < 1 / (1 + np.exp(-p["logit"]))).astype(float)


def _leaf(leaf: str | TensorLeaf) -> TensorLeaf:
    if isinstance(leaf, TensorLeaf):
        return leaf
    if leaf not in ("gaussian", "bernoulli"):
        raise ValueError("leaves are gaussian, bernoulli or a TensorLeaf")
    return GaussianLeaf() if leaf == "gaussian" else BernoulliLeaf()


def mean_quantile_table(df: DataFrame, cols: Sequence[str], batch: int) -> np.ndarray:
    """(batch, variables) means of the `batch` quantile chunks of every numeric column, or of every cell of one array
    column: starts for the locations of leaves."""
    first = df.select(*cols).first()
    if first is not None and len(cols) == 1 and isinstance(first[0], list):
        long = df.select(F.posexplode(cols[0]).alias("var", "value"))
    else:
        pairs = F.array(*[F.struct(F.lit(i).alias("var"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
        long = df.select(F.explode(pairs).alias("k")).select("k.var", "k.value")
    rows = mean_quantiles_by(long.withColumn("value", F.col("value").cast("double")), "var", "value", batch).collect()
    out = np.empty((batch, 1 + max(r["var"] for r in rows)))
    for r in rows:
        out[r["chunk"], r["var"]] = r["mean"]
    return out


# --- randomised sum-product networks -------------------------------------------------------------------------------


def region_graph(n: int, depth: int, repetitions: int, seed: int = 42) -> list[list[tuple[int, ...]]]:
    """Leaf regions of each repetition: the variables halved at random `depth` times."""
    if not 1 <= depth <= int(math.log2(max(n, 1))):
        raise ValueError("depth is 1 to log2 of the number of variables")
    rng, out = np.random.default_rng(seed), []
    for _ in range(repetitions):
        regions = [tuple(range(n))]
        for _ in range(depth):
            nxt = []
            for r in regions:
                order = [r[i] for i in rng.permutation(len(r))]
                nxt += [tuple(order[: len(r) // 2]), tuple(order[len(r) // 2 :])]
            regions = nxt
        out.append(regions)
    return out


class RatSpn(Model):
    """Random region graph with tensor layers: `batch` leaf distributions for each region, products of sibling
    regions, `sums` sums for each, one root for each class over all repetitions."""

    def __init__(self, n: int, classes: int = 1, depth: int = 2, repetitions: int = 4, batch: int = 4, sums: int = 4, leaf: str | TensorLeaf = "gaussian", in_dropout: float | None = None, sum_dropout: float | None = None, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.n, self.classes, self.depth, self.repetitions, self.leaf = n, classes, depth, repetitions, _leaf(leaf)
        self.in_dropout, self.sum_dropout = _rate(in_dropout), _rate(sum_dropout)
        flat = [r for regions in region_graph(n, depth, repetitions, seed) for r in regions]
        width = max(map(len, flat))
        self.index = np.array([[*r, *[r[-1]] * (width - len(r))] for r in flat])
        self.real = np.array([[1.0] * len(r) + [0.0] * (width - len(r)) for r in flat])
        shape = (len(flat), batch, width)
        self.params = self.leaf.start(shape, rng, lambda table: table[:, self.index].transpose(1, 0, 2))
        self.leaf_names = list(self.params)
        size = batch
        for k in range(depth - 1, 0, -1):
            self.params[f"sum{k}"] = rng.normal(0, 0.5, (repetitions * 2**k, sums, size * size))
            size = sums
        self.params["root"] = rng.normal(0, 0.5, (classes, repetitions * size * size))

    def leaves(self, p: dict[str, Var], x: np.ndarray) -> Var:
        """(rows, regions, batch): sums over a region's variables, hidden ones and padding left out."""
        if isinstance(x, Var):  # a flow's base: nothing is hidden, and gradients pass through the values
            v = x[:, self.index].reshape(len(x.v), len(self.index), 1, self.index.shape[1])
            there = self.real[None, :, None, :]
        else:
            v = x[:, self.index][:, :, None, :]
            there = (~np.isnan(v)) * self.real[None, :, None, :]
            v = Var(np.nan_to_num(v))
        ll = self.leaf.log_prob({k: p[k] for k in self.leaf_names}, v)
        if self.drop is not None and self.in_dropout:  # a dropped leaf is summed out
            there = there * self.drop.keep(0, ll.shape[1:], self.in_dropout)
        return (ll * there).sum(3)

    def layers(self, p: dict[str, Var], x: np.ndarray) -> list[Var]:
        """Node values from the leaves to the flattened children of the root."""
        out = [self.leaves(p, x)]
        for k in range(self.depth - 1, -1, -1):
            h = out[-1]
            a, b = h[:, 0::2], h[:, 1::2]
            n, r, s = a.shape
            prod = (a.reshape(n, r, s, 1) + b.reshape(n, r, 1, s)).reshape(n, r, s * s)
            out.append(prod)
            if k:
                w = t.log_softmax(p[f"sum{k}"], 2)
                if self.drop is not None and self.sum_dropout:
                    prod = self.drop.inputs(prod, k, self.sum_dropout, 2)
                out.append(t.lse(prod.reshape(n, r, 1, s * s) + w, 3))
        return out

    def log_prob(self, p, x):
        top = self.layers(p, x)[-1]
        flat = top.reshape(top.shape[0], 1, -1)
        return t.lse(flat + t.log_softmax(p["root"], 1), 2)

    def constrain(self):
        own = {k: self.params[k] for k in self.leaf_names}
        self.leaf.constrain(own)
        self.params |= own

    def complete(self, x: np.ndarray, y: np.ndarray | None = None, uniforms=None) -> np.ndarray:
        """Fill NaN cells: greatest branches and modes, or a sample where uniforms(k) gives numbers for each row."""
        p = {k: Var(v) for k, v in self.params.items()}
        values = [v.v for v in self.layers(p, x)]
        rows = np.arange(len(x))
        at = iter(range(10**6))

        def choose(scores: np.ndarray) -> np.ndarray:
            if uniforms is None:
                return scores.argmax(1)
            e = np.exp(scores - scores.max(1, keepdims=True))
            return (np.cumsum(e, 1) / e.sum(1, keepdims=True) <= uniforms(next(at))[:, None]).sum(1).clip(0, scores.shape[1] - 1)

        soft = lambda w, axis: w - np.log(np.exp(w - w.max(axis, keepdims=True)).sum(axis, keepdims=True)) - w.max(axis, keepdims=True)
        w = soft(self.params["root"], 1)
        cls = np.zeros(len(x), int) if y is None else y.astype(int)
        top = values.pop()
        pick = choose(top.reshape(len(x), -1) + w[cls])
        size = top.shape[2]
        # nodes: (row, region) -> the product node chosen there
        chosen = {r: (pick // size == r, pick % size) for r in range(top.shape[1])}
        active = np.stack([c[0] for c in chosen.values()], 1)
        node = np.stack([c[1] for c in chosen.values()], 1)
        for k in range(1, self.depth + 1):
            half = values[-1].shape[2]
            active = np.repeat(active, 2, 1)
            node = np.stack([node // half, node % half], 2).reshape(len(x), -1)
            if k == self.depth:
                break
            values.pop()
            prod = values.pop()
            ws = soft(self.params[f"sum{k}"], 2)
            nxt = np.zeros_like(node)
            for r in range(node.shape[1]):
                nxt[:, r] = choose(prod[:, r] + ws[r][node[:, r]])
            node = nxt
        out = x.copy()
        for r in range(len(self.index)):
            for i, var in enumerate(self.index[r]):
                if not self.real[r, i]:
                    continue
                fill = active[:, r] & np.isnan(x[:, var])
                own = {k: self.params[k][r, node[:, r], i] for k in self.leaf_names}
                v = self.leaf.mode(own) if uniforms is None else self.leaf.sample(own, lambda: uniforms(next(at)))
                out[fill, var] = v[fill]
        return out[rows]


# --- deep generalised convolutional sum-product networks -----------------------------------------------------------


class DgcSpn(Model):
    """Leaves for each pixel, then layers of 2 x 2 products (dilated by 1, 2, 4, ..., or with stride 2 for the first
    `pooling` ones) and location-wise sums; one root for each class over the locations of the last products, all of which
    cover the whole image. Padding adds log 1, that is, nothing.

    depthwise: products of one channel at four places (True), or of any four channels (False), for all layers or for each
    (the last holds for the rest). `products` channel tuples are then drawn, all of them are taken if None. Channels of a
    pixel are independent under a leaf; completions need Gaussian leaves."""

    def __init__(
        self, channels: int, height: int, width: int, classes: int = 1, batch: int = 4, sums: int = 4, pooling: int = 0, depthwise: bool | Sequence[bool] = True,
        products: int | None = None, leaf: str | TensorLeaf = "gaussian", in_dropout: float | None = None, sum_dropout: float | None = None, seed: int = 42,
    ):
        if height != width:
            raise ValueError("images are square")
        self.depth = max(1, math.ceil(math.log2(height)))
        kinds = [depthwise] if isinstance(depthwise, bool) else list(depthwise)
        if not 1 <= len(kinds) <= self.depth + 1:
            raise ValueError("one to ceil(log2(height)) + 1 kinds of products")
        if not 0 <= pooling <= self.depth:
            raise ValueError("pooling is 0 to ceil(log2(height))")
        rng = np.random.default_rng(seed)
        self.shape, self.classes, self.pooling, self.leaf = (channels, height, width), classes, pooling, _leaf(leaf)
        self.in_dropout, self.sum_dropout = _rate(in_dropout), _rate(sum_dropout)
        self.params = self.leaf.start((batch, *self.shape), rng, lambda table: table.reshape(len(table), *self.shape))
        self.leaf_names = list(self.params)
        kinds += [kinds[-1]] * (self.depth + 1 - len(kinds))
        h, size, self.tuples = height, batch, []
        for k in range(self.depth + 1):
            self.tuples.append(None if kinds[k] else self._tuples(size, products, rng))
            size = size if kinds[k] else len(self.tuples[k])
            d = 2 ** max(0, k - pooling)
            h = -(-h // 2) if k < pooling else d if k == self.depth else h + d
            if k < self.depth:
                self.params[f"sum{k}"] = rng.normal(0, 0.5, (sums, size, h, h))
                size = sums
        self.params["root"] = rng.normal(0, 0.5, (classes, size * h * h))

    @staticmethod
    def _tuples(channels: int, products: int | None, rng: np.random.Generator) -> np.ndarray:
        """(tuples, 4): the channel at each corner; without repeats."""
        every = channels**4
        at = np.arange(every) if products is None or products >= every else np.sort(rng.choice(every, products, replace=False))
        return np.stack([at // channels**k % channels for k in (3, 2, 1, 0)], 1)

    def leaves(self, p: dict[str, Var], x: np.ndarray | Var) -> Var:
        if isinstance(x, Var):  # a flow's base: nothing is hidden
            v, there = x.reshape(x.shape[0], 1, *self.shape), np.ones((1, 1, *self.shape))
        else:
            v = x.reshape(len(x), 1, *self.shape)
            there = ~np.isnan(v)
            v = Var(np.nan_to_num(v))
        ll = self.leaf.log_prob({k: p[k] for k in self.leaf_names}, v)
        if self.drop is not None and self.in_dropout:
            there = there * self.drop.keep(0, ll.shape[1:], self.in_dropout)
        return (ll * there).sum(2)

    def products(self, h: Var, k: int) -> Var:
        """Sum of the four logs at the corners of dilated squares (or of 2 x 2 blocks)."""
        s, ids = h.shape[2], self.tuples[k]
        if k < self.pooling:
            h = t.pad(h, ((0, 0), (0, 0), (0, s % 2), (0, s % 2)))
            corners = [h[:, :, i::2, j::2] for i in (0, 1) for j in (0, 1)]
        else:
            d = 2 ** (k - self.pooling)
            final = k == self.depth
            h = t.pad(h, ((0, 0), (0, 0), *[(0, 2 * d - s) if final else (d, d)] * 2))
            m = d if final else s + d
            corners = [h[:, :, i : i + m, j : j + m] for i in (0, d) for j in (0, d)]
        if ids is not None:
            corners = [t.pick(c, ids[:, i]) for i, c in enumerate(corners)]
        return corners[0] + corners[1] + corners[2] + corners[3]

    def top(self, p: dict[str, Var], leaves: Var) -> Var:
        h = leaves
        for k in range(self.depth + 1):
            h = self.products(h, k)
            if k < self.depth:
                w = t.log_softmax(p[f"sum{k}"], 1)
                if self.drop is not None and self.sum_dropout:
                    h = self.drop.inputs(h, k + 1, self.sum_dropout, 1)
                n, c, s, _ = h.shape
                h = t.lse(h.reshape(n, 1, c, s, s) + w, 2)
        flat = h.reshape(h.shape[0], 1, -1)
        return t.lse(flat + t.log_softmax(p["root"], 1), 2)

    def log_prob(self, p, x):
        return self.top(p, self.leaves(p, x))

    def constrain(self):
        own = {k: self.params[k] for k in self.leaf_names}
        self.leaf.constrain(own)
        self.params |= own

    def complete(self, x: np.ndarray) -> np.ndarray:
        """Hidden pixels by the leaves' modes, weighted by the derivatives of the log likelihood by the leaves."""
        p = {k: Var(v) for k, v in self.params.items()}
        leaves = self.leaves(p, x)
        leaves.parents = ()
        out = self.top(p, leaves)
        t.backward(t.lse(out, 1).sum() if self.classes > 1 else out.sum())
        share = leaves.g / np.maximum(leaves.g.sum(1, keepdims=True), 1e-30)
        modes = self.leaf.mode({k: self.params[k] for k in self.leaf_names})
        mean = np.einsum("nbhw,bchw->nchw", share, modes).reshape(x.shape)
        return np.where(np.isnan(x), mean, x)


# --- normalizing flows ---------------------------------------------------------------------------------------------


def standard_normal(u: Var) -> Var:
    return (-0.5 * (u * u) - 0.5 * LOG2PI).sum(1)


class Uniform(Model):
    """Base of a flow: independent, uniform between low and high."""

    def __init__(self, n: int, low: float, high: float):
        if not low < high:
            raise ValueError("low is below high")
        self.n, self.low, self.high, self.params = n, low, high, {}

    def log_prob(self, p, u):
        u = t.as_var(u)
        inside = ((u.v >= self.low) & (u.v <= self.high)).all(1)
        return Var(np.where(inside, -self.n * math.log(self.high - self.low), -np.inf)[:, None])

    def pathwise(self, p, uniforms: np.ndarray) -> Var:
        return Var(self.low + (self.high - self.low) * uniforms[:, : self.n])


class Normal(Model):
    """Base of a flow: independent, with trained locations and log scales."""

    def __init__(self, n: int):
        self.n, self.params = n, {"loc": np.zeros(n), "log_scale": np.zeros(n)}

    def log_prob(self, p, u):
        z = (t.as_var(u) - p["loc"]) * t.exp(-t.as_var(p["log_scale"]))
        return (-0.5 * (z * z) - p["log_scale"] - 0.5 * LOG2PI).sum(1)

    def pathwise(self, p, uniforms: np.ndarray) -> Var:
        return p["loc"] + t.exp(p["log_scale"]) * box_muller(uniforms, self.n)


def box_muller(uniforms: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) standard normal numbers from (rows, 2 n) uniform ones."""
    return np.sqrt(-2 * np.log(1 - uniforms[:, :n])) * np.cos(2 * np.pi * uniforms[:, n : 2 * n])


def part(p: dict, prefix: int | str) -> dict:
    """The parameters under a prefix, without it."""
    head = f"{prefix}."
    return {name[len(head) :]: v for name, v in p.items() if name.startswith(head)}


def joined(parts: dict) -> dict[str, np.ndarray]:
    """Parameters of parts, by prefix."""
    return {f"{k}.{name}": v for k, x in parts.items() for name, v in x.params.items()}


def batch_layers(parts: dict) -> dict[str, object]:
    """Layers with batch moments among parts and their parts, by prefix."""
    out = {}
    for k, x in parts.items():
        if hasattr(x, "record"):
            out[str(k)] = x
        out |= {f"{k}.{name}": y for name, y in batch_layers(getattr(x, "parts", {})).items()}
    return out


def with_batch_layers(parts: dict) -> dict[str, object]:
    """Couplings whose networks have batch layers, among parts and their parts, by prefix."""
    out = {}
    for k, x in parts.items():
        own = getattr(x, "parts", {})
        out |= {str(k): x} if hasattr(x, "given") and batch_layers(own) else {f"{k}.{name}": y for name, y in with_batch_layers(own).items()}
    return out


def both(forward):
    """forward(p, u) on the tape, which also takes and then gives plain arrays."""

    def run(self, p, u):
        out = forward(self, {k: t.as_var(v) for k, v in p.items()}, t.as_var(u))
        return out if isinstance(u, Var) else out.v

    return run


class Chain:
    """Layers one after the other, data side first."""

    def __init__(self, layers: Sequence):
        self.parts = dict(enumerate(layers))
        self.params = joined(self.parts)

    def back(self, p, x):
        total = Var(np.zeros(x.shape[0]))
        for k, layer in self.parts.items():
            x, ld = layer.back(part(p, k), x)
            total = total + ld
        return x, total

    @both
    def forward(self, p, u):
        for k in reversed(self.parts):
            u = self.parts[k].forward(part(p, k), u)
        return u


class Flow(Model):
    """Chain of bijectors from data to a base density. Layers give back(p, x) -> (u, log |det|) and forward(p, u) -> x, both
    on the tape. A base model is trained along: its parameters are named `base.`, and it takes values on the tape.
    dequantize: bits of whole levels scaled to [0, 1], which go to the middle of their cells first; logit: then the logit
    of alpha + (1 - 2 alpha) x."""

    def __init__(self, n: int, layers: list, base: Model | None = None, dequantize: int | None = None, logit: float | None = None):
        if logit is not None and not 0 < logit < 1:
            raise ValueError("the logit factor is between 0 and 1")
        self.n, self.layers, self.base = n, layers, base
        ends = [] if dequantize is None else [Dequantize(n, dequantize)]
        self.before = Chain(ends if logit is None else [*ends, LogitLayer(n, logit)])
        self.params = joined(dict(enumerate(layers)))
        self.params |= {f"base.{name}": v for name, v in base.params.items()} if base else {}

    def constrain(self):
        if self.base is not None:
            self.base.params = part(self.params, "base")
            self.base.constrain()
            self.params |= {f"base.{name}": v for name, v in self.base.params.items()}

    def batch_layers(self):
        return batch_layers(dict(enumerate(self.layers)))

    def couplings(self):
        return with_batch_layers(dict(enumerate(self.layers)))

    def preprocess(self, x: np.ndarray | Var) -> tuple[Var, Var]:
        """Data to what the first layer takes, with the log determinant."""
        return self.before.back({}, t.as_var(x))

    def unpreprocess(self, x: np.ndarray | Var) -> np.ndarray | Var:
        return self.before.forward({}, x)

    def back(self, p: dict[str, Var], x: np.ndarray | Var) -> tuple[Var, Var]:
        u, total = self.preprocess(x)
        for k, layer in enumerate(self.layers):
            u, ld = layer.back(part(p, k), u)
            total = total + ld
        return u, total

    def log_prob(self, p, x):
        u, total = self.back(p, x)
        base = standard_normal(u) if self.base is None else self.base.log_prob(part(p, "base"), u).reshape(-1)
        return (base + total).reshape(-1, 1)

    def forward(self, u: np.ndarray | Var, p: dict | None = None) -> np.ndarray | Var:
        p = self.params if p is None else p
        for k in range(len(self.layers) - 1, -1, -1):
            u = self.layers[k].forward(part(p, k), u)
        return self.unpreprocess(u)

    def pathwise(self, p: dict[str, Var], uniforms: np.ndarray) -> Var:
        """Samples on the tape as functions of the parameters: uniforms (rows, 2 n). The base must have a pathwise form."""
        if self.base is None:
            u = Var(box_muller(uniforms, self.n))
        elif hasattr(self.base, "pathwise"):
            u = self.base.pathwise(part(p, "base"), uniforms)
        else:
            raise NotImplementedError("the base has no pathwise samples")
        return self.forward(u, p)

    def sample(self, keys: np.ndarray, seed: int = 42) -> np.ndarray:
        """One sample for each key; bases without a pathwise form draw through their own branches."""
        if self.base is None or hasattr(self.base, "pathwise"):
            return self.pathwise({k: Var(v) for k, v in self.params.items()}, keyed_uniforms(keys, seed, 2 * self.n)).v
        self.base.params = part(self.params, "base")
        u = self.base.complete(np.full((len(keys), self.n), np.nan), uniforms=lambda k: keyed_uniforms(keys, (seed << 16) + k, 1)[:, 0])
        return self.forward(u)


class Expectation(Model):
    """Mean of f(samples) of a flow, by common uniform numbers for each key: its gradients are pathwise. f: Var -> Var (rows)."""

    def __init__(self, flow: Flow, f, seed: int = 42):
        self.flow, self.f, self.seed, self.params = flow, f, seed, flow.params

    def loss(self, p, x, y):
        return self.f(self.flow.pathwise(p, keyed_uniforms(x[:, 0].astype(np.int64), self.seed, 2 * self.flow.n))).sum()


def expectation(df: DataFrame, flow: Flow, f, key: str, seed: int = 42) -> tuple[float, dict[str, np.ndarray]]:
    """Mean of f over one sample of the flow for each key (whole numbers up to 2**53), and its gradients."""
    total, n, grads = _gradient_sums(df.select(F.col(key).cast("double").alias(key)), Expectation(flow, f, seed), [key], None)
    return total / max(1, n), {k: g / max(1, n) for k, g in grads.items()}


def draw(df: DataFrame, flow: Flow, key: str, out: str = "sample", seed: int = 42) -> DataFrame:
    """df with an array column: one sample of the flow for each row's key, the same under any partitioning."""
    shared = Shared(df, flow)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{out}` array<double>"])

    def run(batches):
        for b in batches:
            x = shared.value.sample(b["__key"].to_numpy(), seed) if len(b) else ()
            yield b.drop(columns="__key").assign(**{out: list(x)})

    return df.withColumn("__key", F.xxhash64(key)).mapInPandas(run, schema)


def _net(rng, sizes: Sequence[int]) -> dict[str, np.ndarray]:
    out = {}
    for k, (a, b) in enumerate(zip(sizes[:-1], sizes[1:], strict=True)):
        out[f"w{k}"], out[f"b{k}"] = rng.normal(0, 1 / math.sqrt(a), (a, b)), np.zeros(b)
    return out


def _apply(p: dict, x, masks: list | None = None):
    depth = sum(k.startswith("w") and k[1:].isdigit() for k in p)
    for k in range(depth):
        w = t.as_var(p[f"w{k}"])
        x = t.as_var(x) @ (w * masks[k] if masks else w) + p[f"b{k}"]
        if k < depth - 1:
            x = t.relu(x)
    return x


class Coupling:
    """Half of the variables passes; the other half is shifted (and scaled, if affine) by a network of the first."""

    def __init__(self, n: int, reverse: bool, affine: bool = True, hidden: Sequence[int] = (32,), seed: int = 42):
        self.mask = ((np.arange(n) + int(reverse)) % 2 == 0) * 1.0
        self.n, self.affine = n, affine
        self.params = _net(np.random.default_rng(seed), [n, *hidden, n * (2 if affine else 1)])
        if affine:
            self.params["gain"] = np.zeros(n)

    def _st(self, p, x):
        z = _apply(p, t.as_var(x) * self.mask)
        free = 1 - self.mask
        if not self.affine:
            return None, z * free
        return t.as_var(p["gain"]) * t.tanh(z[:, self.n :]) * free, z[:, : self.n] * free

    def back(self, p, x):
        s, shift = self._st(p, x)
        return ((x - shift), Var(np.zeros(x.shape[0]))) if s is None else ((x - shift) * t.exp(-s), -(s.sum(1)))

    @both
    def forward(self, p, u):
        s, shift = self._st(p, u)
        return u + shift if s is None else u * t.exp(s) + shift


class Autoregressive:
    """Masked network: each variable is shifted and scaled by those before it in the order of the degrees."""

    def __init__(self, n: int, reverse: bool = False, hidden: Sequence[int] = (32,), sequential: bool = True, seed: int = 42):
        rng = np.random.default_rng(seed)
        first = np.arange(n)[::-1] if reverse else np.arange(n)
        degrees = [first]
        for units in hidden:
            degrees.append(np.arange(units) % max(1, n - 1) if sequential else rng.integers(0, max(1, n - 1), units))
        self.masks = [(a[:, None] <= b[None, :]) * 1.0 for a, b in zip(degrees[:-1], degrees[1:], strict=True)]
        last = (degrees[-1][:, None] < first[None, :]) * 1.0
        self.masks.append(np.hstack([last, last]))
        self.n, self.order = n, np.argsort(first)
        self.params = _net(rng, [n, *hidden, 2 * n]) | {"gain": np.zeros(n)}

    def _st(self, p, x):
        z = _apply(p, x, self.masks)
        return t.as_var(p["gain"]) * t.tanh(z[:, self.n :]), z[:, : self.n]

    def back(self, p, x):
        s, shift = self._st(p, x)
        return (x - shift) * t.exp(-s), -(s.sum(1))

    @both
    def forward(self, p, u):
        x = Var(np.zeros(u.shape))
        for i in self.order:
            s, shift = self._st(p, x)
            x = x + (u * t.exp(s) + shift) * np.eye(self.n)[i]
        return x


class Taken(Exception):
    """A layer has what it was asked for: what follows it need not run."""


def batch_moments(layer, p: dict, x: Var) -> tuple[Var, Var]:
    """Mean and variance of x (rows, channels, cells) by channel: the batch's own while the layer records, else those kept."""
    if layer.taken is not None:
        layer.taken["x"] = np.concatenate([layer.taken["x"], x.v]) if "x" in layer.taken else x.v
        if "stop" in layer.taken:
            raise Taken
    if layer.record is None:
        return t.as_var(p["mean"]).reshape(1, -1, 1), t.as_var(p["var"]).reshape(1, -1, 1)
    share = 1 / (x.shape[0] * x.shape[2])
    mean = x.sum((0, 2), keepdims=True) * share
    d = x - mean
    var = (d * d).sum((0, 2), keepdims=True) * share
    layer.record = {"mean": mean.v.ravel(), "var": var.v.ravel()}
    return mean, var


class BatchNorm:
    """Normalisation with learned gain and shift, a bijector. In a training step the moments are those of the batch, and
    gradients pass through them; in use they are running means of training, or those of `set_moments`. cells: of each
    channel, whose moments are common to them (an image of n = channels * cells values)."""

    record: dict | None = None
    taken: dict | None = None

    def __init__(self, n: int, eps: float = 1e-5, cells: int = 1):
        self.eps, self.cells = eps, cells
        c = n // cells
        self.params = {"g": np.zeros(c), "b": np.zeros(c), "mean": np.zeros(c), "var": np.ones(c)}

    def set_moments(self, mean: np.ndarray, var: np.ndarray) -> None:
        self.params |= {"mean": np.asarray(mean, float), "var": np.asarray(var, float)}

    def back(self, p, x):
        z = x.reshape(x.shape[0], -1, self.cells)
        mean, var = batch_moments(self, p, z)
        g, b = (t.as_var(p[k]).reshape(1, -1, 1) for k in "gb")
        u = (z - mean) * (var + self.eps) ** -0.5 * t.exp(g) + b
        ld = (g - 0.5 * t.log(var + self.eps)).sum() * self.cells
        return u.reshape(x.shape[0], -1), ld + np.zeros(x.shape[0])

    @both
    def forward(self, p, u):
        g, b, mean, var = (p[k].reshape(1, -1, 1) for k in ("g", "b", "mean", "var"))
        x = (u.reshape(u.shape[0], -1, self.cells) - b) * t.exp(-g) * (var + self.eps) ** 0.5 + mean
        return x.reshape(u.shape[0], -1)


class Dequantize:
    """Whole levels 0 .. 2^bits - 1, scaled to [0, 1], to a point of their cell (its middle unless noise is given)."""

    params: dict = {}

    def __init__(self, n: int, bits: int = 8):
        self.n, self.levels = n, 2**bits

    def back(self, p, x, noise: np.ndarray | float = 0.5):
        return (x * (self.levels - 1) + noise) * (1 / self.levels), Var(np.full(x.shape[0], self.n * math.log((self.levels - 1) / self.levels)))

    @both
    def forward(self, p, u):
        return t.clip(t.floor(u * self.levels), 0, self.levels - 1) * (1 / (self.levels - 1))


class LogitLayer:
    params: dict = {}

    def __init__(self, n: int, alpha: float = 0.05):
        self.n, self.alpha = n, alpha

    def back(self, p, x):
        y = x * (1 - 2 * self.alpha) + self.alpha
        a, b = t.log(y), t.log(1 - y)
        return a - b, -((a + b).sum(1)) + self.n * math.log(1 - 2 * self.alpha)

    @both
    def forward(self, p, u):
        return (t.sigmoid(u) - self.alpha) * (1 / (1 - 2 * self.alpha))


def nice(n: int, couplings: int = 4, hidden: Sequence[int] = (32,), seed: int = 42) -> Flow:
    return Flow(n, [Coupling(n, bool(k % 2), False, hidden, seed + k) for k in range(couplings)])


def realnvp(n: int, couplings: int = 4, hidden: Sequence[int] = (32,), batch_norm: bool = False, seed: int = 42, base: Model | None = None, **ends) -> Flow:
    layers: list = []
    for k in range(couplings):
        layers += [Coupling(n, bool(k % 2), True, hidden, seed + k)] + ([BatchNorm(n)] if batch_norm else [])
    return Flow(n, layers, base, **ends)


def maf(n: int, layers: int = 3, hidden: Sequence[int] = (32,), sequential: bool = True, batch_norm: bool = False, seed: int = 42, base: Model | None = None, **ends) -> Flow:
    out: list = []
    for k in range(layers):
        out += [Autoregressive(n, bool(k % 2), hidden, sequential, seed + k)] + ([BatchNorm(n)] if batch_norm else [])
    return Flow(n, out, base, **ends)


def _conv(p: dict, name: str, x: Var) -> Var:
    """3 x 3 convolution with zero padding; x (rows, channels, h, w)."""
    w = t.as_var(p[name])
    n, c, h, wd = x.shape
    out = t.patches(x.moved(1, 3), 3).reshape(n * h * wd, 9 * c) @ w.reshape(9 * c, -1) + p[name + "b"]
    return out.reshape(n, h, wd, -1).moved(3, 1)


class ImageCoupling:
    """Coupling of image channels or of a checkerboard, by a residual or a densely connected convolution network."""

    def __init__(self, c: int, h: int, w: int, mode: str = "checkerboard", reverse: bool = False, filters: int = 8, blocks: int = 1, net: str = "resnet", seed: int = 42):
        rng = np.random.default_rng(seed)
        self.shape, self.blocks, self.net = (c, h, w), blocks, net
        if mode == "checkerboard":
            m = (np.add.outer(np.arange(h), np.arange(w)) + int(reverse)) % 2 == 0
            self.mask = np.broadcast_to(m, (c, h, w)) * 1.0
        else:
            m = (np.arange(c) < c // 2) != reverse
            self.mask = np.broadcast_to(m[:, None, None], (c, h, w)) * 1.0
        conv = lambda a, b: rng.normal(0, 1 / math.sqrt(9 * a), (3, 3, a, b))
        self.params = {"in": conv(c, filters), "inb": np.zeros(filters), "gain": np.zeros((c, h, w))}
        size = filters
        for k in range(blocks):
            grow = filters
            self.params |= {f"r{k}": conv(size, grow), f"r{k}b": np.zeros(grow), f"s{k}": conv(grow, grow), f"s{k}b": np.zeros(grow)}
            size = size + grow if net == "densenet" else filters
        self.params |= {"out": conv(size, 2 * c), "outb": np.zeros(2 * c)}

    def _network(self, p, img: Var) -> Var:
        z = t.relu(_conv(p, "in", img))
        for k in range(self.blocks):
            step = _conv(p, f"s{k}", t.relu(_conv(p, f"r{k}", z)))
            z = t.concat([z, t.relu(step)], 1) if self.net == "densenet" else t.relu(z + step)
        return _conv(p, "out", z)

    def _st(self, p, x: Var):
        c, h, w = self.shape
        z = t.recomputed(self._network, p, x.reshape(x.shape[0], c, h, w) * self.mask)
        free = 1 - self.mask
        s = t.as_var(p["gain"]) * t.tanh(z[:, c:]) * free
        return s.reshape(x.shape[0], -1), (z[:, :c] * free).reshape(x.shape[0], -1)

    def back(self, p, x):
        s, shift = self._st(p, x)
        return (x - shift) * t.exp(-s), -(s.sum(1))

    @both
    def forward(self, p, u):
        s, shift = self._st(p, u)
        return u * t.exp(s) + shift


class Rearrange:
    """Fixed permutation of the flat cells."""

    params: dict = {}

    def __init__(self, order: Sequence[int]):
        self.order, self.inverse = np.asarray(order), np.argsort(order)

    def back(self, p, x):
        return t.permute(x, self.order), Var(np.zeros(x.shape[0]))

    @both
    def forward(self, p, u):
        return t.permute(u, self.inverse)


def realnvp_images(c: int, h: int, w: int, filters: int = 8, blocks: int = 1, net: str = "resnet", seed: int = 42) -> Flow:
    """Checkerboard couplings, squeeze, channel couplings."""
    layers: list = [ImageCoupling(c, h, w, "checkerboard", bool(k % 2), filters, blocks, net, seed + k) for k in range(3)]
    layers.append(Rearrange(squeeze_order(c, h, w)))
    layers += [ImageCoupling(4 * c, h // 2, w // 2, "channels", bool(k % 2), filters, blocks, net, seed + 10 + k) for k in range(3)]
    return Flow(c * h * w, layers)


# --- optimisers and training ---------------------------------------------------------------------------------------


class Optimizer:
    """sgd, rmsprop, adagrad or adam over a dictionary of arrays."""

    def __init__(self, name: str = "adam", rate: float = 1e-2):
        if name not in ("sgd", "rmsprop", "adagrad", "adam"):
            raise ValueError(f"unknown optimiser {name}")
        self.name, self.rate, self.k, self.m, self.v = name, rate, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.k += 1
        for n, g in grads.items():
            m, v = self.m.get(n, 0.0), self.v.get(n, 0.0)
            if self.name == "sgd":
                move = g
            elif self.name == "rmsprop":
                self.v[n] = v = 0.99 * v + 0.01 * g * g
                move = g / (np.sqrt(v) + 1e-8)
            elif self.name == "adagrad":
                self.v[n] = v = v + g * g
                move = g / (np.sqrt(v) + 1e-10)
            else:
                self.m[n], self.v[n] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                move = (m / (1 - 0.9**self.k)) / (np.sqrt(v / (1 - 0.999**self.k)) + 1e-8)
            params[n] = params[n] - self.rate * move


class EarlyStopping:
    """Best state so far; stop after `patience` losses that are not lower by `delta`."""

    def __init__(self, patience: int = 5, delta: float = 1e-3):
        self.patience, self.delta, self.best, self.state, self.bad = patience, delta, math.inf, None, 0

    def __call__(self, loss: float, params: dict) -> bool:
        if loss < self.best - self.delta:
            self.best, self.state, self.bad = loss, copy.deepcopy(params), 0
        else:
            self.bad += 1
        return self.bad >= self.patience


class RunningAverage:
    """Mean of means, weighted by their counts."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.total, self.n = 0.0, 0

    def __call__(self, value: float, n: int) -> None:
        self.total, self.n = self.total + value * n, self.n + n

    def average(self) -> float:
        if not self.n:
            raise ZeroDivisionError("no value yet")
        return self.total / self.n


def dirichlet(shape: Sequence[int], dim: int = -1, alpha: float = 1.0, log_space: bool = True, seed: int = 42) -> np.ndarray:
    """Random (log) weights that sum to 1 along dim."""
    if not -len(shape) <= dim < len(shape):
        raise IndexError("dim is out of range")
    x = np.random.default_rng(seed).gamma(alpha, size=shape)
    x = x / x.sum(axis=dim, keepdims=True)
    return np.log(x) if log_space else x


def _matrix(p: pd.DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Rows of numeric columns, or of one array column."""
    if len(cols) == 1 and len(p) and not np.isscalar(p[cols[0]].iloc[0]):
        return np.stack(p[cols[0]].to_numpy()).astype(float)
    return p[list(cols)].to_numpy(dtype=float, na_value=np.nan)


def score(df: DataFrame, model: Model, cols: Sequence[str], out: str = "ll") -> DataFrame:
    """Adds the log likelihood (of a mixture of classes where there are several: out_0, out_1, ...)."""
    shared = Shared(df, model)
    names = [out] if model.classes == 1 else [f"{out}_{k}" for k in range(model.classes)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` double" for n in names])

    def run(batches):
        for p in batches:
            s = shared.value.scores(_matrix(p, cols)) if len(p) else np.zeros((0, len(names)))
            yield p.assign(**{n: s[:, k] for k, n in enumerate(names)})

    return df.mapInPandas(run, schema)


def encode(df: DataFrame, flow: Flow, cols: Sequence[str], log_det: str = "log_det") -> DataFrame:
    """cols replaced by their values under the flow's base density, with the log determinant."""
    shared = Shared(df, flow)
    schema = ", ".join([f"`{f.name}` " + ("double" if f.name in cols else f.dataType.simpleString()) for f in df.schema] + [f"`{log_det}` double"])

    def run(batches):
        for p in batches:
            own = shared.value
            u, ld = own.back({k: Var(v) for k, v in own.params.items()}, _matrix(p, cols))
            yield p.assign(**{c: u.v[:, i] for i, c in enumerate(cols)}, **{log_det: ld.v.reshape(-1)})

    return df.mapInPandas(run, schema)


def decode(df: DataFrame, flow: Flow, cols: Sequence[str]) -> DataFrame:
    """The inverse of encode: values of the base density back to data."""
    shared = Shared(df, flow)
    schema = ", ".join(f"`{f.name}` " + ("double" if f.name in cols else f.dataType.simpleString()) for f in df.schema)

    def run(batches):
        for p in batches:
            x = shared.value.forward(_matrix(p, cols))
            yield p.assign(**{c: x[:, i] for i, c in enumerate(cols)})

    return df.mapInPandas(run, schema)


def complete(df: DataFrame, model, cols: Sequence[str], key: str | None = None, draw: bool = False, seed: int = 42, label: str | None = None) -> DataFrame:
    """Hidden cells filled by the model; sampled by the row's key if draw."""
    import hashlib

    shared = Shared(df, model)
    schema = ", ".join(f"`{f.name}` " + ("double" if f.name in cols else f.dataType.simpleString()) for f in df.schema)

    def run(batches):
        for p in batches:
            x = _matrix(p, cols)
            if draw:
                u = lambda k, keys=p[key]: np.array([int(hashlib.md5(f"{seed}|{r}|{k}".encode()).hexdigest()[:8], 16) / 2**32 for r in keys])
                x = shared.value.complete(x, p[label].to_numpy() if label else None, u)
            else:
                x = shared.value.complete(x, p[label].to_numpy()) if label else shared.value.complete(x)
            yield p.assign(**{c: x[:, i] for i, c in enumerate(cols)})

    return df.mapInPandas(run, schema)


class Shared:
    """A model sent to the executors once, with the classes and functions that a user's session defines."""

    def __init__(self, df: DataFrame, model: Model):
        self.sent, self.made = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model)), None

    def __getstate__(self):
        return {"sent": self.sent, "made": None}

    @property
    def value(self) -> Model:
        if self.made is None:
            self.made = pickle.loads(self.sent.value)
        return self.made


#: Partials that meet in one task: above it, they are added up by branches of tasks first.
FAN = 128


def _blocks(batches, size: int):
    """Frames of at most `size` rows; of a table with groups, whole groups, cut after `size` rows where over twice that are
    left. Groups come together and in order, so blocks don't depend on how rows come in."""
    left = None
    for p in batches:
        if "__group" not in p.columns:
            for k in range(0, len(p), size):
                yield p.iloc[k : k + size]
            continue
        p = p if left is None else pd.concat([left, p], ignore_index=True)
        ends = np.flatnonzero(np.diff(p["__group"].to_numpy())) + 1
        starts = [0, *ends]
        for a, b in zip(starts, [*ends, len(p)], strict=True):
            while b - a > 2 * size:
                yield p.iloc[a : a + size]
                a += size
            if b < len(p):
                yield p.iloc[a:b]
            else:
                left = p.iloc[a:b]
    if left is not None and len(left):
        yield left


def _training_table(df: DataFrame, model: Model, cols: Sequence[str], label: str | None, key: str | None, group: int) -> DataFrame:
    """What a step reads: columns and label; for dropout each row's hash; for batch moments the rows in groups of about
    `group`, drawn by hash and laid out once, so each step is one pass without a shuffle."""
    hashed = F.xxhash64(key) if key else F.xxhash64(*cols)
    more = [hashed.alias("__row")] if model.in_dropout or model.sum_dropout or model.batch_layers() else []
    own = df.select(*dict.fromkeys([*cols, *([label] if label else []), *([key] if key else [])]), *more)
    if not model.batch_layers():
        return own
    n = own.count()
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism, n // 100_000)
    own = own.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(max(1, round(n / group)))))
    laid = own.repartition(parts, "__group").sortWithinPartitions("__group", "__row")
    # a checkpoint keeps the partitions as they are laid out; a table's files would be split anew
    return laid.cache() if shared_folder(df.sparkSession) is None else laid.checkpoint()


def _gradient_sums(df: DataFrame, model: Model, cols: Sequence[str], label: str | None, with_gradients: bool = True, step: int = 0, block: int = 512) -> tuple[float, int, dict[str, np.ndarray]]:
    """Loss, rows and gradients summed over partitions; the sums meet element by element on the executors, by branches of
    FAN tasks first. Columns __row and __group, where there, give dropout its keys and batch moments their batches."""
    shared = Shared(df, model)

    def part(batches):
        loss, n, total = 0.0, 0, None
        m = shared.value
        for q in _blocks(batches, block):
            x, y = _matrix(q, cols), q[label].to_numpy() if label else None
            if with_gradients:
                drop = Dropout(q["__row"].to_numpy(), step) if m.in_dropout or m.sum_dropout else None
                one, g = m.gradients(x, y, drop, "__group" in q.columns) if drop or "__group" in q.columns else m.gradients(x, y)
                flat = np.concatenate([g[name].ravel() for name in sorted(g)]) if g else np.empty(0)
                total = flat if total is None else total + flat
            else:
                with t.values_only():
                    one = float(m.loss({a: Var(b) for a, b in m.params.items()}, x, y).v)
            loss, n = loss + one, n + len(q)
        values = np.concatenate(([loss, n], np.empty(0) if total is None else total))
        if n:
            branch = TaskContext.get().partitionId() // FAN
            yield pd.DataFrame({"at": np.arange(-(-len(values) // 4096)), "branch": branch, "values": np.split(values, range(4096, len(values), 4096))})

    def add(p):
        return pd.DataFrame({"at": p["at"].iloc[:1], "branch": p["branch"].iloc[:1], "values": [np.sum(p["values"].to_list(), axis=0)]})

    schema = "at long, branch long, values array<double>"
    there = [c for c in ("__row", "__group") if c in df.columns]
    made = df.select(*cols, *([label] if label else []), *there).mapInPandas(part, schema)
    if df.sparkSession.sparkContext._jsc is not None and df.rdd.getNumPartitions() > FAN:
        made = made.groupBy("at", "branch").applyInPandas(add, schema)
    rows = made.groupBy("at").applyInPandas(add, schema).toPandas().sort_values("at")
    flat = np.concatenate(rows["values"].to_list()) if len(rows) else np.zeros(2)
    out, at = {}, 2
    for name in sorted(model.params) if with_gradients and len(flat) > 2 else ():
        size = model.params[name].size
        out[name] = flat[at : at + size].reshape(model.params[name].shape)
        at += size
    return float(flat[0]), int(flat[1]), out


def _resumed(m: Model, done: Sequence[str]):
    """Runs the model on blocks of rows up to where a layer has what it was asked for. Settled couplings aren't run again:
    rows then hold, in `__state`, what the last of them made, and the others pass on what they get."""
    p, couplings, state = {k: Var(v) for k, v in m.params.items()}, m.couplings(), [None]
    for name in done:
        couplings[name].given = (lambda x: Var(state[0])) if name == done[-1] else (lambda x: x)

    def run(layer, x: np.ndarray) -> np.ndarray:
        state[0], layer.taken = x, {"stop": True}
        try:
            with t.values_only():
                m.log_prob(p, np.zeros((len(x), m.n)) if done else x)
        except Taken:
            pass
        return layer.taken["x"]

    return run


def settle_moments(df: DataFrame, model: Model, cols: Sequence[str]) -> None:
    """Moments of all batch layers set to those of the whole table, layer after layer: each pass sums what comes into one
    layer, with the layers before it settled. One job for each layer. What a coupling with such layers inside makes of the
    rows is a checkpoint of its own, so no pass runs more than one coupling's network."""
    couplings, done, inside = list(model.couplings()), [], None
    rows, own, folder = df.select(*cols), list(cols), shared_folder(df.sparkSession)
    for name, layer in model.batch_layers().items():
        now = next((c for c in couplings if name.startswith(f"{c}.")), None)
        if inside is not None and now != inside:
            shared = Shared(df, model)

            def along(batches, name=inside, shared=shared, own=own, done=tuple(done)):
                m = shared.value
                run, found = _resumed(m, done), m.couplings()[name]
                for q in _blocks(batches, ROWS):
                    yield pd.DataFrame({"__state": list(run(found, _matrix(q, own)))})

            made = rows.mapInPandas(along, "__state array<double>")
            rows = made.localCheckpoint() if folder is None else made.checkpoint()
            done, own = [*done, inside], ["__state"]
        inside = now
        shared = Shared(df, model)
        c = len(model.params[f"{name}.mean"])

        def part(batches, name=name, shared=shared, c=c, own=own, done=tuple(done)):
            m, sums, n = shared.value, np.zeros((2, c)), 0
            centre = m.params[f"{name}.mean"]
            run, found = _resumed(m, done), m.batch_layers()[name]
            for q in _blocks(batches, ROWS):
                z = run(found, _matrix(q, own)) - centre[None, :, None]
                sums += np.stack([z.sum((0, 2)), (z * z).sum((0, 2))])
                n += z.shape[0] * z.shape[2]
            if n:
                yield pd.DataFrame({"channel": np.arange(c), "n": n, "a": sums[0], "b": sums[1]})

        made = rows.mapInPandas(part, "channel int, n long, a double, b double")
        sums = made.groupBy("channel").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas().sort_values("channel")
        if len(sums):
            mean = (sums["a"] / sums["n"]).to_numpy()
            old = model.params[f"{name}.mean"]
            model.params[f"{name}.mean"], model.params[f"{name}.var"] = old + mean, (sums["b"] / sums["n"]).to_numpy() - mean**2


def train(
    df: DataFrame, model: Model, cols: Sequence[str], label: str | None = None, valid: DataFrame | None = None, epochs: int = 20, rate: float = 1e-2, optimizer: str = "adam",
    patience: int = 5, share: float | None = None, key: str | None = None, seed: int = 42, group: int = 256, momentum: float = 0.9,
) -> list[dict[str, float]]:
    """Gradient training in place: one job for each step; the best state by validation (or training) loss is kept.
    share: of the rows, drawn by key, for each step. key: also names rows for dropout (else their values do).
    Models with batch moments see batches of about `group` rows; moments kept for use are running means over the steps, with
    the bias of their start removed, and at the end those of the whole table."""
    opt, stop, history = Optimizer(optimizer, rate), EarlyStopping(patience), []
    table = _training_table(df, model, cols, label, key, group)
    kept = {f"{k}.{m}" for k in model.batch_layers() for m in ("mean", "var")}
    running: dict[str, np.ndarray] = {}
    steps = 0
    for e in range(epochs):
        batch = table if share is None else table.where(uniform(f"{seed}-{e}", key) < share)
        loss, n, grads = _gradient_sums(batch, model, cols, label, step=e, block=group if kept else 512)
        if not n:
            continue
        steps += 1
        for k in kept:
            running[k] = momentum * running.get(k, 0.0) + (1 - momentum) * grads.pop(k) / n
            model.params[k] = running[k] / (1 - momentum**steps)
        entry = {"epoch": e, "train_loss": loss / n}
        if valid is not None:
            v, m, _ = _gradient_sums(valid, model, cols, label, False)
            entry["valid_loss"] = v / max(1, m)
        history.append(entry)
        if stop(entry.get("valid_loss", entry["train_loss"]), model.params):
            break
        opt.step(model.params, {k: g / n for k, g in grads.items()})
        model.constrain()
    if stop.state is not None:
        model.params = stop.state
    if kept:
        settle_moments(table, model, cols)
        table.unpersist()
    return history


def test(df: DataFrame, model: Model, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Mean log likelihood with two standard errors, or a confusion table of labels and predicted classes."""
    scored = score(df, model, cols)
    if label is None:
        return scored.agg(F.avg("ll").alias("mean_ll"), (2 * F.stddev_pop("ll") / F.sqrt(F.count(F.lit(1)))).alias("two_se"))
    return _predicted(df, model, cols).groupBy(F.col(label).alias("actual"), "predicted").agg(F.count(F.lit(1)).alias("n"))


def _predicted(df: DataFrame, model: Model, cols: Sequence[str]) -> DataFrame:
    """df with the class of greatest likelihood."""
    best = F.greatest(*[F.col(f"ll_{k}") for k in range(model.classes)])
    return score(df, model, cols).withColumn("predicted", F.coalesce(*[F.when(F.col(f"ll_{k}") == best, k) for k in range(model.classes)]))


def test_model(df: DataFrame, model: Model, cols: Sequence[str], label: str) -> tuple[float, float, DataFrame]:
    """Mean negative log likelihood of the labels given the cells with its standard error, and the report of `test_classes`,
    from one scoring."""
    scored = _predicted(df, model, cols)
    terms = [F.col(f"ll_{k}") for k in range(model.classes)]
    top = F.greatest(*terms)
    total = top + F.ln(balanced([F.exp(x - top) for x in terms]))
    own = F.coalesce(*[F.when(F.col(label) == k, x) for k, x in enumerate(terms)])
    kept = stored(scored.withColumn("__nll", total - own), "scores")
    r = kept.agg(F.avg("__nll").alias("m"), (F.stddev_pop("__nll") / F.sqrt(F.count("__nll"))).alias("s")).first()
    return r["m"], r["s"], classification_report(kept, label, "predicted")


def test_classes(df: DataFrame, model: Model, cols: Sequence[str], label: str) -> DataFrame:
    """Precision, recall and F1 of each class, accuracy and averages (`stats.classification_report`)."""
    return classification_report(_predicted(df, model, cols), label, "predicted")
