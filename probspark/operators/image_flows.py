"""Normalizing flows for images at several scales.

A level passes the image through checkerboard couplings, squeezes it, passes it through channel couplings, then keeps half of
the channels at half the width for the next level and gives the others out as they are. Conditioners are residual or densely
connected convolution networks whose kernels have a length and a direction each (weight normalisation). Batches'
moments normalise inside networks and between couplings; see `tensors.train`.

Layers take and give flat cells, as those of `tensors`; networks take images (rows, channels, height, width) on the tape.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from ..functions.transforms import squeeze_order
from ..plans import tape as t
from ..plans.tape import Var
from .tensors import BatchNorm, Chain, Flow, Model, Taken, batch_moments, both, joined, part


class Convolution:
    """Square kernel of odd size with zero padding. Each output channel's kernel is its length `g` times the direction of `v`;
    lengths start at that of `v`."""

    def __init__(self, a: int, b: int, size: int = 3, bias: bool = True, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(42)
        self.size = size
        v = rng.normal(0, 1 / math.sqrt(size * size * a), (size * size * a, b))
        self.params = {"v": v, "g": np.sqrt((v * v).sum(0))} | ({"b": np.zeros(b)} if bias else {})

    def __call__(self, p: dict, x: Var) -> Var:
        v = t.as_var(p["v"])
        w = v * ((v * v).sum(0) ** -0.5 * p["g"])
        n, c, h, wd = x.shape
        flat = x.moved(1, 3)
        if self.size > 1:
            flat = t.patches(flat, self.size)
        out = flat.reshape(n * h * wd, -1) @ w
        if "b" in p:
            out = out + p["b"]
        return out.reshape(n, h, wd, -1).moved(3, 1)


class Norm:
    """Batch normalisation of channels inside a network."""

    record: dict | None = None
    taken: dict | None = None

    def __init__(self, c: int, eps: float = 1e-5):
        self.eps = eps
        self.params = {"w": np.ones(c), "b": np.zeros(c), "mean": np.zeros(c), "var": np.ones(c)}

    def __call__(self, p: dict, x: Var) -> Var:
        n, c, h, w = x.shape
        z = x.reshape(n, c, h * w)
        gain, shift = (t.as_var(p[k]).reshape(1, -1, 1) for k in "wb")
        if self.record is not None:
            u, mean, var = t.standardised(z, self.eps)
            self.record = {"mean": mean, "var": var}
            return (u * gain + shift).reshape(n, c, h, w)
        mean, var = batch_moments(self, p, z)
        gain = gain * (var + self.eps) ** -0.5
        return (z * gain + (shift - mean * gain)).reshape(n, c, h, w)


class _Parts:
    """A network of named parts, each with its own parameters."""

    def __init__(self, parts: dict):
        self.parts, self.params = parts, joined(parts)

    def run(self, p: dict, name: str, x: Var) -> Var:
        return self.parts[name](part(p, name), x)

    def active(self, p: dict, name: str, x: Var) -> Var:
        """Normalised (where there is a norm), cut at 0, then the convolution of that name."""
        x = self.run(p, f"{name}_norm", x) if f"{name}_norm" in self.parts else x
        return self.run(p, name, t.relu(x))


class _Maker:
    """Convolutions with a norm before them, by name."""

    def __init__(self, norm: bool, seed: int):
        self.norm, self.rng, self.parts = norm, np.random.default_rng(seed), {}

    def plain(self, name: str, a: int, b: int, size: int, bias: bool = False) -> None:
        self.parts[name] = Convolution(a, b, size, bias, self.rng)

    def active(self, name: str, a: int, b: int, size: int, bias: bool = False) -> None:
        if self.norm:
            self.parts[f"{name}_norm"] = Norm(a)
        self.plain(name, a, b, size, bias)


class Residual(_Parts):
    """Blocks of two 3 x 3 convolutions added to their input; the output gathers all of them through 1 x 1 skips."""

    def __init__(self, a: int, filters: int, b: int, blocks: int, norm: bool = True, seed: int = 42):
        self.blocks = blocks
        m = _Maker(norm, seed)
        m.plain("in", a, filters, 3)
        m.plain("skip", filters, filters, 1, True)
        for k in range(blocks):
            m.active(f"one{k}", filters, filters, 3)
            m.active(f"two{k}", filters, filters, 3)
            m.plain(f"skip{k}", filters, filters, 1, True)
        m.active("out", filters, b, 1, True)
        super().__init__(m.parts)

    def __call__(self, p, x):
        x = self.run(p, "in", x)
        total = self.run(p, "skip", x)
        for k in range(self.blocks):
            x = x + self.active(p, f"two{k}", self.active(p, f"one{k}", x))
            total = total + self.run(p, f"skip{k}", x)
        return self.active(p, "out", total)


class Dense(_Parts):
    """Blocks of `layers` layers, each over all outputs before it in the block through a 1 x 1 bottleneck of four times
    its width; 1 x 1 transitions between blocks and to the output."""

    def __init__(self, a: int, filters: int, b: int, blocks: int, norm: bool = True, layers: int = 4, seed: int = 42):
        self.blocks, self.layers = blocks, layers
        m = _Maker(norm, seed)
        m.plain("in", a, filters, 3)
        for k in range(blocks):
            for j in range(layers):
                m.active(f"neck{k}_{j}", (1 + j) * filters, 4 * filters, 1)
                m.active(f"grow{k}_{j}", 4 * filters, filters, 3)
            last = k == blocks - 1
            m.active(f"pass{k}", (1 + layers) * filters, b if last else filters, 1, last)
        super().__init__(m.parts)

    def __call__(self, p, x):
        x = self.run(p, "in", x)
        for k in range(self.blocks):
            seen = [x]
            for j in range(self.layers):
                seen.append(self.active(p, f"grow{k}_{j}", self.active(p, f"neck{k}_{j}", t.concat(seen, 1))))
            x = self.active(p, f"pass{k}", t.concat(seen, 1))
        return x


#: Networks by name: (channels in, filters, channels out, blocks, norm, seed) -> network.
NETWORKS: dict[str, Callable] = {
    "resnet": lambda a, filters, b, blocks, norm, seed: Residual(a, filters, b, blocks, norm, seed=seed),
    "densenet": lambda a, filters, b, blocks, norm, seed: Dense(a, filters, b, blocks, norm, seed=seed),
}


class Coupling2d:
    """Some cells pass, the others are shifted (and scaled, if affine) by a network of those: cells of one colour of a
    checkerboard, or the second half of the channels (the first, if reverse). network: called with (parameters, image), of
    as many channels as pass; gives shifts, then as many scales. While moments are settled, `given` stands in for a settled
    coupling, and `taken` gets what one makes of its input."""

    given: Callable[[Var], Var] | None = None
    taken: dict | None = None

    def __init__(self, c: int, h: int, w: int, network, channels: bool = False, reverse: bool = False, affine: bool = True):
        if channels and c % 2:
            raise ValueError("channel couplings need an even number of channels")
        self.shape, self.channels, self.reverse, self.affine = (c, h, w), channels, reverse, affine
        self.parts = {"net": network}
        self.params = joined(self.parts)
        if affine:
            self.params["gain"] = np.zeros(c // 2 if channels else c)
        # the first colour passes where row + column is odd
        self.mask = ((np.add.outer(np.arange(h), np.arange(w)) % 2 == 1) != reverse) * 1.0

    def _halves(self, img: Var) -> tuple[Var, Var]:
        """Of the channels: those that pass, those that move."""
        c = self.shape[0] // 2
        first, second = img[:, :c], img[:, c:]
        return (first, second) if self.reverse else (second, first)

    def _st(self, p, passing: Var) -> tuple[Var | None, Var]:
        z = t.recomputed(self.parts["net"], part(p, "net"), passing)
        free = 1.0 if self.channels else 1 - self.mask
        if not self.affine:
            return None, z * free
        c = z.shape[1] // 2
        s = t.as_var(p["gain"]).reshape(1, -1, 1, 1) * t.tanh(z[:, c:])
        return s * free, z[:, :c] * free

    def _moved(self, p, x: Var, step) -> tuple[Var, Var]:
        img = x.reshape(x.shape[0], *self.shape)
        passing, moving = self._halves(img) if self.channels else (img * self.mask, img)
        s, shift = self._st(p, passing)
        out = step(moving, s, shift)
        if self.channels:
            out = t.concat([passing, out] if self.reverse else [out, passing], 1)
        ld = Var(np.zeros(x.shape[0])) if s is None else -(s.reshape(x.shape[0], -1).sum(1))
        return out.reshape(x.shape[0], -1), ld

    def back(self, p, x):
        if self.given is not None:
            return self.given(x), Var(np.zeros(x.shape[0]))
        u, ld = self._moved(p, x, lambda v, s, shift: v - shift if s is None else (v - shift) * t.exp(-s))
        if self.taken is not None:
            self.taken["x"] = u.v
            raise Taken
        return u, ld

    @both
    def forward(self, p, u):
        return self._moved(p, u, lambda v, s, shift: v + shift if s is None else v * t.exp(s) + shift)[0]


class _Order:
    """Cells in another fixed order."""

    params: dict = {}

    def __init__(self, order):
        self.order = np.asarray(order)
        self.inverse = np.argsort(self.order)

    def back(self, p, x):
        return t.permute(x, self.order), Var(np.zeros(x.shape[0]))

    @both
    def forward(self, p, u):
        return t.permute(u, self.inverse)


def scale_order(c: int, h: int, w: int) -> list[int]:
    """Positions in a (c, h, w) image of the cells of its (4c, h/2, w/2) form: the channels of both cells on the diagonal of
    2 x 2 blocks come first, upper left then lower right; then those of the upper right and of the lower left."""
    return [k * h * w + (2 * y + dy) * w + 2 * x + dx for dy, dx in ((0, 0), (1, 1), (0, 1), (1, 0)) for k in range(c) for y in range(h // 2) for x in range(w // 2)]


class Split:
    """The first `n` cells go on through `rest`, the others are given out as they are."""

    def __init__(self, n: int, rest):
        self.n, self.parts = n, {"rest": rest}
        self.params = joined(self.parts)

    def back(self, p, x):
        u, ld = self.parts["rest"].back(part(p, "rest"), x[:, : self.n])
        return t.concat([u, x[:, self.n :]], 1), ld

    @both
    def forward(self, p, u):
        return t.concat([self.parts["rest"].forward(part(p, "rest"), u[:, : self.n]), u[:, self.n :]], 1)


def coupling_block(c: int, h: int, w: int, make: Callable, last: bool, batch_norm: bool = True) -> Chain:
    """Three checkerboard couplings, then three channel couplings on the squeezed image; the last block has four of the
    former and none of the latter. make(c, h, w, channels, reverse) gives a coupling."""

    def couplings(c, h, w, channels, n):
        out = []
        for k in range(n):
            out += [make(c, h, w, channels, k % 2 == 1)] + ([BatchNorm(c * h * w, cells=h * w)] if batch_norm else [])
        return out

    if last:
        return Chain(couplings(c, h, w, False, 4))
    squeezed = squeeze_order(c, h, w)
    return Chain([*couplings(c, h, w, False, 3), _Order(squeezed), *couplings(4 * c, h // 2, w // 2, True, 3), _Order(np.argsort(squeezed))])


def multiscale(c: int, h: int, w: int, levels: int, block: Callable) -> Chain:
    """`levels` levels over a last block; block(c, h, w, level, last) gives a layer. Cells come out in the image's places."""
    if levels < 0 or h % 2**levels or w % 2**levels:
        raise ValueError("height and width are multiples of 2 ** levels")

    def level(k: int, c: int, h: int, w: int):
        if k == levels:
            return block(c, h, w, k, True)
        order = scale_order(c, h, w)
        rest = Split(2 * c * h * w // 4, level(k + 1, 2 * c, h // 2, w // 2))
        return Chain([block(c, h, w, k, False), _Order(order), rest, _Order(np.argsort(order))])

    return level(0, c, h, w)


def realnvp2d(
    c: int, h: int, w: int, levels: int = 1, network: str | Callable = "resnet", blocks: int = 2, filters: int = 32, affine: bool = True, batch_norm: bool = True,
    base: Model | None = None, dequantize: int | None = None, logit: float | None = None, seed: int = 42,
) -> Flow:
    """Real-valued non-volume-preserving flow over images. Filters double with each level and in channel couplings.
    network: a name of NETWORKS, or a function of the same form."""
    if levels <= 0 or blocks <= 0 or filters <= 0:
        raise ValueError("levels, blocks and filters are positive")
    if isinstance(network, str) and network not in NETWORKS:
        raise NotImplementedError(f"unknown network {network}")
    net = NETWORKS[network] if isinstance(network, str) else network
    made = iter(range(seed, seed + 10**6))

    def block(c, h, w, level, last):
        def make(c, h, w, channels, reverse):
            a = c // 2 if channels else c
            width = filters * 2**level * (2 if channels else 1)
            return Coupling2d(c, h, w, net(a, width, 2 * a if affine else a, blocks, batch_norm, next(made)), channels, reverse, affine)

        return coupling_block(c, h, w, make, last, batch_norm)

    return Flow(c * h * w, [multiscale(c, h, w, levels, block)], base, dequantize, logit)
