"""Queries of the tensor networks and flows, over all cells of the embeddings, with DuckDB SQL for fixed weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import image_flows, tensors
from .plans import tape as t
from .queries import LOG2PI, _lse_sql, _r, _round, query
from .sources.matrices import load

CELL = "x AS (SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS x FROM embeddings)"


def _images(spark, d) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", "embedding")


# --- one level of a multi-scale flow --------------------------------------------------------------------------------

#: Weights of the cells above, below, to the left and to the right; then slope and offset.
CROSS = (0.4, -0.3, 0.2, 0.1)
SHIFT, SCALE = (0.3, 0.05), (0.6, -0.1)
PAIRS = {"shift": [(0.5, -0.25), (0.2, 0.3)], "scale": [(0.4, 0.1), (-0.3, 0.2)]}


class Cross:
    """A network without parameters: each cell's shift (and scale) from its four neighbours in the channel."""

    params: dict = {}

    def __init__(self, affine: bool):
        self.affine = affine

    def __call__(self, p, img):
        h, w = img.shape[2:]
        around = t.pad(img, ((0, 0), (0, 0), (1, 1), (1, 1)))
        at = [(0, 1), (2, 1), (1, 0), (1, 2)]
        z = sum((around[:, :, i : i + h, j : j + w] * c for c, (i, j) in zip(CROSS, at, strict=True)), img * 0.0)
        shift = z * SHIFT[0] + SHIFT[1]
        return t.concat([shift, z * SCALE[0] + SCALE[1]], 1) if self.affine else shift


class Pairwise:
    """A network without parameters from two channels to two."""

    params: dict = {}

    def __call__(self, p, img):
        return t.concat([img[:, 0:1] * a + img[:, 1:2] * b for kind in ("shift", "scale") for a, b in PAIRS[kind]], 1)


def _level_sql() -> str:
    def cross(x: str, step: int, top: str, bottom: str, left: str, right: str) -> str:
        a, b, c, e = CROSS
        return (
            f"({a} * CASE WHEN {top} THEN {x}[i + 1 - {8 * step}] ELSE 0 END + {b} * CASE WHEN {bottom} THEN {x}[i + 1 + {8 * step}] ELSE 0 END"
            f" + {c} * CASE WHEN {left} THEN {x}[i + 1 - {step}] ELSE 0 END + {e} * CASE WHEN {right} THEN {x}[i + 1 + {step}] ELSE 0 END)"
        )

    near = cross("x", 1, "i >= 8", "i < 56", "i % 8 > 0", "i % 8 < 7")
    even = "(i // 8 + i % 8) % 2 = 0"
    down = "i + 9 - i % 2"  # place (from 1) of the lower left cell of the block, for cells of its upper row
    low, high = f"y[{down}]", f"y[{down} + 1]"
    pick = lambda kind: " ".join(f"WHEN i % 2 = {k} THEN {a} * {low} + {b} * {high}" for k, (a, b) in enumerate(PAIRS[kind]))
    moved = "(i // 8) % 2 = 0"
    far = cross("v", 2, "i >= 16", "i < 48", "i % 8 > 1", "i % 8 < 6")
    last = "(i // 8) % 2 = i % 2 AND (i // 16 + (i % 8) // 2) % 2 = 0"
    each = lambda name, e: f"list_transform(range(64), lambda i: {e}) AS {name}"
    return (
        f"WITH {CELL}, s AS (SELECT *, {each('s', f'CASE WHEN {even} THEN 0.5 * tanh({SCALE[0]} * {near} + {SCALE[1]}) ELSE 0.0 END')} FROM x), "
        f"y AS (SELECT *, {each('y', f'CASE WHEN {even} THEN (x[i + 1] - ({SHIFT[0]} * {near} + {SHIFT[1]})) * exp(-s[i + 1]) ELSE x[i + 1] END')} FROM s), "
        f"c AS (SELECT *, {each('c', f'CASE WHEN {moved} THEN 0.4 * tanh(CASE {pick("scale")} END) ELSE 0.0 END')} FROM y), "
        f"v AS (SELECT *, {each('v', f'CASE WHEN {moved} THEN (y[i + 1] - CASE {pick("shift")} END) * exp(-c[i + 1]) ELSE y[i + 1] END')} FROM c), "
        f"u AS (SELECT *, {each('u', f'CASE WHEN {last} THEN v[i + 1] - ({SHIFT[0]} * {far} + {SHIFT[1]}) ELSE v[i + 1] END')} FROM v) "
        f"SELECT vec_id, {_r(f'-0.5 * list_sum(list_transform(u, lambda a: a * a)) - list_sum(s) - list_sum(c) - {32 * LOG2PI!r}')} AS ll FROM u"
    )


@query(_level_sql())
def multiscale_level_fixed(spark, d):
    def block(c, h, w, level, last):
        if last:
            return image_flows.Coupling2d(c, h, w, Cross(False), affine=False)
        board = image_flows.Coupling2d(c, h, w, Cross(True))
        board.params["gain"] = np.array([0.5])
        mix = image_flows.Coupling2d(4 * c, h // 2, w // 2, Pairwise(), channels=True)
        mix.params["gain"] = np.array([0.4, 0.4])
        order = image_flows.squeeze_order(c, h, w)
        return tensors.Chain([board, tensors.Rearrange(order), mix, tensors.Rearrange(np.argsort(order))])

    flow = tensors.Flow(64, [image_flows.multiscale(1, 8, 8, 1, block)])
    return _round(tensors.score(_images(spark, d), flow, ["embedding"]).select("vec_id", "ll"))


@query()
def realnvp2d_multiscale_score(spark, d):
    df = _images(spark, d)
    flow = image_flows.realnvp2d(1, 8, 8, levels=1, blocks=1, filters=4)
    tensors.train(df, flow, ["embedding"], epochs=4, rate=0.02, key="vec_id")
    return _round(tensors.score(df, flow, ["embedding"]).select("vec_id", "ll"))


@query()
def realnvp2d_dense_score(spark, d):
    df = _images(spark, d)
    flow = image_flows.realnvp2d(1, 8, 8, levels=1, network="densenet", blocks=1, filters=2)
    tensors.train(df, flow, ["embedding"], epochs=3, rate=0.02, key="vec_id")
    return _round(tensors.score(df, flow, ["embedding"]).select("vec_id", "ll"))


# --- batch moments, ends and bases of flows -------------------------------------------------------------------------


@query(
    f"WITH {CELL}, e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM x), m AS (SELECT k, avg(x) AS m, var_pop(x) + 1e-5 AS v FROM e GROUP BY k) "
    f"SELECT vec_id, {_r(f'sum(-0.5 * (x - m) * (x - m) / v - 0.5 * ln(v) - {0.5 * LOG2PI!r})')} AS ll FROM e JOIN m USING (k) GROUP BY vec_id"
)
def batchnorm_settled(spark, d):
    """The moments that a layer settles on are the table's, found on the executors."""
    df = _images(spark, d)
    flow = tensors.Flow(64, [tensors.BatchNorm(64)])
    tensors.settle_moments(df, flow, ["embedding"])
    return _round(tensors.score(df, flow, ["embedding"]).select("vec_id", "ll"))


@query(
    f"WITH {CELL}, e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS k FROM x), m AS (SELECT k % 8 AS c, avg(x) AS m, var_pop(x) + 1e-5 AS v FROM (SELECT (k - 1) // 8 AS k, x FROM e) GROUP BY c) "
    f"SELECT vec_id, {_r(f'sum(-0.5 * (x - m) * (x - m) / v - 0.5 * ln(v) - {0.5 * LOG2PI!r})')} AS ll FROM e JOIN m ON (e.k - 1) // 8 = m.c GROUP BY vec_id"
)
def batchnorm_channels_settled(spark, d):
    """Eight channels of eight cells: moments are common to a channel's cells."""
    df = _images(spark, d)
    flow = tensors.Flow(64, [tensors.BatchNorm(64, cells=8)])
    tensors.settle_moments(df, flow, ["embedding"])
    return _round(tensors.score(df, flow, ["embedding"]).select("vec_id", "ll"))


@query()
def realnvp1d_batchnorm_score(spark, d):
    df = _images(spark, d)
    flow = tensors.realnvp(64, 2, (16,), batch_norm=True)
    tensors.train(df, flow, ["embedding"], epochs=4, rate=0.02, key="vec_id")
    return _round(tensors.score(df, flow, ["embedding"]).select("vec_id", "ll"))


#: Levels of 4 bits, logit factor, half width of the uniform base.
BITS, ALPHA, WIDE = 4, 0.05, 5.0


@query(
    f"WITH {CELL}, e AS (SELECT vec_id, floor((greatest(-1.0, least(1.0, unnest(x))) + 1) * 0.5 * 15 + 0.5) / 15 AS q FROM x), y AS (SELECT vec_id, {ALPHA} + {1 - 2 * ALPHA} * (q * 15 + 0.5) / 16 AS y FROM e) "
    f"SELECT vec_id, {_r(f'sum(-ln(y) - ln(1 - y) + ln({1 - 2 * ALPHA}) + ln(15.0 / 16) - ln({2 * WIDE}))')} AS ll FROM y GROUP BY vec_id"
)
def uniform_base_preprocessed(spark, d):
    """Dequantisation and logit in front of a flow of no layers over a uniform base: their log determinants and its density."""
    level = lambda x: F.floor((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) + 1) * 0.5 * 15 + 0.5) / 15
    df = _images(spark, d).withColumn("embedding", F.transform("embedding", level))
    flow = tensors.Flow(64, [], tensors.Uniform(64, -WIDE, WIDE), dequantize=BITS, logit=ALPHA)
    return _round(tensors.score(df, flow, ["embedding"]).select("vec_id", "ll"))


@query()
def flow_samples(spark, d):
    """One sample of a trained flow for every vector's id."""
    df = _images(spark, d)
    flow = tensors.realnvp(64, 2, (16,), batch_norm=True)
    tensors.train(df, flow, ["embedding"], epochs=4, rate=0.02, key="vec_id")
    drawn = tensors.draw(df.select("vec_id"), flow, "vec_id")
    return drawn.select("vec_id", F.transform("sample", lambda x: F.round(x, 6)).alias("sample"))


# --- leaves, starts, products and dropout of networks ---------------------------------------------------------------


@query(f"WITH {CELL}, e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS var FROM x), n AS (SELECT var, x, ntile(4) OVER (PARTITION BY var ORDER BY x) - 1 AS chunk FROM e) SELECT CAST(var AS INTEGER) AS var, CAST(chunk AS INTEGER) AS chunk, {_r('avg(x)')} AS mean FROM n GROUP BY 1, 2")
def leaf_quantile_starts(spark, d):
    """Starts of four leaves for every cell: means of its quarters."""
    table = tensors.mean_quantile_table(_images(spark, d), ["embedding"], 4)
    rows = [(v, k, float(table[k, v])) for v in range(table.shape[1]) for k in range(table.shape[0])]
    return _round(spark.createDataFrame(rows, "var int, chunk int, mean double"))


#: Locations of the two leaves of a region, as a line over the cells.
LEAF_LINE = ((0.0, 0.001), (0.05, -0.002))


class LaplaceLeaf(tensors.TensorLeaf):
    """exp(-|x - loc| / 0.2) / 0.4, a family that the library doesn't have."""

    def start(self, shape, rng, place):
        return {"loc": place(np.array([[a + b * k for k in range(64)] for a, b in LEAF_LINE]))}

    def log_prob(self, p, v):
        z = v - p["loc"]
        return (t.relu(z) + t.relu(-z)) * -5.0 - math.log(0.4)

    def mode(self, p):
        return p["loc"]


def _laplace_sql() -> str:
    left, right = tensors.region_graph(64, 1, 1)[0]
    side = lambda cells, leaf: f"list_sum(list_transform({list(cells)}, lambda k: -5.0 * abs(x[k + 1] - ({LEAF_LINE[leaf][0]} + {LEAF_LINE[leaf][1]} * k)) - {math.log(0.4)!r}))"
    sums = ", ".join(f"{side(cells, leaf)} AS {name}{leaf}" for name, cells in (("a", left), ("b", right)) for leaf in (0, 1))
    terms = [f"(a{i} + b{j} - {math.log(4)!r})" for i in (0, 1) for j in (0, 1)]
    return f"WITH {CELL}, s AS (SELECT vec_id, {sums} FROM x) SELECT vec_id, {_r(_lse_sql(terms))} AS ll FROM s"


@query(_laplace_sql())
def ratspn_own_leaf_fixed(spark, d):
    model = tensors.RatSpn(64, depth=1, repetitions=1, batch=2, leaf=LaplaceLeaf())
    model.params["root"] = np.zeros((1, 4))
    return _round(tensors.score(_images(spark, d), model, ["embedding"]).select("vec_id", "ll"))


def _sparse(depthwise: bool) -> tensors.DgcSpn:
    """Two fixed leaves, pooling all the way, equal weights."""
    model = tensors.DgcSpn(1, 8, 8, batch=2, sums=1, pooling=3, depthwise=[depthwise, True], leaf=tensors.GaussianLeaf(np.repeat([[0.0], [0.2]], 64, 1), "fixed"))
    for k in model.params:
        if k != "loc":
            model.params[k] = np.zeros_like(model.params[k])
    return model


def _gauss(x: str, loc: float) -> str:
    return f"(-0.5 * ({x} - {loc}) * ({x} - {loc}) - {0.5 * LOG2PI!r})"


@query(f"WITH {CELL} SELECT vec_id, {_r('list_sum(list_transform(x, lambda a: ' + _lse_sql([_gauss('a', 0.0), _gauss('a', 0.2)]) + f' - {math.log(2)!r}))')} AS ll FROM x")
def dgcspn_sparse_fixed(spark, d):
    """Products of any two-leaf choice at the four corners under equal weights: every cell is a mixture of its own."""
    return _round(tensors.score(_images(spark, d), _sparse(False), ["embedding"]).select("vec_id", "ll"))


@query(
    f"WITH {CELL}, e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS k FROM x), b AS (SELECT vec_id, k // 16 AS i, (k % 8) // 2 AS j, sum({_gauss('x', 0.0)}) AS p, sum({_gauss('x', 0.2)}) AS q FROM e GROUP BY 1, 2, 3) "
    f"SELECT vec_id, {_r(f'sum({_lse_sql(["p", "q"])} - {math.log(2)!r})')} AS ll FROM b GROUP BY vec_id"
)
def dgcspn_depthwise_fixed(spark, d):
    """Products of one leaf at the four corners under equal weights: every block is a mixture of its own."""
    return _round(tensors.score(_images(spark, d), _sparse(True), ["embedding"]).select("vec_id", "ll"))


@query()
def dgcspn_sparse_score(spark, d):
    """Sparse products after depthwise ones, starts at mean quantiles, dropout by key."""
    df = _images(spark, d)
    leaf = tensors.GaussianLeaf(tensors.mean_quantile_table(df, ["embedding"], 4), "random")
    model = tensors.DgcSpn(1, 8, 8, batch=4, sums=4, pooling=2, depthwise=[True, False], products=32, leaf=leaf, in_dropout=0.1, sum_dropout=0.1)
    tensors.train(df, model, ["embedding"], epochs=3, rate=0.02, key="vec_id")
    return _round(tensors.score(df, model, ["embedding"]).select("vec_id", "ll"))
