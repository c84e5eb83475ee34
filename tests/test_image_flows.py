"""Multi-scale image flows: inversion, log determinants, gradients through batch moments, training."""

import numpy as np
import pytest

from probspark.operators import image_flows as f
from probspark.operators import tensors as m
from probspark.plans.tape import Var


def flows():
    small = {"blocks": 1, "filters": 2}
    return {
        "resnet": f.realnvp2d(1, 4, 4, levels=2, **small),
        "densenet": f.realnvp2d(1, 4, 4, network="densenet", **small),
        "shift": f.realnvp2d(2, 4, 4, affine=False, batch_norm=False, **small),
        "plain": f.realnvp2d(1, 4, 4, batch_norm=False, **small),
        "ends": f.realnvp2d(1, 4, 4, dequantize=8, logit=0.01, **small),
        "over-dgc": f.realnvp2d(1, 4, 4, batch_norm=False, base=m.DgcSpn(1, 4, 4, batch=2, sums=2), **small),
    }


def stirred(flow, size=0.2):
    rng = np.random.default_rng(1)
    for k, v in flow.params.items():
        flow.params[k] = v + (rng.random(v.shape) * size if k.endswith("var") else rng.normal(0, size, v.shape))
    return flow


@pytest.mark.parametrize("name", list(flows()))
def test_inverts(name):
    flow = stirred(flows()[name])
    x = np.random.default_rng(0).random((5, flow.n))
    p = {k: Var(v) for k, v in flow.params.items()}
    x = flow.unpreprocess(flow.preprocess(x)[0].v)  # whole levels, where there are
    u, ld = flow.back(p, x)
    assert np.allclose(flow.forward(u.v), x, atol=1e-6)
    if name == "ends":
        return
    jac = np.stack([(flow.back(p, x[:1] + s)[0].v[0] - flow.back(p, x[:1] - s)[0].v[0]) / 2e-5 for s in 1e-5 * np.eye(flow.n)], 1)
    assert ld.v[0] == pytest.approx(np.linalg.slogdet(jac)[1], abs=1e-4)


@pytest.mark.parametrize("name", ["resnet", "densenet", "plain", "over-dgc"])
@pytest.mark.parametrize("batch", [False, True])
def test_gradients(name, batch):
    flow = stirred(flows()[name])
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, flow.n))
    _, g = flow.gradients(x, None, None, batch)
    for k in list(flow.params)[:: max(1, len(flow.params) // 40)]:
        if batch and k.endswith((".mean", ".var")):
            continue
        v = flow.params[k]
        i = tuple(rng.integers(0, n) for n in v.shape)
        old, values = v[i], []
        for d in (1e-7, -1e-7):
            v[i] = old + d
            values.append(flow.gradients(x, None, None, batch)[0])
        v[i] = old
        assert g[k][i] == pytest.approx((values[0] - values[1]) / 2e-7, abs=1e-3, rel=1e-3), k


def test_half_of_the_cells_leave_at_each_level():
    seen = []

    class Twice:
        params: dict = {}

        def __init__(self, n):
            self.n = n

        def back(self, p, x):
            seen.append(x.shape[1])
            return x * 2.0, Var(np.full(x.shape[0], self.n * np.log(2)))

        @m.both
        def forward(self, p, u):
            return u * 0.5

    chain = f.multiscale(1, 8, 8, 2, lambda c, h, w, k, last: Twice(c * h * w))
    x = np.arange(128.0).reshape(2, 64)
    u, ld = chain.back({}, Var(x))
    assert seen == [64, 32, 16] and np.allclose(ld.v, 112 * np.log(2))
    times = (u.v[1] / x[1]).reshape(8, 8)  # the cells of the diagonals went through again
    assert (times == 2).sum() == 32 and (times == 4).sum() == 16 and (times == 8).sum() == 16
    assert all(times[y, x] > 2 for y in range(8) for x in range(8) if (y + x) % 2 == 0)
    assert np.allclose(chain.forward({}, u.v), x)
    with pytest.raises(ValueError):
        f.multiscale(1, 6, 6, 2, lambda *_: Twice(1))


def test_weight_norm_only_turns_directions():
    conv = f.Convolution(2, 3)
    x = Var(np.random.default_rng(0).normal(size=(2, 2, 4, 4)))
    before = conv({k: Var(v) for k, v in conv.params.items()}, x).v
    p = {**conv.params, "v": conv.params["v"] * np.array([2.0, 0.1, 7.0])}
    assert np.allclose(conv({k: Var(v) for k, v in p.items()}, x).v, before)
    # against a sum written out
    w = (conv.params["v"] / np.sqrt((conv.params["v"] ** 2).sum(0)) * conv.params["g"]).reshape(3, 3, 2, 3)
    padded = np.pad(x.v, ((0, 0), (0, 0), (1, 1), (1, 1)))
    want = sum(np.einsum("nchw,cd->ndhw", padded[:, :, i : i + 4, j : j + 4], w[i, j]) for i in range(3) for j in range(3))
    assert np.allclose(before, want)


def test_wrong_options():
    for bad in ({"levels": 0}, {"blocks": 0}, {"filters": 0}):
        with pytest.raises(ValueError):
            f.realnvp2d(1, 8, 8, **bad)
    with pytest.raises(NotImplementedError):
        f.realnvp2d(1, 8, 8, network="unknown")
    with pytest.raises(ValueError):
        f.Coupling2d(3, 4, 4, None, channels=True)


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(3, 2, (400, 1)) + rng.normal(0, 0.3, (400, 16)) * np.linspace(1, 5, 16)
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, img array<double>")


def test_training_with_batch_moments(images):
    history = {}
    for norm in (False, True):
        flow = f.realnvp2d(1, 4, 4, blocks=1, filters=2, batch_norm=norm)
        history[norm] = m.train(images, flow, ["img"], epochs=4, rate=0.02, key="id", group=100)
    assert history[True][-1]["train_loss"] < history[True][0]["train_loss"] and history[True][-1]["train_loss"] < history[False][-1]["train_loss"]
    scores = m.score(images, flow, ["img"]).toPandas()["ll"]
    assert np.isfinite(scores).all() and -scores.mean() < history[False][0]["train_loss"]
    # the first norm's moments are those of what its coupling gives for the whole table
    x = np.stack(images.toPandas()["img"])
    name, layer = next(iter(flow.batch_layers().items()))
    layer.taken = {}
    flow.scores(x)
    z = layer.taken["x"]
    assert np.allclose(flow.params[f"{name}.mean"], z.mean((0, 2))) and np.allclose(flow.params[f"{name}.var"], z.var((0, 2)))


def test_steps_do_not_depend_on_partitions(images):
    got = []
    for n in (1, 7):
        flow = m.realnvp(16, 2, (4,), batch_norm=True)
        m.train(images.repartition(n), flow, ["img"], epochs=2, key="id", group=50)
        got.append(flow.params)
    assert all(np.allclose(got[0][k], got[1][k], atol=1e-9) for k in got[0])


def test_one_group_has_the_tables_moments(images):
    flow = m.Flow(16, [m.BatchNorm(16)])
    table = m._training_table(images, flow, ["img"], None, "id", 10**6)
    _, n, g = m._gradient_sums(table, flow, ["img"], None, block=10**6)
    x = np.stack(images.toPandas()["img"])
    assert n == 400 and np.allclose(g["0.mean"] / n, x.mean(0)) and np.allclose(g["0.var"] / n, x.var(0))


def test_networks_are_not_held_whole():
    """A training block of the dense flow took 2.2 GB, scores of 2000 rows 5 GB: neither depends on rows or depth as it did."""
    import tracemalloc

    x = np.random.default_rng(0).normal(size=(2000, 64)) * 0.1
    flow = f.realnvp2d(1, 8, 8, network="densenet", blocks=1, filters=2)
    peaks = []
    for run in (lambda: flow.gradients(x[:256], None, None, True), lambda: flow.scores(x)):
        tracemalloc.start()
        run()
        peaks.append(tracemalloc.get_traced_memory()[1] / 1e6)
        tracemalloc.stop()
    assert peaks[0] < 300 and peaks[1] < 50


def test_moments_settled_coupling_by_coupling(spark):
    """As one run of the whole flow for each layer finds them."""
    x = np.random.default_rng(2).normal(size=(120, 16)) * 0.3
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "x array<double>").repartition(3)
    for network in ("resnet", "densenet"):
        flow, plain = (f.realnvp2d(1, 4, 4, levels=2, network=network, blocks=1, filters=2) for _ in range(2))
        rng = np.random.default_rng(5)
        for k, v in flow.params.items():
            if not k.endswith((".mean", ".var")):
                flow.params[k] = plain.params[k] = v + rng.normal(0, 0.1, v.shape)
        m.settle_moments(df, flow, ["x"])
        for name, layer in plain.batch_layers().items():
            layer.taken = {}
            plain.scores(x)
            z, layer.taken = layer.taken["x"], None
            plain.params[f"{name}.mean"], plain.params[f"{name}.var"] = z.mean((0, 2)), z.var((0, 2))
        assert len(flow.couplings()) > 3 and all(np.allclose(flow.params[k], plain.params[k], atol=1e-9) for k in plain.params)
