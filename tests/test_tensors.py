"""Inverse, normalisation and gradient properties of the tensor models."""

import itertools

import numpy as np
import pytest

from probspark.operators import tensors as m
from probspark.plans.tape import Var


def models():
    return {
        "rat": m.RatSpn(5, depth=2, repetitions=2, batch=2, sums=2),
        "rat-bernoulli": m.RatSpn(6, classes=2, depth=2, repetitions=2, batch=2, sums=3, leaf="bernoulli"),
        "dgc": m.DgcSpn(1, 4, 4, batch=2, sums=2),
        "dgc-pool": m.DgcSpn(2, 4, 4, batch=2, sums=2, pooling=1, classes=2),
        "nice": m.nice(4),
        "realnvp": m.realnvp(4, batch_norm=True),
        "maf": m.maf(4),
        "over-rat": m.realnvp(4, base=m.RatSpn(4, depth=2, repetitions=2, batch=2, sums=2)),
        "over-flow": m.realnvp(4, base=m.nice(4)),
        "images": m.realnvp_images(1, 4, 4, filters=3),
        "images-dense": m.realnvp_images(1, 4, 4, filters=3, net="densenet"),
        "rat-fixed": m.RatSpn(5, depth=1, repetitions=2, batch=2, leaf=m.GaussianLeaf((-1.0, 1.0), "fixed")),
        "dgc-sparse": m.DgcSpn(1, 4, 4, batch=2, sums=2, depthwise=False),
        "dgc-drawn": m.DgcSpn(1, 4, 4, batch=2, sums=3, pooling=1, depthwise=[True, False], products=5),
        "over-dgc": m.realnvp(16, couplings=2, base=m.DgcSpn(1, 4, 4, batch=2, sums=2)),
        "over-normal": m.maf(4, base=m.Normal(4)),
        "ends": m.realnvp(4, batch_norm=True, dequantize=3, logit=0.05),
    }


def width(model):
    return model.n if hasattr(model, "n") else int(np.prod(model.shape))


@pytest.mark.parametrize("name", list(models()))
def test_gradients(name):
    model, rng = models()[name], np.random.default_rng(0)
    for k in model.params:
        model.params[k] = model.params[k] + rng.normal(0, 0.05, model.params[k].shape)
    x = rng.random((5, width(model))) if "bernoulli" not in name else rng.integers(0, 2, (5, width(model))).astype(float)
    y = rng.integers(0, 2, 5) if model.classes == 2 else None
    _, g = model.gradients(x, y)
    for k, v in model.params.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        old = v[i]
        values = []
        for d in (1e-5, -1e-5):
            v[i] = old + d
            values.append(float(model.loss({a: Var(b) for a, b in model.params.items()}, x, y).v))
        v[i] = old
        assert g[k][i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-4), k


def test_random_network_is_normalised():
    model = m.RatSpn(6, depth=2, repetitions=3, batch=2, sums=2, leaf="bernoulli")
    x = np.array(list(itertools.product([0.0, 1.0], repeat=6)))
    assert np.exp(model.scores(x)).sum() == pytest.approx(1.0)
    hidden = x.copy()
    hidden[:, 2:] = np.nan
    assert np.exp(model.scores(np.unique(hidden[:, :2], axis=0) @ np.eye(2, 6) + np.array([0, 0, np.nan, np.nan, np.nan, np.nan]))).sum() == pytest.approx(1.0)


def test_completions():
    rng = np.random.default_rng(2)
    model = m.RatSpn(6, depth=2, repetitions=2, batch=2, sums=2)
    x = rng.normal(size=(20, 6))
    hidden = np.where(rng.random(x.shape) < 0.4, np.nan, x)
    full = model.complete(hidden)
    assert not np.isnan(full).any() and (full[~np.isnan(hidden)] == hidden[~np.isnan(hidden)]).all()
    assert model.scores(full).mean() > model.scores(np.where(np.isnan(hidden), rng.normal(0, 3, x.shape), hidden)).mean()
    drawn = model.complete(np.full((4000, 6), np.nan), uniforms=lambda k: np.random.default_rng(k).random(4000))
    assert not np.isnan(drawn).any()
    image = m.DgcSpn(1, 4, 4)
    h = np.where(rng.random((8, 16)) < 0.5, np.nan, rng.normal(size=(8, 16)))
    assert not np.isnan(image.complete(h)).any()


@pytest.mark.parametrize("name", ["nice", "realnvp", "maf", "images", "images-dense"])
def test_flows_invert(name):
    model, rng = models()[name], np.random.default_rng(1)
    for k in model.params:
        model.params[k] = model.params[k] + rng.normal(0, 0.2, model.params[k].shape)
    x = rng.normal(size=(6, model.n))
    u, ld = model.back({k: Var(v) for k, v in model.params.items()}, x)
    assert np.allclose(model.forward(u.v), x, atol=1e-6)
    # log determinant against finite differences
    jac = np.empty((model.n, model.n))
    for i in range(model.n):
        step = np.zeros(model.n)
        step[i] = 1e-5
        up, down = (model.back({k: Var(v) for k, v in model.params.items()}, x[:1] + s)[0].v[0] for s in (step, -step))
        jac[:, i] = (up - down) / 2e-5
    assert ld.v[0] == pytest.approx(np.linalg.slogdet(jac)[1], abs=1e-4)


def test_layers_at_the_ends():
    x = np.random.default_rng(0).random((5, 3))
    for layer in (m.LogitLayer(3),):
        u, _ = layer.back({}, Var(x))
        assert np.allclose(layer.forward({}, u.v), x)
    q = m.Dequantize(3, 4)
    levels = np.floor(x * 16) / 15
    u, _ = q.back({}, Var(levels))
    assert (u.v > 0).all() and (u.v < 1).all() and np.allclose(q.forward({}, u.v), levels)


def test_training_on_a_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(-a + 0.1 * b), int(a > 0)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    flow = m.realnvp(2, couplings=2, hidden=(8,))
    h = m.train(df, flow, ["a", "b"], epochs=6, rate=0.05)
    assert h[-1]["train_loss"] < h[0]["train_loss"]
    assert m.score(df, flow, ["a", "b"]).where("ll is null").count() == 0
    rat = m.RatSpn(2, classes=2, depth=1, repetitions=2, batch=3)
    m.train(df, rat, ["a", "b"], "y", valid=df, epochs=8, rate=0.1, share=0.8, key="id")
    table = {(r["actual"], r["predicted"]): r["n"] for r in m.test(df, rat, ["a", "b"], "y").collect()}
    assert table.get((0, 0), 0) + table.get((1, 1), 0) > 240
    assert m.test(df, flow, ["a", "b"]).first()["two_se"] > 0
    for name in ("sgd", "rmsprop", "adagrad"):
        o = m.Optimizer(name, 0.1)
        p = {"w": np.array([1.0])}
        o.step(p, {"w": np.array([0.5])})
        assert p["w"][0] < 1
    with pytest.raises(ValueError):
        m.Optimizer("none")
    stop = m.EarlyStopping(2)
    assert [stop(v, {}) for v in (1.0, 0.5, 0.6, 0.7)] == [False, False, False, True]
    avg = m.RunningAverage()
    avg(1.0, 1)
    avg(4.0, 2)
    assert avg.average() == 3.0
    assert np.exp(m.dirichlet((3, 4), 1)).sum(1) == pytest.approx(np.ones(3))


@pytest.mark.parametrize("depthwise,products", [(False, None), ([True, False], 4), (True, None)])
def test_spatial_products_are_normalised(depthwise, products):
    model = m.DgcSpn(1, 3, 3, batch=2, sums=2, depthwise=depthwise, products=products, leaf="bernoulli")
    x = np.array(list(itertools.product([0.0, 1.0], repeat=9)))
    assert np.exp(model.scores(x)).sum() == pytest.approx(1.0)
    hidden = np.where(np.arange(9) < 3, x, np.nan)
    assert np.exp(model.scores(hidden[::64])).sum() == pytest.approx(1.0)


def test_pooled_products_are_normalised():
    for pooling in (1, 2):
        model = m.DgcSpn(1, 3, 3, batch=2, sums=2, pooling=pooling, depthwise=False, products=7, leaf="bernoulli")
        x = np.array(list(itertools.product([0.0, 1.0], repeat=9)))
        assert np.exp(model.scores(x)).sum() == pytest.approx(1.0)


def test_channel_tuples():
    every = m.DgcSpn._tuples(3, None, np.random.default_rng(0))
    assert every.shape == (81, 4) and len({tuple(r) for r in every}) == 81 and every.max() == 2
    drawn = m.DgcSpn._tuples(4, 10, np.random.default_rng(0))
    assert len({tuple(r) for r in drawn}) == 10
    layer = m.DgcSpn(3, 4, 4, batch=3, sums=2, depthwise=False)
    ones = layer.products(Var(np.ones((1, 3, 4, 4))), 0).v
    assert ones.shape == (1, 81, 5, 5) and (ones[:, :, 1:-1, 1:-1] == 4).all()


@pytest.mark.parametrize("pooling,depthwise", [(0, False), (1, False), (0, True), (1, True)])
def test_spatial_completions_gain(pooling, depthwise):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 3 * 64))
    model = m.DgcSpn(3, 8, 8, batch=2, sums=2, pooling=pooling, depthwise=depthwise, products=16)
    filled = model.complete(np.where(rng.random(x.shape) < 0.5, np.nan, x))
    assert (model.scores(filled) > model.scores(x)).all()


def test_options():
    for bad in ({"depthwise": []}, {"depthwise": [True] * 9}, {"pooling": 9}, {"in_dropout": 1.0}, {"sum_dropout": 0.0}):
        with pytest.raises(ValueError):
            m.DgcSpn(1, 4, 4, **bad)
    with pytest.raises(ValueError):
        m.GaussianLeaf((1.0, 1.0))
    with pytest.raises(ValueError):
        m.RatSpn(4, leaf="laplace")
    low = m.DgcSpn(1, 4, 4, leaf=m.GaussianLeaf((-1.0, 1.0), "fixed"))
    assert (abs(low.params["loc"]) <= 1).all() and "scale" not in low.params
    assert (m.DgcSpn(1, 4, 4, leaf=m.GaussianLeaf(scale="random")).params["scale"] > 0.39).all()


class Exponential(m.TensorLeaf):
    """A user's family."""

    def start(self, shape, rng, place):
        return {"rate": rng.uniform(0.5, 2, shape)}

    def log_prob(self, p, v):
        from probspark.plans import tape as t

        return t.log(t.as_var(p["rate"])) - v * p["rate"]

    def mode(self, p):
        return np.zeros_like(p["rate"])

    def sample(self, p, uniforms):
        return -np.log(1 - uniforms()) / p["rate"]

    def constrain(self, p):
        p["rate"] = np.maximum(p["rate"], 1e-3)


def test_a_users_leaf(spark):
    model = m.RatSpn(3, depth=1, repetitions=2, batch=2, leaf=Exponential())
    x = np.random.default_rng(0).exponential(0.2, (300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    h = m.train(df, model, ["a", "b", "c"], epochs=6, rate=0.2)
    assert h[-1]["train_loss"] < h[0]["train_loss"]
    assert (model.complete(np.full((2, 3), np.nan)) == 0).all()
    drawn = model.complete(np.full((4000, 3), np.nan), uniforms=lambda k: np.random.default_rng(k).random(4000))
    assert (drawn > 0).all()


def test_quantile_starts(spark):
    x = np.random.default_rng(1).normal(size=(101, 4))
    x[:40, 1] = 0.5
    want = np.stack([[part.mean() for part in np.array_split(np.sort(c), 3)] for c in x.T], 1)
    wide = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    table = m.mean_quantile_table(wide, list("abcd"), 3)
    assert np.allclose(table, want)
    arrays = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(3)
    assert np.allclose(m.mean_quantile_table(arrays, ["x"], 3), want)
    model = m.RatSpn(4, depth=1, repetitions=1, batch=3, leaf=m.GaussianLeaf(table))
    for r, region in enumerate(model.index):
        assert np.allclose(model.params["loc"][r], table[:, region])


@pytest.mark.parametrize("make", [lambda: m.RatSpn(4, depth=2, repetitions=2, in_dropout=0.3, sum_dropout=0.3), lambda: m.DgcSpn(1, 2, 2, in_dropout=0.3, sum_dropout=0.3)])
def test_dropout_is_a_function_of_the_row(spark, make):
    x = np.random.default_rng(3).normal(size=(200, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    found = []
    for n, step in ((1, 0), (5, 0), (5, 1)):
        model = make()
        table = m._training_table(df.repartition(n), model, ["x"], None, "id", 256)
        loss, rows, g = m._gradient_sums(table, model, ["x"], None, step=step)
        assert rows == 200 and np.isfinite(loss)
        found.append((loss, g))
    assert found[0][0] == pytest.approx(found[1][0]) and all(np.allclose(found[0][1][k], found[1][1][k]) for k in found[0][1])
    assert found[0][0] != pytest.approx(found[2][0])
    plain = make()
    assert found[0][0] != pytest.approx(-plain.scores(x).sum())
    # gradients are those of the masked network
    drop = m.Dropout(np.arange(200), 0)
    _, g = plain.gradients(x, None, drop)
    v, i = plain.params["root"], (0, 1)
    old, values = v[i], []
    for d in (1e-5, -1e-5):
        v[i] = old + d
        values.append(plain.gradients(x, None, drop)[0])
    v[i] = old
    assert g["root"][i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-4)


def test_a_share_of_nodes_is_dropped():
    drop = m.Dropout(np.arange(500), 3)
    assert drop.keep(1, (40,), 0.25).mean() == pytest.approx(0.75, abs=0.02)
    lone = drop.inputs(Var(np.zeros((500, 2, 3))), 1, 0.9, 2).v
    assert (np.isfinite(lone).sum(2) >= 1).all()


def test_pathwise_gradients(spark):
    df = spark.range(300).repartition(4)
    for base in (None, m.Normal(3), m.Uniform(3, -1.0, 2.0)):
        flow = m.realnvp(3, 2, (4,), base=base, logit=0.05)
        for k in flow.params:
            flow.params[k] = flow.params[k] + np.random.default_rng(len(k)).normal(0, 0.3, flow.params[k].shape)
        f = lambda x: (x * x).sum(1)
        value, g = m.expectation(df, flow, f, "id", 5)
        for k in list(flow.params)[::3]:
            v = flow.params[k]
            i = tuple(n - 1 for n in v.shape)
            old, values = v[i], []
            for d in (1e-5, -1e-5):
                v[i] = old + d
                values.append(m.expectation(df, flow, f, "id", 5)[0] if k == "0.w0" else None)
            v[i] = old
            if values[0] is not None:
                assert g[k][i] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-4)
        assert np.isfinite(value)
    with pytest.raises(NotImplementedError):
        m.realnvp(4, base=m.RatSpn(4)).pathwise({}, np.zeros((1, 8)))


def test_samples_of_a_flow(spark):
    flow = m.Flow(2, [m.BatchNorm(2)], m.Normal(2))
    flow.params["0.mean"], flow.params["0.var"] = np.array([3.0, -1.0]), np.array([4.0, 0.25])
    df = spark.range(4000)
    x = np.stack(m.draw(df, flow, "id").orderBy("id").toPandas()["sample"])
    assert np.allclose(x.mean(0), [3, -1], atol=0.15) and np.allclose(x.std(0), [2, 0.5], atol=0.1)
    assert (np.stack(m.draw(df.repartition(7), flow, "id").orderBy("id").toPandas()["sample"]) == x).all()
    over = m.realnvp(4, 2, (4,), base=m.RatSpn(4, depth=1, repetitions=2, batch=2))
    assert np.isfinite(over.sample(np.arange(50))).all()


def test_uniform_base_behind_data_ends():
    x = np.random.default_rng(0).random((20, 6))
    flow = m.realnvp(6, 2, (4,), base=m.Uniform(6, -5.0, 5.0), dequantize=8, logit=0.05)
    _, before = flow.preprocess(x)
    assert np.allclose(flow.scores(x)[:, 0] - before.v, -6 * np.log(10))
    level = flow.unpreprocess(flow.preprocess(x)[0].v)
    assert ((level >= 0) & (level <= 1)).all() and np.allclose(flow.unpreprocess(flow.preprocess(level)[0].v), level)


def test_scores_and_report_together(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), int(a > 0)) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    model = m.RatSpn(2, classes=2, depth=1, repetitions=2, batch=3)
    m.train(df, model, ["a", "b"], "y", epochs=5, rate=0.1)
    nll, error, report = m.test_model(df, model, ["a", "b"], "y")
    x, y = np.array(rows)[:, :2], np.array(rows)[:, 2].astype(int)
    ll = model.scores(x)
    each = np.log(np.exp(ll).sum(1)) - ll[np.arange(200), y]
    assert nll == pytest.approx(each.mean()) and error == pytest.approx(each.std() / np.sqrt(200))
    right = {r["label"]: r for r in report.collect()}["accuracy"]["recall"]
    assert right == pytest.approx((ll.argmax(1) == y).mean())
