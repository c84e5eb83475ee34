"""Analytic invariants over small state spaces, in both lowerings."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.functions import stats, transforms
from probspark.operators import inference, learn, splits, trees
from probspark.plans import rewrite, store, validate
from probspark.plans.nodes import Bernoulli, Categorical, ChowLiu, Gaussian, Isotonic, Leaf, Product, Sum, Uniform, bfs, layers, number, post_order, statistics
from probspark.queries import binary_circuit, fixed_tree
from probspark.sources.matrices import every_assignment, hash_split

NAMES = {i: f"x{i}" for i in range(4)}


def states(spark, missing=True):
    values = [0, 1, None] if missing else [0, 1]
    rows = [(i, *s) for i, s in enumerate(itertools.product(values, repeat=4))]
    return spark.createDataFrame(rows, "id long, x0 int, x1 int, x2 int, x3 int")


def brute(prob, row):
    free = [i for i, v in enumerate(row) if v is None]
    full = [list(row) for _ in range(2 ** len(free))]
    for f, s in zip(full, itertools.product([0, 1], repeat=len(free))):
        for i, v in zip(free, s):
            f[i] = v
    return [(prob(f), f) for f in full]


def tree_prob(t):
    def p(row):
        return math.exp(sum(t.logp[j, 0 if q < 0 else row[q], row[j]] for j, q in enumerate(t.parent)))

    return p


def circuit_prob(c):
    return lambda row: sum(w * math.prod(leaf.p if row[leaf.var] else 1 - leaf.p for leaf in k.children) for w, k in zip(c.weights, c.children))


@pytest.mark.parametrize("lowering", ["columns", "kernel"])
@pytest.mark.parametrize("make,prob", [(binary_circuit, circuit_prob), (fixed_tree, tree_prob), (lambda: rewrite.to_circuit(fixed_tree()), lambda c: tree_prob(fixed_tree()))])
def test_marginals_match_brute_force(spark, lowering, make, prob):
    root = make()
    p = prob(root)
    for r in inference.log_likelihood(states(spark), root, NAMES, lowering=lowering).collect():
        assert r["ll"] == pytest.approx(math.log(sum(x for x, _ in brute(p, r[1:5]))), abs=1e-9)


@pytest.mark.parametrize("lowering", ["columns", "kernel"])
def test_tree_mpe_is_exact(spark, lowering):
    t = fixed_tree()
    p = tree_prob(t)
    before = {r["id"]: tuple(r[1:5]) for r in states(spark).collect()}
    for r in inference.mpe(states(spark), t, NAMES, lowering=lowering).collect():
        assert p([int(v) for v in r[1:5]]) == pytest.approx(max(x for x, _ in brute(p, before[r["id"]])))


def test_samples_keep_evidence_and_follow_the_circuit(spark):
    root = binary_circuit()
    df = spark.range(20000).select("id", *[F.lit(None).cast("double").alias(f"x{i}") for i in range(3)], F.lit(1.0).alias("x3"))
    a = inference.sample(df, root, NAMES, "id", lowering="columns").toPandas().sort_values("id").reset_index(drop=True)
    b = inference.sample(df, root, NAMES, "id", lowering="kernel").toPandas().sort_values("id").reset_index(drop=True)
    assert a.equals(b) and (a["x3"] == 1).all()
    p = circuit_prob(root)
    total = sum(p([*s, 1]) for s in itertools.product([0, 1], repeat=3))
    for s in itertools.product([0, 1], repeat=3):
        share = ((a["x0"] == s[0]) & (a["x1"] == s[1]) & (a["x2"] == s[2])).mean()
        assert share == pytest.approx(p([*s, 1]) / total, abs=0.015)


def test_gradients_match_finite_differences(spark):
    root = binary_circuit()
    got = inference.node_values(states(spark, False), root, NAMES, gradients=True, lowering="kernel").toPandas()
    for i, k in enumerate(root.children):
        want = [math.log(root.weights[i])] * len(got)
        assert np.allclose(got[f"grad_{k.id}"], want)


def test_normalisation_and_kernels_of_all_leaves(spark):
    root = number(Sum([0.4, 0.6], [Product([Gaussian(0, 1, 2), Categorical(1, [0.2, 0.8]), Uniform(2, 0, 2), Isotonic(3, [0.25, 0.75], [0, 1, 2])]), Product([Gaussian(0, -1, 1), Categorical(1, [0.5, 0.5]), Uniform(2, 1, 3), Isotonic(3, [0.5, 0.5], [0, 2, 4])])]))
    df = spark.range(200).select("id", (F.col("id") / 50 - 2).alias("x0"), (F.col("id") % 2).cast("double").alias("x1"), F.when(F.col("id") % 3 > 0, F.col("id") / 80).alias("x2"), (F.col("id") / 60).alias("x3"))
    a = inference.log_likelihood(df, root, NAMES, lowering="columns").toPandas()
    b = inference.log_likelihood(df, root, NAMES, lowering="kernel").toPandas()
    assert np.allclose(a["ll"], b["ll"], atol=1e-9)
    hidden = df.withColumns({c: F.lit(None).cast("double") for c in ("x0", "x2", "x3")})
    for lowering in ("columns", "kernel"):
        s = inference.sample(hidden, root, NAMES, "id", lowering=lowering)
        assert s.where("x0 is null or x2 is null or x3 is null").count() == 0


def test_rewrites_keep_likelihoods(spark):
    df = states(spark)
    for root in (binary_circuit(), rewrite.to_circuit(fixed_tree())):
        a = inference.log_likelihood(df, root, NAMES).toPandas()["ll"]
        small = rewrite.prune(root)
        assert np.allclose(a, inference.log_likelihood(df, small, NAMES).toPandas()["ll"])
        assert len(post_order(rewrite.prune(small))) == len(post_order(small))
    hide = df.withColumns({c: F.lit(None).cast("int") for c in ("x0", "x2")})
    for root in (binary_circuit(), fixed_tree()):
        part = rewrite.marginalize(root, [1, 3])
        assert set(part.scope) == {1, 3}
        assert np.allclose(inference.log_likelihood(hide, root, NAMES).toPandas()["ll"], inference.log_likelihood(df, part, NAMES).toPandas()["ll"])


def test_store_round_trip(spark, tmp_path):
    for root in (binary_circuit(), fixed_tree(), number(Sum([0.5, 0.5], [Isotonic(0, [0.5, 0.5], [0, 1, 2]), Gaussian(0, 1, 1)]))):
        path = str(tmp_path / "c.json")
        store.save(root, path)
        again = store.load(path)
        assert statistics(again) == statistics(root)
        assert store.to_dict(again) == store.to_dict(root)
    assert "digraph" in store.dot(binary_circuit())


def test_custom_leaf(spark, tmp_path):
    class Laplace(Leaf):
        n_params = 2

        def __init__(self, scope, centre, scale):
            super().__init__(scope)
            self.centre, self.scale = centre, scale

        def log_present(self, b, x):
            d = b.where(x > self.centre, x - self.centre, self.centre - x)
            return d * (-1 / self.scale) - math.log(2 * self.scale)

        def mode(self):
            return self.centre

        def params(self):
            return {"centre": self.centre, "scale": self.scale}

    root = number(Laplace(0, 1.0, 2.0))
    path = str(tmp_path / "l.json")
    store.save(root, path)
    again = store.load(path, leaves=[Laplace])
    df = spark.createDataFrame([(0.0,), (None,), (3.0,)], "x double")
    got = [r["ll"] for r in inference.log_likelihood(df, again, {0: "x"}).collect()]
    assert got == pytest.approx([-0.5 - math.log(4), 0.0, -1 - math.log(4)])
    with pytest.raises(ValueError):
        store.load(path, leaves=[Bernoulli])


def test_validation():
    root = binary_circuit()
    assert validate.problem(root) is None
    root.children[0].children.append(root)
    assert "cycle" in validate.problem(root)
    for bad in (lambda: Sum([0.5, 0.6], [Bernoulli(0), Bernoulli(0)]), lambda: Sum([1.0], [Bernoulli(0)], scope=[1]), lambda: Product([Bernoulli(0), Bernoulli(0)]), lambda: Bernoulli(0, 1.5), lambda: Gaussian(0, 0, 0), lambda: Product([])):
        with pytest.raises(ValueError):
            bad()
    assert validate.is_structured(rewrite.to_circuit(fixed_tree()))
    assert validate.are_compatible(binary_circuit(), binary_circuit())
    with validate.checking(False):
        validate.check(number(binary_circuit()))


def test_orders():
    root = binary_circuit()
    assert [n.id for layer in layers(root) for n in layer] == list(range(16))
    assert len(list(bfs(root))) == 16 and post_order(root)[-1] is root
    assert statistics(root)["depth"] == 2


def test_moments():
    root = number(Sum([0.8, 0.2], [Product([Gaussian(0, 0, 1), Gaussian(1, 0, 1)]), Product([Gaussian(0, 2, 1), Gaussian(1, 2, 0.5)])]))
    m = inference.summary_moments(root)
    assert m[0]["mean"] == pytest.approx(0.4) and m[1]["variance"] == pytest.approx(1.49)
    assert inference.summary_moments(number(Gaussian(0, 1, 1)))[0] == pytest.approx({"mean": 1, "variance": 1, "skewness": 0, "kurtosis": 0})
    assert fixed_tree().marginals()[1] == pytest.approx(0.6 * 0.3 + 0.4 * 0.8)
    with pytest.raises(ValueError):
        inference.moments(root, -1)


def test_spanning_tree_against_all_trees():
    rng = np.random.default_rng(0)
    for d in (3, 4):
        w = rng.random((d, d))
        w = w + w.T
        best = max(sum(w[j, p] for j, p in enumerate(ps) if p >= 0) for ps in itertools.product(range(-1, d), repeat=d) if ps[0] == -1 and ps.count(-1) == 1 and _is_tree(ps))
        got = trees.spanning_tree(w, 0)
        assert sum(w[j, p] for j, p in enumerate(got) if p >= 0) == pytest.approx(best)


def _is_tree(ps):
    from probspark.plans.nodes import tree_order

    try:
        tree_order(list(ps))
    except ValueError:
        return False
    return True


def test_em_raises_likelihood(spark):
    rng = np.random.default_rng(1)
    z = rng.random(800) < 0.4
    x = np.where(z[:, None], rng.normal((-1, 1), 0.25, (800, 2)), rng.normal((1, -1), 0.25, (800, 2)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    root = number(Sum([0.5, 0.5], [Product([Gaussian(0, -0.2, 1), Gaussian(1, 0.2, 1)]), Product([Gaussian(0, 0.2, 1), Gaussian(1, -0.2, 1)])]))
    h = learn.expectation_maximisation(df, root, {0: "a", 1: "b"}, iterations=12, step=0.9)
    assert h[-1] > h[0] and h[-1] == pytest.approx(-0.73, abs=0.1)
    tree = ChowLiu([0, 1], [-1, 0], np.log(np.full((2, 2, 2), 0.5)))
    two = spark.createDataFrame([(0, 0)] * 6 + [(1, 1)] * 4, "a int, b int")
    learn.expectation_maximisation(two, number(tree), {0: "a", 1: "b"}, iterations=3, step=1.0)
    assert tree.marginals() == pytest.approx([0.4, 0.4], abs=1e-2)


def test_learned_circuits_are_normalised(spark):
    rng = np.random.default_rng(3)
    a = rng.random(2500) < 0.5
    rows = [(i, int(x), int(x ^ (rng.random() < 0.1)), int(rng.random() < 0.3), int(x and rng.random() < 0.7)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "id long, x0 int, x1 int, x2 int, x3 int").cache()
    cols, kinds, doms = list(NAMES.values()), [Bernoulli] * 4, [[0, 1]] * 4
    made = {
        "spn": learn.learn_estimator(df, cols, kinds, doms, key="id", split_rows="random", split_cols="gvs", min_rows=600),
        "xpc": learn.learn_estimator(df, cols, kinds, method="xpc", det=True, sd=True),
        "ensemble": learn.learn_estimator(df, cols, kinds, method="ensemble-xpc", size=2, sd_level=1),
        "cnet": trees.learn_cnet(df, cols),
        "bd": trees.learn_cnet_bd(df, cols),
        "bic": trees.learn_cnet_bic(df, cols),
        "tree": number(trees.learn_tree(df, cols)),
    }
    grid = every_assignment(spark, 4)
    for name, root in made.items():
        assert validate.problem(root) is None, name
        total = inference.likelihood(grid, root, NAMES).agg(F.sum("likelihood")).first()[0]
        assert total == pytest.approx(1.0, abs=1e-6), name


def test_splits(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=1200)
    rows = [(i, float(a), float(2 * a + 1), float(a * a), float(rng.normal())) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, e double")
    s = splits.rdc_scores(df, ["a", "b", "c", "e"])
    assert s[0, 1] > 0.99 and s[0, 2] > 0.9 and s[0, 3] < 0.3
    kinds, doms = [Gaussian] * 4, [(0, 1)] * 4
    assert len(set(splits.SPLIT_COLS["rdc"](df, ["a", "b", "c", "e"], kinds, doms, [0, 1, 2, 3]))) == 2
    for name, f in splits.SPLIT_ROWS.items():
        if name in ("dbscan", "wald"):
            continue
        assert f(df, ["a", "b"], kinds, doms, [0, 1], "id", 1).select(splits.OUT).count() == 1200
    bits = df.select("id", (F.col("a") > 0).cast("int").alias("p"), (F.col("b") > 1).cast("int").alias("q"), (F.col("e") > 0).cast("int").alias("r"))
    b = [Bernoulli] * 3
    for name in ("gvs", "rgvs", "wrgvs", "ebvs", "ebvs_ae", "gbvs", "gbvs_ag", "random"):
        assert len(splits.SPLIT_COLS[name](bits, ["p", "q", "r"], b, [[0, 1]] * 3, [0, 1, 2])) == 3
    for name in ("dbscan", "wald"):
        assert splits.SPLIT_ROWS[name](bits, ["p", "q", "r"], b, [[0, 1]] * 3, [0, 1, 2], "id", 1).select(splits.OUT).distinct().count() >= 1
    with pytest.raises(ValueError):
        splits.dbscan(df, ["a"], [Gaussian], [(0, 1)], [0], "id")


def test_transforms_round_trip(spark):
    df = spark.createDataFrame([(0.0, 4.0), (0.5, 2.0), (1.0, 5.0), (None, 3.0)], "a double, b double")
    for t in (transforms.Normalizer(["a", "b"]), transforms.Standardizer(["a", "b"]), transforms.Standardizer(["a", "b"], per_feature=False), transforms.Chain(transforms.Normalizer(["a", "b"]), transforms.Logit(["a", "b"]))):
        got = t.backward(t.fit(df).forward(df)).toPandas()
        assert np.allclose(got, df.toPandas(), equal_nan=True, atol=1e-6)
    image = spark.createDataFrame([(list(map(float, range(32))),)], "x array<double>")
    back = image.select(transforms.squeeze("x", 2, 4, 4).alias("x")).select(transforms.unsqueeze("x", 2, 4, 4).alias("x"))
    assert back.first()["x"] == list(map(float, range(32)))
    for name in transforms.ACTIVATIONS:
        assert df.select(transforms.activation(name)(F.col("b"))).count() == 4


def test_statistics_in_numbers(spark):
    df = spark.createDataFrame([(5.0,), (2.0,), (4.0,), (4.0,), (6.0,), (7.0,), (1.0,), (None,)], "x double")
    assert {r["value"]: round(r["p"] * 7) for r in stats.ecdf(df, "x").collect()} == {1: 1, 2: 2, 4: 4, 5: 5, 6: 6, 7: 7}
    assert [r["mean"] for r in stats.mean_quantiles(df, "x", 3).orderBy("chunk").collect()] == pytest.approx([7 / 3, 4.5, 6.5])
    assert stats.frechet(np.zeros(2), np.eye(2), np.full(2, 4.0), 9 * np.eye(2)) == pytest.approx(32 + 2 + 18 - 12)
    parts = hash_split(spark.range(1000), "id")
    assert sum(p.count() for p in parts) == 1000


def test_running_sums_under_cuts_that_vary(spark, monkeypatch):
    """A sketch's cuts differ each time they are worked out; sums and ranks of one plan must see the same ones."""
    import random

    drawn = F.udf(lambda found: sorted(random.sample(found, 50)), "array<double>").asNondeterministic()
    monkeypatch.setattr(stats.F, "approx_percentile", lambda col, *_: drawn(F.collect_list(col)))
    counts = spark.range(400).select((F.col("id") % 2).alias("key"), F.col("id").cast("double").alias("value"), F.lit(2).alias("n"))
    for r in stats.cumulative_by(counts, "key").collect():
        assert r["upto"] == 2 * (r["value"] // 2 + 1) and r["total"] == 400
