"""Expectation maximisation reaches what the generating model reaches, for every kind of leaf."""

import numpy as np
import pytest

from probspark.operators import inference, learn
from probspark.plans.nodes import Bernoulli, Categorical, ChowLiu, Gaussian, Product, Sum, number


def mean_ll(df, root, names):
    return inference.log_likelihood(df, root, names).agg({"ll": "avg"}).first()[0]


def test_shared_gaussian_leaves(spark):
    """Two blobs; leaves are shared by three products."""
    rng = np.random.default_rng(1337)
    side = rng.integers(0, 2, 1000)
    x = np.stack([2.0 * side - 1, 1 - 2.0 * side], 1) + rng.normal(0, 0.25, (1000, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    a, b, c, d = Gaussian(0, -0.5, 0.5), Gaussian(1, 0.5, 0.5), Gaussian(0, 0.5, 0.5), Gaussian(1, -0.5, 0.5)
    root = number(Sum([0.3, 0.5, 0.2], [Product([a, b]), Product([c, d]), Product([a, d])]))
    learn.expectation_maximisation(df, root, {0: "a", 1: "b"}, iterations=25, share=0.1, step=0.5, random_start=True, key="id")
    true = number(Sum([0.5, 0.5], [Product([Gaussian(0, -1, 0.25), Gaussian(1, 1, 0.25)]), Product([Gaussian(0, 1, 0.25), Gaussian(1, -1, 0.25)])]))
    assert mean_ll(df, root, {0: "a", 1: "b"}) == pytest.approx(mean_ll(df, true, {0: "a", 1: "b"}), abs=0.05)


def test_far_from_zero(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(1e8, 0.5, 500)], "a double")
    root = number(Sum([1.0], [Gaussian(0, 1e8 + 1, 3.0)]))
    learn.expectation_maximisation(df, root, {0: "a"}, iterations=3, step=1.0)
    assert root.children[0].stddev == pytest.approx(0.5, abs=0.05)


def binary(rng, n=1000):
    """A chain of ten variables under one of two regimes."""
    z = rng.random(n) < 0.4
    x = np.empty((n, 10), int)
    x[:, 0] = rng.random(n) < np.where(z, 0.8, 0.3)
    for j in range(1, 10):
        x[:, j] = rng.random(n) < np.where(x[:, j - 1] == 1, np.where(z, 0.9, 0.6), np.where(z, 0.3, 0.2))
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{j} int" for j in range(x.shape[1])))


def test_trees_from_a_random_start(spark):
    df, names = frame(spark, binary(np.random.default_rng(42))), {j: f"x{j}" for j in range(10)}
    chain = [-1, *range(9)]
    table = lambda p0, on, off: np.log([[[1 - p0, p0]] * 2] + [[[1 - off, off], [1 - on, on]]] * 9)
    true = number(Sum([0.4, 0.6], [ChowLiu(range(10), chain, table(0.8, 0.9, 0.3)), ChowLiu(range(10), chain, table(0.3, 0.6, 0.2))]))
    root = number(Sum([0.5, 0.5], [ChowLiu(range(10), chain, table(0.5, 0.5, 0.5)), ChowLiu(range(10), chain, table(0.5, 0.5, 0.5))]))
    h = learn.expectation_maximisation(df, root, names, iterations=60, share=0.3, step=0.5, random_start=True, key="id")
    assert len(h) == 60 and mean_ll(df, root, names) > mean_ll(df, true, names) - 0.05


def test_learned_circuit_gains(spark):
    x = binary(np.random.default_rng(7))
    df, names = frame(spark, x), {j: f"x{j}" for j in range(10)}
    root = number(Sum([0.5, 0.5], [Product([Bernoulli(j, 0.3 + 0.04 * j + 0.1 * k) for j in range(10)]) for k in range(2)]))
    alone = number(Product([Bernoulli(j, x[:, j].mean()) for j in range(10)]))
    learn.expectation_maximisation(df, root, names, iterations=30, share=0.5, step=0.5, key="id")
    assert mean_ll(df, root, names) > mean_ll(df, alone, names) + 0.2


def test_categories_and_missing_cells(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 2, 1500)
    p = np.array([[0.7, 0.2, 0.1], [0.1, 0.1, 0.8]])
    x = np.stack([[rng.choice(3, p=p[k]) for k in z] for _ in range(3)], 1).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    names = {0: "a", 1: "b", 2: "c"}
    root = number(Sum([0.6, 0.4], [Product([Categorical(v, q) for v in range(3)]) for q in ([0.5, 0.3, 0.2], [0.3, 0.3, 0.4])]))
    h = learn.expectation_maximisation(df, root, names, iterations=25, step=1.0)
    true = number(Sum([0.5, 0.5], [Product([Categorical(v, q) for v in range(3)]) for q in p]))
    assert all(b >= a - 1e-9 for a, b in zip(h, h[1:]))  # whole steps over all rows never lose
    assert mean_ll(df, root, names) == pytest.approx(mean_ll(df, true, names), abs=0.02)


def test_wrong_options(spark):
    df, root = frame(spark, binary(np.random.default_rng(0), 5)), number(Product([Bernoulli(j, 0.5) for j in range(10)]))
    for bad in ({"iterations": 0}, {"step": 0.0}, {"share": 1.0}):
        with pytest.raises(ValueError):
            learn.expectation_maximisation(df, root, {j: f"x{j}" for j in range(10)}, **bad)


def test_partitions_without_rows(spark):
    """Three rows in eight partitions: those without any give no sums, and the steps are those of one partition."""
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1)], "a int, b int")
    found = []
    for n in (8, 1):
        root = number(Sum([0.5, 0.5], [Product([Bernoulli(0, 0.3), Bernoulli(1, 0.6)]), Product([Bernoulli(0, 0.8), Bernoulli(1, 0.1)])]))
        h = learn.expectation_maximisation(df.repartition(n), root, {0: "a", 1: "b"}, iterations=3)
        found.append([*h, *root.weights])
    assert found[0] == pytest.approx(found[1])
    assert learn.expectation_maximisation(df.where("a > 1"), root, {0: "a", 1: "b"}, iterations=2) == []
