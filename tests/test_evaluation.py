"""Functions of one's own carried through both directions of a circuit, in both lowerings."""

import itertools

import numpy as np
import pytest

from probspark.operators import inference
from probspark.plans.nodes import Bernoulli, Categorical, Product, Sum, number

NAMES = {0: "a", 1: "b", 2: "c"}


def circuit():
    left = Product([Bernoulli(0, 0.3), Bernoulli(1, 0.9)])
    right = Product([Bernoulli(0, 0.8), Bernoulli(1, 0.45)])
    return number(Sum([0.55, 0.45], [Product([Sum([0.5, 0.5], [left, right]), Categorical(2, [0.2, 0.5, 0.3])]), Product([Bernoulli(0, 0.6), Bernoulli(1, 0.2), Categorical(2, [0.1, 0.1, 0.8])])]))


@pytest.fixture(scope="module")
def rows(spark):
    every = list(itertools.product([0.0, 1.0, None], [0.0, 1.0, None], [0.0, 1.0, 2.0, None]))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(every)], "id long, a double, b double, c double")


def peak(b, n):
    top = np.log(max(n.p, 1 - n.p)) if isinstance(n, Bernoulli) else np.log(max(n.probabilities))
    return b.where(b.missing(b.x(n.scope[0])), b.const(top), n.log(b, b.x))


@pytest.mark.parametrize("lowering", ["columns", "kernel"])
def test_defaults_are_the_librarys_own(rows, lowering):
    got = inference.evaluate(rows, circuit(), NAMES, lowering=lowering).orderBy("id").toPandas()
    assert np.allclose(got["value"], inference.log_likelihood(rows, circuit(), NAMES).orderBy("id").toPandas()["ll"])
    assert inference.descend(rows, circuit(), NAMES, lowering=lowering).orderBy("id").toPandas().equals(inference.mpe(rows, circuit(), NAMES).orderBy("id").toPandas())
    drawn = inference.descend(rows, circuit(), NAMES, branch=inference.drawn_branch, fill=inference.leaf_draw, key="id", lowering=lowering)
    assert drawn.orderBy("id").toPandas().equals(inference.sample(rows, circuit(), NAMES, "id").orderBy("id").toPandas())


@pytest.mark.parametrize("lowering", ["columns", "kernel"])
def test_max_product(rows, lowering):
    root = circuit()
    trees = [(0.55 * 0.5, (0.3, 0.9), (0.2, 0.5, 0.3)), (0.55 * 0.5, (0.8, 0.45), (0.2, 0.5, 0.3)), (0.45, (0.6, 0.2), (0.1, 0.1, 0.8))]
    got = inference.evaluate(rows, root, NAMES, peak, inference.inner_max, nodes=True, lowering=lowering).orderBy("id").toPandas()
    filled = inference.descend(rows, root, NAMES, peak, inference.inner_max, lowering=lowering).orderBy("id").toPandas()
    for r, f in zip(got.itertuples(), filled.itertuples(), strict=True):
        fits = [
            (w * (p[0] if a else 1 - p[0]) * (p[1] if b else 1 - p[1]) * q[int(c)], (a, b, c))
            for w, p, q in trees for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 1.0, 2.0)
            if all(x is None or np.isnan(x) or x == y for x, y in zip((r.a, r.b, r.c), (a, b, c), strict=True))
        ]
        top = max(v for v, _ in fits)
        assert r.value == pytest.approx(np.log(top)) and r.value_0 == r.value
        assert any(v == pytest.approx(top) and x == (f.a, f.b, f.c) for v, x in fits)


def test_functions_over_arrays(rows):
    """A count of known cells, which has no logs at all."""
    known = lambda b, n: (~np.isnan(b.x(n.scope[0]))).astype(float)
    total = lambda b, n, v: np.mean(v, axis=0) if isinstance(n, Sum) else np.sum(v, axis=0)
    got = inference.evaluate(rows, circuit(), NAMES, known, total, "n", lowering="kernel").toPandas()
    assert (got["n"] == got[["a", "b", "c"]].notna().sum(axis=1)).all()
