"""Random circuits: structure with the trees inside leaves counted, normalisation; partitions; reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.functions import stats
from probspark.operators import inference, learn
from probspark.operators.partition import Partition
from probspark.plans import validate
from probspark.plans.nodes import ChowLiu, number, of_type
from probspark.sources.matrices import every_assignment

D = 7
COLS = [f"x{i}" for i in range(D)]


@pytest.fixture(scope="module")
def bits(spark):
    rng = np.random.default_rng(11)
    x = (rng.random((1500, D)) < rng.uniform(0.3, 0.7, D)).astype(int)
    x[:, 1] ^= x[:, 4]
    return spark.createDataFrame([tuple(map(int, r)) for r in x], ", ".join(f"{c} int" for c in COLS)).repartition(2).cache()


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("det", [False, True])
def test_structured_with_tree_leaves(bits, seed, det):
    root = learn.learn_xpc(bits, COLS, det=det, sd=True, seed=seed, arity=3)
    assert len(list(of_type(root, ChowLiu))) > 2
    assert validate.problem(root, structured=True) is None


def test_ensembles(spark, bits):
    free = learn.learn_ensemble(bits, COLS, size=2, sd_level=1)
    assert validate.problem(free) is None and not validate.is_structured(free)
    assert all(validate.is_structured(c) for c in free.children)
    whole = learn.learn_ensemble(bits, COLS, size=2, sd_level=2, arity=3)
    assert validate.problem(whole, structured=True) is None
    assert validate.are_compatible(*whole.children)
    scored = inference.log_likelihood(every_assignment(spark, D), whole, dict(enumerate(COLS)))
    assert scored.agg(F.sum(F.exp("ll"))).first()[0] == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        learn.learn_ensemble(bits, COLS, sd_level=2, conj=1)


def test_product_scopes_see_conflicts():
    p = np.log(np.full((3, 2, 2), 0.5))
    a, b = ChowLiu([0, 1, 2], [-1, 0, 1], p), ChowLiu([0, 1, 2], [1, 2, -1], p)
    assert sorted(a.product_scopes()) == [(0, 1, 2), (1, 2)]
    assert validate.is_structured(number(a)) and not validate.are_compatible(a, b)


def test_partitions(bits):
    whole = Partition(tuple(range(D)))
    parts = whole.split_rows((2, 5), [(0, 1), (1, 1)])
    rows = {tuple(r) for p in parts for r in p.slice(bits, COLS).collect()}
    assert sum(p.slice(bits, COLS).count() for p in parts) == 1500 and rows == {tuple(r) for r in bits.collect()}
    inner, rest = parts[1].split_cols((2, 5))
    assert {tuple(r) for r in inner.slice(bits, COLS).collect()} == {(0, 1)}
    assert rest.slice(bits, COLS).columns == ["x0", "x1", "x3", "x4", "x6"]
    deeper = parts[0].split_rows((0,), [(1,)])
    assert sum(p.slice(bits, COLS).count() for p in deeper) == parts[0].slice(bits, COLS).count()


def test_report(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (None, 1)], "a int, p int")
    got = {r["label"]: r for r in stats.classification_report(df, "a", "p").collect()}
    assert (got["1"]["precision"], got["1"]["recall"], got["1"]["support"]) == (0.5, 1.0, 2)
    assert (got["2"]["precision"], got["2"]["f1"]) == (0.0, 0.0) and got["0"]["recall"] == 0.5
    assert got["accuracy"]["f1"] == pytest.approx(0.6) and got["macro"]["recall"] == pytest.approx(0.5)
    assert got["weighted"]["precision"] == pytest.approx((2 * 1 + 2 * 0.5) / 5)
    assert stats.classification_report(df.limit(0), "a", "p").count() == 0
