"""Hard negatives against all pairs, with blocks and groups of a few rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.llm import negatives as n


def brute(rows, every, positives=5, negatives=3):
    """rows: (id, vector of whole numbers, label)."""
    out = set()
    for i, a, la in rows:
        if i % every:
            continue
        score = [(-int(a @ x), j, lb) for j, x, lb in rows if j != i]
        for p, pid, _ in sorted(s for s in score if s[2] == la)[:positives]:
            band = sorted(s for s in score if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out |= {(i, pid, k + 1, nid, -p, -s) for k, (s, nid, _) in enumerate(band)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [float(a) for a in x], y) for i, x, y in rows], "vec_id long, embedding array<double>, label int").repartition(5)


def table(seed, rows=300, d=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 2, (5, d))
    y = rng.integers(0, 5, rows)
    x = centres[(y + (rng.random(rows) < 0.3)) % 5] + rng.normal(0, 0.3, (rows, d))
    x[50:120] = x[50]  # ties, and a cell that holds many rows
    y[50:80] = y[50]
    return [(int(i), v, int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))]


@pytest.mark.parametrize("seed,config", [(1, n.Config()), (2, n.Config(pivots=7, block=5, portion=16, group=6)), (3, n.Config(pivots=1, group=1)), (4, n.Config(pivots=40, block=2, group=1))])
def test_equals_all_pairs(spark, seed, config):
    rows = table(seed)
    got = {tuple(r) for r in n.mine(frame(spark, rows), F.col("id") % 10 == 0, config=config).collect()}
    want = brute([(i, np.floor(256 * x).astype(np.int64), y) for i, x, y in rows], 10)
    assert got == want and want


def test_rings_leave_rows_out():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(8, 4))[rng.integers(0, 8, 400)] * 300 + rng.normal(0, 5, (400, 4))).astype(np.int64)
    space = n.Voronoi(x, int((x * x).sum(1).max()), 8, 4)
    cell, r = space.cells(x)
    d = space.anchors(x[:5])
    for a, own in zip(x[:5], d, strict=True):
        near = np.sqrt(np.maximum((a * a).sum() + space.most - 2 * (x @ a), 0))
        assert (near >= own[cell] - r - space.slack()).all() and (near <= own[cell] + r + space.slack()).all()


def test_rows_that_take_no_part(spark):
    rows = table(5, 60)
    odd = [(600, None, 1), (610, [float("nan")] * 6, 1), (620, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (630, [float("inf")] * 6, 2), (640, rows[3][1], None), (None, rows[4][1], 1), (650, [], 1), (660, [1.0], 1)]
    df = spark.createDataFrame([(i, None if x is None else [None if a is None else float(a) for a in x], y) for i, x, y in rows + odd], "vec_id long, embedding array<double>, label int")
    df = df.withColumn("id", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("cell", F.lit(1)).withColumn("vec", F.lit(1))
    got = {tuple(r) for r in n.mine(df, F.col("id") % 10 == 0).collect()}
    assert got == brute([(i, np.floor(256 * x).astype(np.int64), y) for i, x, y in rows], 10)
    assert n.mine(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert n.mine(df.where("vec_id = 1"), F.col("id") % 10 == 0).count() == 0
    assert n.mine(df.where("vec_id = 10"), F.col("id") % 10 == 0).count() == 0


def test_products_beyond_doubles():
    a = np.array([[2**26, 2**26 - 1, 1]])
    x = np.array([[2**26, 2**26 - 3, 5]])
    assert n._products(a, x)[0, 0] == sum(int(p) * int(q) for p, q in zip(a[0], x[0], strict=True))
