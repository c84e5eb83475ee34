"""Product quantisation against a plain one, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.llm import vectorcodes as v


def plain(x, parts, entries, rounds):
    """All distances, entry by entry."""
    books = [q[:entries].copy() for q in np.split(x, parts, 1)]
    at = lambda q, b: ((q[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for q, b in zip(np.split(x, parts, 1), books, strict=True):
            near = at(q, b).argmin(1)
            for e in set(near):
                mine = q[near == e]
                b[e] = [int(s) // len(mine) for s in mine.sum(0)]
    d = [at(q, b) for q, b in zip(np.split(x, parts, 1), books, strict=True)]
    return books, np.stack([x.argmin(1) for x in d], 1), sum(x.min(1) for x in d)


@pytest.mark.parametrize("n,d,cells,spread", [(1, 3, 16, 5), (7, 2, 4, 2), (256, 16, 16, 1000), (256, 4, 16, 3), (100, 8, 5, 50)])
def test_bounds_and_nearest(n, d, cells, spread):
    rng = np.random.default_rng(n)
    entries, q = rng.integers(-spread, spread, (n, d)), rng.integers(-2 * spread, 2 * spread, (300, d))
    file = v.Cells(entries, cells)
    low, high = file.bounds(q)
    d2 = ((q[:, None] - entries[None]) ** 2).sum(2)
    assert (low <= d2).all() and (d2 <= high).all()
    at, best = file.nearest(q)
    assert (at == d2.argmin(1)).all() and (best == d2.min(1)).all()
    if n == 256 and d == 16:
        assert (low <= high.min(1)[:, None]).mean() < 0.5  # the file spares most comparisons


def test_far_components_stay_exact():
    entries = np.array([[2**26, 0], [-(2**26), 1]])
    at, best = v.Cells(entries).nearest(np.array([[2**26, 5], [-(2**26), 1]]))
    assert at.tolist() == [0, 1] and best.tolist() == [25, 0]


def test_equals_plain(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[100:200] = x[0]  # a hot vector, and ties
    rows = [(i, [float(a) for a in r], None if i % 3 == 0 else i % 2) for i, r in enumerate(x)]
    odd = [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1002, [1.0, None] * 4, 1), (1003, [float("inf")] * 8, 1), (1004, [], 1), (1005, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(1)).repartition(5)
    whole = np.floor(1024 * x).astype(np.int64)
    books, codes, error = plain(whole, 4, 32, 4)
    got = v.compress(df, entries=32).orderBy("vec_id").toPandas()
    assert got["vec_id"].tolist() == list(range(400))
    assert got["code"].tolist() == ["".join(f"{c:02x}" for c in r) for r in codes] and got["error"].tolist() == error.tolist()
    label = np.array([-1 if r[2] is None else r[2] for r in rows])
    assert got["label_error"].tolist() == [int(error[label == k].sum()) for k in label]
    made = v.train(df, entries=32)
    assert all((a == b).all() for a, b in zip(made.parts, books, strict=True)) and set(got["codebooks_sha256"]) == {made.sha256()}
    assert ((np.floor(1024 * x) - 1024 * made.decode(got["code"].tolist())) ** 2).sum(1).astype(int).tolist() == error.tolist()


def test_nothing_to_compress(spark):
    df = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    got = v.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and not got.count()
    ids = spark.createDataFrame([(None, [1.0] * 4, None), (2, [1.0] * 4, None), (2, [1.0] * 4, None)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r)[:4] for r in v.compress(ids).orderBy("vec_id").collect()] == [(None, "00000000", 0, 0), (2, "00000000", 0, 0), (2, "00000000", 0, 0)]
    with pytest.raises(ValueError):
        v.compress(spark.createDataFrame([(1, [1.0] * 3, 1)], "vec_id long, embedding array<double>, label int"))
