"""Array files by partitions, preparation recipes, kinds of numbers."""

import importlib.util

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.plans.validate import checking
from probspark.sources import arrays, recipes


@pytest.mark.parametrize("kind", ["f8", "f4", "i8", "i4", "u1", ">f8", "b1"])
def test_npy_by_ranges(spark, tmp_path, kind):
    x = np.random.default_rng(0).integers(0, 2 if kind == "b1" else 200, (1000, 5)).astype(kind)
    np.save(tmp_path / "x.npy", x)
    df = arrays.read_npy(spark, str(tmp_path / "x.npy"), range_bytes=150 * 5 * x.dtype.itemsize)
    assert df.columns == [f"c{i}" for i in range(5)] and df.rdd.getNumPartitions() == 7
    assert (df.toPandas().to_numpy().astype(float) == x.astype(float)).all()
    some = arrays.read_npy(spark, f"file://{tmp_path}/x.npy", [3, 1])
    assert some.columns == ["c3", "c1"] and (some.toPandas().to_numpy().astype(float) == x[:, [3, 1]].astype(float)).all()


def test_npy_ends(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(7.0))
    assert [r[0] for r in arrays.read_npy(spark, str(tmp_path / "one.npy")).collect()] == list(range(7))
    np.save(tmp_path / "none.npy", np.empty((0, 3)))
    assert arrays.read_npy(spark, str(tmp_path / "none.npy")).count() == 0
    np.save(tmp_path / "by_columns.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(tmp_path / "cube.npy", np.ones((2, 2, 2)))
    np.save(tmp_path / "text.npy", np.array(["a"]))
    for bad in ("by_columns", "cube", "text"):
        with pytest.raises(Exception, match="rows|dimensions"):
            arrays.read_npy(spark, str(tmp_path / f"{bad}.npy")).count()
    with pytest.raises(Exception, match="columns are 0 to 0"):
        arrays.read_npy(spark, str(tmp_path / "one.npy"), [2]).count()


def test_hdf5(spark, tmp_path):
    if importlib.util.find_spec("h5py") is None:
        with pytest.raises(Exception, match="h5py"):
            arrays.read_hdf5(spark, str(tmp_path / "x.hdf5"), "train").count()
        return
    import h5py

    x = np.random.default_rng(0).random((100, 3))
    with h5py.File(tmp_path / "x.hdf5", "w") as f:
        for name in ("train", "validation", "test"):
            f[name] = x
    for df in recipes.bsds300(spark, str(tmp_path / "x.hdf5")).values():
        assert np.allclose(df.toPandas().to_numpy(), x)


def test_correlated_columns_go_in_turn(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=500), rng.normal(size=500)
    x = np.stack([a, b, -a, a + 1e-3 * rng.normal(size=500), b * 2 + 1, a * 3, rng.normal(size=500)], 1)
    cols = list("uvwxyzt")
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{c} double" for c in cols))
    left = list(range(7))  # the loop written out
    while True:
        near = (np.corrcoef(x[:, left].T) > 0.98).sum(1)
        if not (near > 1).any():
            break
        left.pop(int(np.flatnonzero(near > 1)[0]))
    assert recipes.drop_correlated_in_turn(df, cols) == [cols[i] for i in left] == ["w", "y", "z", "t"]


def test_recurring_columns(spark):
    df = spark.range(100).select("id", F.greatest(F.col("id"), F.lit(5)).alias("six"), F.greatest(F.col("id"), F.lit(4)).alias("five"), F.lit(1).alias("all"), (F.col("id") % 2).alias("y"))
    assert recipes.drop_recurring(df, ["id", "six", "five", "all"]) == ["id", "five"]
    found = recipes.hepmass(df, df.withColumn("more", F.lit(0)), "y", ["six", "five", "all"], ["id"])
    assert found["test"].columns == ["id", "six", "five"] and found["test"].count() == 50
    assert found["train"].count() + found["valid"].count() == 50


def test_power_and_parts(spark):
    cols = [f"x{i}" for i in range(8)]
    df = spark.range(3000).select("id", *[(F.col("id") * (i + 1)).cast("double").alias(c) for i, c in enumerate(cols)])
    made = recipes.power(df, cols, ["id"])
    assert made.columns == ["id", "x0", "x2", "x4", "x5", "x6", "x7"]
    p = made.toPandas().sort_values("id")
    for c, w in zip(made.columns[1:], recipes.POWER_NOISE, strict=True):
        noise = p[c] - p["id"] * (int(c[1:]) + 1)
        assert noise.min() >= 0 and noise.max() <= w and (w == 0 or noise.std() > 0.25 * w)
    assert made.repartition(5).toPandas().sort_values("id").reset_index(drop=True).equals(p.reset_index(drop=True))
    split = recipes.parts(made, ["id"])
    assert sum(x.count() for x in split.values()) == 3000 and 200 < split["valid"].count() < 350
    z = recipes.standardised(split, made.columns[1:])["train"].toPandas()[made.columns[1:]]
    assert np.allclose(z.mean(), 0, atol=1e-6) and np.allclose(z.std(ddof=0), 1, atol=1e-6)
    with pytest.raises(ValueError):
        recipes.power(df, cols[:7], ["id"])


def test_kinds(spark):
    df = spark.createDataFrame([(1, 2, 3.0, 4.0)], "i int, l long, f float, d double")
    assert [k for _, k in recipes.as_kind(df, df.columns).dtypes] == ["float", "float", "float", "double"]
    assert [k for _, k in recipes.as_kind(df, df.columns, "int").dtypes] == ["int", "bigint", "int", "int"]
    with checking(kinds=False):
        assert recipes.as_kind(df, df.columns).dtypes == df.dtypes
    assert recipes.target_of(df, "l", False).columns == ["i", "f", "d"] and recipes.target_of(df, "l", True) is df
