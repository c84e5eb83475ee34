"""Row clusters over whole tables, and flows as column transforms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probspark.operators import splits, tensors
from probspark.plans.nodes import Categorical, Gaussian


def plain_ward(x: np.ndarray, n: int) -> list[set]:
    """Least growth of the sum of squares, tried for every pair of groups of rows."""
    groups = [x[(x == v).all(1)] for v in np.unique(x, axis=0)]
    cost = lambda g: ((g - g.mean(0)) ** 2).sum()
    while len(groups) > n:
        pairs = [(cost(np.vstack([a, b])) - cost(a) - cost(b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = min(pairs)
        groups[i] = np.vstack([groups[i], groups.pop(j)])
    return [{tuple(r) for r in g} for g in groups]


def labelled(df, cols):
    out = {}
    for r in df.collect():
        out.setdefault(r[splits.OUT], set()).add(tuple(float(r[c]) for c in cols))
    return out


def test_ward_is_agglomeration(spark):
    # one feature for each row pattern: 5 x 4 one-hot cells of unequal counts
    rng = np.random.default_rng(3)
    x = np.stack([rng.choice(5, 300, p=[0.4, 0.25, 0.2, 0.1, 0.05]), rng.choice(4, 300, p=[0.5, 0.3, 0.15, 0.05])], 1)
    df = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(x)], "id long, a int, b int")
    got = splits.ward(df, ["a", "b"], [Categorical] * 2, [[0, 1, 2, 3, 4], [0, 1, 2, 3]], [0, 1], "id", n=3)
    assert got.count() == 300
    hot = np.hstack([np.eye(5)[x[:, 0]], np.eye(4)[x[:, 1]]])
    want = [{(float(r[:5].index(1.0)), float(r[5:].index(1.0))) for r in g} for g in plain_ward(hot, 3)]
    assert sorted(map(sorted, labelled(got, "ab").values())) == sorted(map(sorted, want))


def test_ward_of_more_rows_than_cells(spark):
    # 16 binary columns: 8 leading ones or 8 leading noughts, and 8 free bits; rare rows count as well
    cols = [f"c{i}" for i in range(16)]
    df = spark.range(1024).select("id", *[(F.col("id") % 2).cast("int").alias(c) for c in cols[:8]], *[F.shiftright("id", i + 1).bitwiseAND(F.lit(1)).cast("int").alias(c) for i, c in enumerate(cols[8:])])
    got = splits.ward(df, cols, [Categorical] * 16, [[0, 1]] * 16, list(range(16)), "id", n=2, most=40)
    assert got.columns == [*df.columns, splits.OUT] and got.count() == 1024
    parts = labelled(got, cols)
    assert len(parts) == 2 and all(len({r[0] for r in p}) == 1 for p in parts.values())


def test_ward_of_nothing(spark):
    df = spark.createDataFrame([], "id long, a int")
    assert splits.ward(df, ["a"], [Categorical], [[0, 1]], [0], "id").count() == 0


def test_minibatches_find_the_centres(spark):
    df = spark.range(4000).select("id", (F.when(F.col("id") % 4 == 0, 5.0).otherwise(-5.0) + F.randn(1)).alias("a"), F.randn(2).alias("b"))
    df = df.persist()
    got = splits.kmeans_minibatch(df, ["a", "b"], [Gaussian] * 2, [(-9.0, 9.0)] * 2, [0, 1], "id", batch=400, steps=5)
    rows = got.groupBy((F.col("id") % 4 == 0).alias("far"), splits.OUT).count().collect()
    assert sorted((r["far"], r["count"]) for r in rows) == [(False, 3000), (True, 1000)]


@pytest.mark.parametrize("name", ["nice", "realnvp", "maf"])
def test_encode_decode(spark, name):
    flow = {"nice": tensors.nice(3), "realnvp": tensors.realnvp(3, batch_norm=True), "maf": tensors.maf(3)}[name]
    rng = np.random.default_rng(0)
    for k, v in flow.params.items():
        flow.params[k] = v + rng.normal(0, 0.1, v.shape)
    cols = ["x", "y", "z"]
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=3))) for i in range(20)], "id long, x double, y double, z double")
    u = tensors.encode(df, flow, cols)
    normal = -0.5 * sum(F.col(c) ** 2 for c in cols) - 1.5 * np.log(2 * np.pi)
    ll = dict(u.select("id", normal + F.col("log_det")).collect())
    assert all(np.isclose(ll[r["id"]], r["ll"]) for r in tensors.score(df, flow, cols).collect())
    back = tensors.decode(u, flow, cols).orderBy("id").toPandas()
    assert np.allclose(back[cols], df.orderBy("id").toPandas()[cols], atol=1e-8)


def test_all_starts_move_together(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.5, (200, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6))])
    x[:150] = x[0]  # a hot row
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double").repartition(6)
    got = splits.kmeans(df, ["a", "b"], [Gaussian] * 2, [(-9.0, 9.0)] * 2, [0, 1], "id", n=4).toPandas().sort_values("id")
    assert got.groupby(splits.OUT)["id"].apply(lambda s: set(s // 200)).map(len).tolist() == [1, 1, 1, 1]
    # the sums of one pass are those of plain arithmetic, for every start
    rows = df.groupBy("a", "b").agg(F.count(F.lit(1)).alias("__n"))
    centres = rng.normal(3, 3, (3, 4, 2))
    taken, sums, loss = splits._lloyd_sums(rows, ["a", "b"], centres)
    for s in range(3):
        far = ((x[:, None] - centres[s][None]) ** 2).sum(2)
        near = far.argmin(1)
        assert taken[s].tolist() == [int((near == k).sum()) for k in range(4)] and loss[s] == pytest.approx(far.min(1).sum())
        assert np.allclose(sums[s], [x[near == k].sum(0) for k in range(4)])
    none = splits.kmeans(df.limit(0), ["a", "b"], [Gaussian] * 2, [(-9.0, 9.0)] * 2, [0, 1], "id")
    assert none.count() == 0 and splits.OUT in none.columns
    few = splits.kmeans(df.where("a = %r" % float(x[0, 0])), ["a", "b"], [Gaussian] * 2, [(-9.0, 9.0)] * 2, [0, 1], "id", n=3)
    assert few.select(splits.OUT).distinct().count() == 1


def test_ranks_of_a_skewed_column(spark):
    rng = np.random.default_rng(2)
    v = np.where(rng.random(2000) < 0.9, 3.0, rng.normal(0, 5, 2000))
    rows = [(i, None if i % 50 == 0 else float("nan") if i % 51 == 0 else float(a)) for i, a in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v double").repartition(5)
    from probspark.functions import stats

    got = stats.ranked(df, "v", "p").toPandas().sort_values("id")
    known = np.sort([a for _, a in rows if a is not None and a == a])
    for (_, a), p in zip(rows, got["p"], strict=True):
        assert np.isnan(p) if a is None or a != a else p == np.searchsorted(known, a, "right") / len(known)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:  # rows of the heavy value and missing cells are dealt over many keys of the join
        made = stats.ranked(df, "v", "p")
        assert "SortMergeJoin" in made._jdf.queryExecution().executedPlan().toString()
        assert made.where("p IS NULL").count() == got["p"].isna().sum()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_domains_have_a_bound(spark):
    from probspark.functions import stats

    df = spark.range(100).select((F.col("id") % 7).alias("a"), (F.col("id") / 3).alias("b"), F.lit(None).cast("int").alias("c"))
    assert stats.domains(df, ["a", "b", "c"], [True, False, True]) == [[float(i) for i in range(7)], (0.0, 33.0), []]
    with pytest.raises(ValueError):
        stats.domains(df, ["b"], [True], most=99)
