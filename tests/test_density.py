"""Density clusters of discrete rows: every group of equal rows has a label of its own, however many there are."""

from probspark.operators import splits
from probspark.plans.nodes import Categorical


def test_more_clusters_than_any_cap(spark):
    df = spark.range(9000).selectExpr("id", "cast(id % 1500 as int) a", "cast(id % 2 as int) b").unionAll(spark.range(3).selectExpr("id + 9000", "cast(2000 + id as int)", "0"))
    got = splits.dbscan(df, ["a", "b"], [Categorical] * 2, [list(range(3000)), [0, 1]], [0, 1], "id").collect()
    assert len(got) == 9003
    labels = {}
    for r in got:
        labels.setdefault(r[splits.OUT], set()).add((r["a"], r["b"]))
    assert sorted(labels) == [-1, *range(1500)]
    assert all(len(v) == 1 for k, v in labels.items() if k >= 0) and len(labels[-1]) == 3
    assert labels[0] == {(0, 0)} and labels[1499] == {(1499, 1)}
