"""Targets, flows of least cost and what documents give, against plain ways."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from probspark.llm import mixing as m


def test_targets_are_shared_again():
    got = {s: Fraction(*x) for s, x in m.targets({"a": 10, "b": 1000, "c": 5, None: 85}, {"a": 1, "b": 2, "c": 3, None: 1}, 1100).items()}
    assert got["c"] == 15 and got["a"] == 30 and got[None] == 255 and got["b"] == 800
    assert sum(got.values()) == 1100
    assert m.targets({"a": 0, "b": 0}, {"a": 1, "b": 2}, 0) == {"a": (0, 3), "b": (0, 3)}
    assert m.targets({}, {}, 0) == {}


def cheapest(supply, quotas, most):
    """All whole flows: the greatest, and its least convex cost."""
    arcs = [(p, s) for p in supply for s in p]
    best = (-1, 0)
    for f in itertools.product(*[range(min(most * supply[p], quotas[s]) + 1) for p, s in arcs]):
        given, got = dict.fromkeys(supply, 0), dict.fromkeys(quotas, 0)
        for (p, s), x in zip(arcs, f, strict=True):
            given[p] += x
            got[s] += x
        if all(given[p] <= most * supply[p] for p in supply) and all(got[s] <= quotas[s] for s in quotas):
            cost = sum(k * max(0, min(given[p] - k * supply[p], supply[p])) for p in supply for k in range(most))
            best = max(best, (sum(f), -cost))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_route_costs_least(seed):
    rng = random.Random(seed)
    patterns = rng.sample([("a",), ("b",), ("a", "b"), ("b", None), ("a", None)], 3)
    supply = {p: rng.randint(1, 2) for p in patterns}
    quotas = {s: rng.randint(0, 4) for s in {s for p in patterns for s in p}}
    flows = m.route(supply, quotas, 3)
    given = {p: sum(f.values()) for p, f in flows.items()}
    cost = sum(k * max(0, min(given[p] - k * supply[p], supply[p])) for p in supply for k in range(3))
    assert (sum(given.values()), -cost) == cheapest(supply, quotas, 3)
    assert all(sum(f.get(s, 0) for f in flows.values()) <= q for s, q in quotas.items()) and all(given[p] <= 3 * supply[p] for p in supply)


def test_overlapping_sources(spark):
    rng = random.Random(1)
    sets = [["a"], ["b"], ["a", "b"], ["b", "c", None], [None], [], None, ["c", "c"]]
    rows = [(i, rng.choice([0, 1, 5, 300]), rng.choice(sets)) for i in range(600)]
    rows += [(7, 40, ["a"])] * 5 + [(None, 3, ["b"]), (601, None, ["c"])]
    df = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>").withColumn("more", F.lit(1)).withColumn("bin", F.lit("x")).repartition(7)
    got = m.mix(df, "doc_id", "size", "sources").toPandas()
    assert len(got) == len(rows)
    supply = {}
    for _, n, s in rows:
        p = tuple(m._ordered(set(s or [])))
        supply[p] = supply.get(p, 0) + (n or 0)
    sizes = {s: sum(n for p, n in supply.items() if s in p) for s in {s for p in supply for s in p}}
    target = m.targets(sizes, {s: (1, 2, 3)[k % 3] for k, s in enumerate(m._ordered(sizes))}, sum(n for p, n in supply.items() if p))
    flows = m.route(supply, {s: a // b for s, (a, b) in target.items()})
    for p, of in got.groupby("pattern"):
        key = next(q for q in supply if [None if x is None else x for x in q] == __import__("json").loads(p))
        assert of["taken"].sum() == sum(flows[key].values())
        times = of["taken"] // of["size"].where(of["size"] > 0)
        assert (of["taken"] <= 3 * of["size"].fillna(0)).all() and times.max() - times.min() <= 1 if times.notna().any() else True
        cut = of[(of["size"] > 0) & (of["taken"] % of["size"].where(of["size"] > 0, 1) != 0)]
        assert len(cut) <= 1
    again = m.mix(df.repartition(3), "doc_id", "size", "sources").toPandas()
    cols = ["doc_id", "pattern", "size", "taken"]
    assert sorted(map(str, again[cols].values.tolist())) == sorted(map(str, got[cols].values.tolist()))


def test_nothing_to_mix(spark):
    none = spark.createDataFrame([], "doc_id long, size long, sources array<string>")
    assert m.mix(none, "doc_id", "size", "sources").count() == 0
    empty = spark.createDataFrame([(1, 0, ["a"]), (2, None, [None])], none.schema)
    assert [r.taken for r in m.mix(empty, "doc_id", "size", "sources").collect()] == [0, 0]
    with pytest.raises(ValueError):
        m.mix(empty, "doc_id", "size", "sources", most_patterns=1)


def test_words(spark):
    texts = [None, "", " \t\r\n\x0b\x0c", "a", " a b  c\n", "\x1f \U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.n for r in df.orderBy("i").select(m.words("text").alias("n")).collect()] == [0, 0, 0, 1, 2, 2]
