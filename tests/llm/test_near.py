"""The pipeline's near-dedup against all pairs of shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from pyspark.sql import functions as F

from probspark.llm import near, simhash


def _texts():
    """Texts with copies of which a few words differ, and one group of many copies with different edits."""
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [[word() for _ in range(rng.randrange(60, 300))] for _ in range(60)]
    out = list(base)
    for t in base[:40] + base[:1] * 60:
        copy = list(t)
        for _ in range(rng.randrange(1, 5)):
            copy[rng.randrange(len(copy))] = word()
        out.append(copy)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("bucket", [4, 16])
def test_against_all_pairs(spark, bucket):
    texts = _texts()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    fps = [simhash.fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) or ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    want = {i for i in range(len(texts)) if parent[i] == i}
    assert len(want) < len({*fps}) - 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in near.keep_one(df, near.Config(bucket=bucket)).collect()} == want
    if bucket == 16:
        assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()} == want


def test_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, ties, clashing names, an empty table."""
    words = " ".join(f"w{i}" for i in range(3000))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, None), (3, ""), (9, " \n"), (None, None), (7, words), (2, words), (2, words), (None, words), (11, other), (12, other + " more"), (13, "one two"), (14, "one  two"), (15, "three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("bands", "digest", "root", "fp", "value", "size", "row", "key", "a", "b", "n", "first"):
        df = df.withColumn(name, F.lit("x"))
    got = near.keep_one(df)
    assert got.columns == df.columns
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == [2, 3, 11, 13, 15]
    assert near.keep_one(df.limit(0)).count() == 0
    lone = near.keep_one(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in lone] == [(None, None)]


def test_crowded_bands_lose_no_link(spark):
    """Every pair that shares a band and is similar is linked, however many texts share that band: among more texts than a
    block holds, pairs that share the crowded band alone and pairs that the smallest text of two crowded bands is unlike."""
    rng = random.Random(4)
    config = near.Config(bucket=4, block=8)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for k in range(24):  # a common start, a pair's own middle, and a few words of one's own
        own = [f"p{k}x{i}" for i in range(44)]
        texts += [" ".join(common + own + [f"q{k}y{i}" for i in range(n)]) for n in (1, 8)]
    rng.shuffle(texts)
    sets = [near.shingles(t, 5) for t in texts]
    jac = lambda i, j: (n := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - n)
    similar = {(i, j) for j in range(len(texts)) for i in range(j) if jac(i, j) >= 0.8}
    assert len(similar) == 24
    # bands are given: all share band 0; the rest are all different, or all the same in band 1 too
    for equal in (1, 2):
        digests = {spark.createDataFrame([(t,)], "text string").select(F.xxhash64("text")).first()[0]: i for i, t in enumerate(texts)}
        rows = [(d, d, len(sets[i]), [7] * equal + [1000 * i + k for k in range(equal, config.bands)]) for d, i in digests.items()]
        table = spark.createDataFrame(rows, "digest long, root long, size long, bands array<long>")
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {}
        for r in near._joined(docs, table, *near.candidates(table, config), config).collect():
            got.setdefault(r["root"], set()).add(digests[r["digest"]])
        assert {tuple(sorted(g)) for g in got.values()} == similar


def test_shared_counts():
    rng = np.random.default_rng(0)
    x, y = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint32)) for _ in range(n)] for n in (7, 9))
    want = [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert near.shared(x, y, 16).tolist() == want and near.shared(x, y).tolist() == want
