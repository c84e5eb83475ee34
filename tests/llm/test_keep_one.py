"""One row of every near-duplicate group stays, whatever its doc_id."""

from collections import Counter

from probspark.llm import simhash

A, B, C, D = (" ".join(f"{p}{i * i % 97}" for i in range(60)) for p in "abcd")


def test_null_and_repeated_ids(spark):
    rows = [(None, A), (None, B), (None, B), (None, B.upper()), (7, C), (7, C), (7, D), (9, D), (None, D), (8, None), (None, "")]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect())
    assert got == Counter({(None, A): 1, (None, B): 1, (7, C): 1, (7, D): 1, (8, ""): 1})
