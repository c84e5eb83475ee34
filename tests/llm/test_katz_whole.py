"""Katz scores with every training word's own unigram share, against the brute force without a list."""

import random

import pytest

from probspark.llm import katz

from . import brute_katz


def _rows():
    """Over 70,000 distinct words, of which the rarer ones occur once to a few times and behind common contexts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(70_000)]
    rows = []
    for k in range(0, len(words), 500):
        some = words[k : k + 500] + words[k : k + 500 : 7] + [rng.choice(words) for _ in range(150)]
        rng.shuffle(some)
        rows.append((k, " ".join(x for w in some for x in ((w, "the") if rng.random() < 0.2 else (w,)))))
    return rows


@pytest.mark.parametrize("config", [katz.Config(), katz.Config(codes=60_000), katz.Config(codes=3_000, bucket=20_000, batch=30_000)])
def test_words_beyond_the_codes_keep_their_own_share(spark, config):
    rows = _rows()
    got = {r["doc_id"]: r for r in katz.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), config).collect()}
    uni = {w for _, t in rows for w in t.split()}
    assert len(uni) > 60_000
    counted = brute_katz.katz(rows, [])[2]
    want, *_ = brute_katz.katz(rows, [*counted])
    assert len(got) == len(rows)
    for (d, _), (_, n, known, _, base, score) in zip(rows, want, strict=True):
        assert (got[d]["n_tokens"], got[d]["n_known"]) == (n, known)
        assert got[d]["base_score"] == pytest.approx(base, rel=1e-10) and got[d]["score"] == pytest.approx(score, rel=1e-10)
