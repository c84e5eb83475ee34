"""The thresholds' programme: what it pays for does not count a fingerprint as its own partner."""

import numpy as np
import pytest

from probspark.llm import simhash


@pytest.mark.parametrize("total,most", [(10**6, 3), (10**7, 3), (3 * 10**7, 3), (10**8, 34), (10**9, 34), (10**10, 34)])
def test_probe_rows_at_scale(total, most):
    sample = np.random.default_rng(0).integers(-(2**63), 2**63, 20_000)
    parts = simhash.plan(sample, total)
    assert sum(t + 1 for _, t in parts) == 3 and simhash.probe_rows(parts) <= most


def test_crowded_values_cost_words():
    sample = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    spread = simhash._met(sample & 0xFFFFFFFF, 32, 0, 10**6, 32)
    crowded = simhash._met(np.where(np.arange(5000) % 2 == 0, 7, sample & 0xFFFFFFFF), 32, 0, 10**6, 32)
    assert spread < 1 and 30 < crowded < 34  # half of all meet at 65 words each


def test_plans_without_rows():
    assert sum(t + 1 for _, t in simhash.plan(np.empty(0, np.int64), 0)) == 3
    assert sum(t + 1 for _, t in simhash.plan(np.array([5], np.int64), 1)) == 3
