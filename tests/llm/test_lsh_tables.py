"""The tables of decontamination: recall by group against all edits, and no match without a table entry."""

import random

import numpy as np

from probspark.llm import decontam


def _items(rng):
    return [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 27, 40, 60, 90, 150])]


def test_recall_of_every_group_is_reached_and_measured():
    rng = random.Random(4)
    items = decontam.Items(_items(rng), decontam.Config())
    assert all(found >= 0.995 and walks >= 1 for *_, walks, found in items.recall)
    # edits drawn anew, in filler text: found with nearly that recall, for every length
    texts, want = [], []
    for k in range(400):
        i = rng.randrange(len(items.words))
        item = decontam.words_of(_items(random.Random(4))[i][1])
        for _ in range(int(items.k[i])):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(2)] = [f"x{rng.randrange(50)}"] if rng.random() < 0.6 else []
        texts.append(" ".join([f"f{rng.randrange(900)}" for _ in range(rng.randrange(30))] + item + ["tail"] * rng.randrange(4)))
        want.append((k, i))
    found = {(d, i) for d, i, *_ in items.search(texts)}
    assert np.mean([x in found for x in want]) >= 0.97


def test_exact_copies_always_and_nothing_without_tables():
    items = decontam.Items(_items(random.Random(4)), decontam.Config())
    texts = [f"before {t} after" for _, t in _items(random.Random(4))]
    found = items.search(texts)
    assert {(d, i) for d, i, dist, *_ in found if dist == 0} >= {(i, i) for i in range(len(texts))}
    for g in items.groups:
        g.keys, g.items = g.keys[:0], g.items[:0]
    assert items.search(texts) == []
