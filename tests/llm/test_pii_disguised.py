"""What the sequence model adds to the patterns: disguised spans of held-out texts, and nothing in others."""

import itertools
import re

import numpy as np
import pytest

from probspark.llm import pii


@pytest.fixture(scope="module")
def learned(spark, sf):
    """A model of four fifths of the texts, and the other texts."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet")
    model = pii.train(pii.sample_windows(docs.where("doc_id % 5 <> 0")))
    return model, [r["text"] or "" for r in docs.where("doc_id % 5 = 0").select("text").collect()]


def planted(text, rng):
    """The text with its spans disguised, and where they are."""
    out, spans, at = "", [], 0
    for a, kind, b in pii.base_spans(text):
        if a >= at:
            out += text[at:a]
            shown = pii.disguise(kind, text[a:b], rng)
            spans.append((len(out), kind, len(out) + len(shown)))
            out, at = out + shown, b
    return out + text[at:], spans


def test_disguised_spans_are_found_and_little_else(learned):
    model, texts = learned
    rng = np.random.default_rng(0)
    all_, exact, met, spurious = 0, 0, 0, 0
    for text in texts:
        out, spans = planted(text, rng)
        base = pii.base_spans(out)
        # a disguise that a pattern still meets in part is no span to add
        spans = [s for s in spans if not any(a < s[2] and b > s[0] for a, _, b in base)]
        found = pii.added_spans(model, [out], [base], pii.Config().sure)[0]
        all_, exact = all_ + len(spans), exact + len(set(spans) & set(found))
        near = [any(a < y and b > x for x, _, y in spans) for a, _, b in found]
        met, spurious = met + sum(near), spurious + len(near) - sum(near)
    print(f"{exact} of {all_} disguised spans found exactly, {met} touched, {spurious} others")
    assert all_ >= 150 and exact >= 0.9 * all_ and spurious <= 0.02 * (met + spurious)


def test_every_window_gives_what_the_chosen_ones_give(learned, monkeypatch):
    """The network on all windows of a sample of plain and of disguised texts finds no disguised span that the choice of
    windows loses; what else it then finds is spurious, and hardly anything."""
    model, texts = learned
    rng = np.random.default_rng(1)
    some = [t for t in texts if 0 < len(t) < 6000]
    made = [planted(t, rng) for t in [t for t in some if pii.base_spans(t)][:60]] + [(t, []) for t in some[:120]]
    chosen, gold = [t for t, _ in made], [set(g) for _, g in made]
    base = [pii.base_spans(t) for t in chosen]
    found = pii.added_spans(model, chosen, base, pii.Config().sure)
    monkeypatch.setattr(pii, "TRIGGER", re.compile("(?s)."))
    every = pii.added_spans(model, chosen, base, pii.Config().sure)
    true = sum(len(set(f) & g) for f, g in zip(found, gold, strict=True))
    assert true >= 40 and all(set(e) & g <= set(f) for e, f, g in zip(every, found, gold, strict=True))
    assert sum(len(set(e) - set(f)) for e, f in zip(every, found, strict=True)) <= 0.03 * true


def test_written_out_forms(learned):
    """Every way of writing at and dot, on addresses of held-out texts."""
    model, texts = learned
    mails = sorted({(t[max(0, a - 60) : a], t[a:b], t[b : b + 60]) for t in texts for a, k, b in pii.base_spans(t) if k == 0})[:40]
    for at, dot in pii.AT_DOT:
        made = [(left, m.partition("@")[0] + at + m.partition("@")[2].replace(".", dot), right) for left, m, right in mails]
        found = pii.added_spans(model, ["".join(x) for x in made], [[]] * len(made), pii.Config().sure)
        hit = sum((len(left), 0, len(left) + len(m)) in f for (left, m, _), f in zip(made, found, strict=True))
        assert hit >= 0.8 * len(mails) >= 8, (at, dot, hit, len(mails))
    plain = "it was at home and the dot was red at noon, at last. dot dot dot"
    assert pii.added_spans(model, [plain], [[]], pii.Config().sure) == [[]]


def test_query_adds_planted_spans(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").where("length(text) < 20000").select("doc_id", "text")
    rng, rows, want = np.random.default_rng(2), [], {}
    for r in docs.where("doc_id % 3 = 0").collect():
        if r["text"] and pii.base_spans(r["text"]) and len(rows) < 80:
            text, spans = planted(r["text"], rng)
            base = pii.base_spans(text)
            rows.append((10**6 + r["doc_id"], text))
            want[rows[-1][0]] = {s for s in spans if not any(a < s[2] and b > s[0] for a, _, b in base)}
    table = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: set(pii.parse_spans(r["spans"])) for r in pii.detect(table).where("doc_id >= 1000000").collect()}
    hit = sum(len(want[k] & got[k]) for k in want)
    assert len(got) == len(rows) and hit >= 0.9 * sum(map(len, want.values())) >= 40


def test_decoding_against_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(5):
        e, t = rng.normal(size=(4, pii.N_TAGS)), rng.normal(size=(pii.N_TAGS, pii.N_TAGS))
        best = max(itertools.product(range(pii.N_TAGS), repeat=4), key=lambda y: sum(e[k, y[k]] for k in range(4)) + sum(t[y[k], y[k + 1]] for k in range(3)))
        assert tuple(pii._viterbi(e, t)) == best
