"""The sequence model reads every window of every text."""

import numpy as np
import pytest

from probspark.llm import pii


def plain(model, text, base, sure):
    """All windows one by one, averaged by place, one Viterbi path over the whole text."""
    e, w = np.zeros((len(text), pii.N_TAGS)), np.zeros((len(text), 1))
    for s in range(0, max(1, len(text) - pii.WINDOW + pii.STRIDE), pii.STRIDE):
        piece = text[s : s + pii.WINDOW]
        x = np.full((1, pii.WINDOW), pii.N_SYMBOLS)
        x[0, : len(piece)] = pii.symbols(piece)
        p = model.p
        both = np.concatenate((model._lstm(x, p["e0"], p["r0"]), model._lstm(x[:, ::-1], p["e1"], p["r1"])[:, ::-1]), 2)
        weight = np.array([min(k + 1, pii.WINDOW - k) for k in range(len(piece))])[:, None]
        e[s : s + len(piece)] += (both @ p["o"] + p["b"])[0, : len(piece)] * weight
        w[s : s + len(piece)] += weight
    e /= w
    path = pii._viterbi(e, model.p["t"])
    p = np.exp(e - e.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    out, k = [], 0
    while k < len(path):
        end = k + 1
        while path[k] and end < len(path) and path[end] and path[end] % 2 == 0 and (path[end] + 1) // 2 == (path[k] + 1) // 2:
            end += 1
        if path[k] and np.mean([p[i, path[i]] for i in range(k, end)]) >= sure and not any(a < end and b > k for a, _, b in base):
            out.append((k, (path[k] + 1) // 2 - 1, end))
        k = end
    return out


@pytest.mark.parametrize("block", [1, 3, 512])
@pytest.mark.parametrize("outside", [0.0, 1.5, 2.5])
def test_every_window_of_every_text_is_read(monkeypatch, block, outside):
    """Texts without any digit, at or dot too; whatever the blocks and however many characters are certain."""
    monkeypatch.setattr(pii, "BLOCK", block)
    rng = np.random.default_rng(7)
    model = pii.Tagger(5, rng)
    model.p["o"] *= 4
    model.p["t"] = rng.normal(0, 0.7, (pii.N_TAGS, pii.N_TAGS))
    model.p["b"][0] = outside
    letters = np.array(list("abcdefghij klmnop\n\u00e9\u4e00"))
    texts = ["".join(rng.choice(letters, n)) for n in (1, 47, 48, 49, 95, 96, 97, 143, 144, 145, 700, 1900)]
    texts[5:5] = ["", None, "a@b.de 10.1.2.3 " * 9]
    base = [pii.base_spans(t) for t in texts]
    want = [plain(model, t, b, 0.1) if t else [] for t, b in zip(texts, base, strict=True)]
    assert pii.added_spans(model, texts, base, 0.1) == want
    # of the texts without a trigger, of which no window was run before
    assert sum(len(w) for w, t in zip(want, texts, strict=True) if t and not pii.TRIGGER.search(t)) >= 3


def test_starts_cover_a_text():
    for n in (0, 1, 95, 96, 97, 144, 145, 5000):
        starts = pii.window_starts("x" * n)
        seen = np.zeros(n, bool)
        for s in starts:
            seen[s : s + pii.WINDOW] = True
        assert seen.all() and starts == sorted(set(starts)) and all(s % pii.STRIDE == 0 and s < n for s in starts)
