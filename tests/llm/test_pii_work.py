"""The tagger's work: texts are read once to learn, equal windows and equal beginnings of windows are stepped through once."""

import re

import numpy as np

from probspark.llm import pii


def test_learning_reads_every_text_once(spark):
    rows = [(k, f"plain words of text {'abc'[k % 3]}" if k % 4 else f"write to a{k}@b.de now") for k in range(200)]
    read = spark.sparkContext.accumulator(0)

    def counted(parts):
        for p in parts:
            read.add(len(p))
            yield p

    docs = spark.createDataFrame(rows, "doc_id long, text string").mapInPandas(counted, "doc_id long, text string")
    windows = pii.sample_windows(docs)
    assert sum(bool(spans) for _, spans in windows) == 50 and read.value == len(rows)


def test_equal_windows_and_beginnings_share_their_steps(monkeypatch):
    rng = np.random.default_rng(5)
    model = pii.Tagger(5, rng)
    x = rng.integers(97, 100, (400, pii.WINDOW)).astype(np.uint8)
    x[100:200], x[200:300, :60] = x[:100], x[:100, :60]
    p, met, matmul = model.p, [], np.matmul
    both = np.concatenate((model._lstm(x, p["e0"], p["r0"]), model._lstm(x[:, ::-1], p["e1"], p["r1"])[:, ::-1]), 2)
    want = both @ p["o"] + p["b"]

    def counted(a, b, **more):
        met.append(len(a) if b.ndim == 3 else 0)  # rows of states that meet the recurrent weights
        return matmul(a, b, **more)

    monkeypatch.setattr(pii.np, "matmul", counted)
    few, same = pii._distinct(x)
    e = model.emissions(few)
    monkeypatch.undo()
    assert len(few) == 300 and (few[same] == x).all()
    assert np.allclose(e[:, :, same].transpose(2, 0, 1), want, atol=1e-12)
    assert sum(met) < 2 * 300 * (pii.WINDOW - 2)


def test_whole_texts_are_decoded_as_in_pieces(monkeypatch):
    """One table of scores for many texts gives what reading window by window gives."""
    rng = np.random.default_rng(13)
    model = pii.Tagger(5, rng)
    model.p["o"] *= 4
    model.p["t"] = rng.normal(0, 0.7, (pii.N_TAGS, pii.N_TAGS))
    model.p["b"][0] = 1.5
    texts = ["".join(rng.choice(list("abcde fgh\n"), int(n))) for n in rng.integers(1, 900, 60)] + ["", None]
    texts += texts[:20]
    whole = pii.added_spans(model, texts, [[]] * len(texts), 0.1)
    monkeypatch.setattr(pii, "BLOCK", 1)
    assert whole == pii.added_spans(model, texts, [[]] * len(texts), 0.1) and sum(map(len, whole)) > 50


AT = r"(?:\x20?[\[({<]\x20?[aA][tT]\x20?[\])}>]\x20?|\x20[aA][tT]\x20|\x20@\x20|@)"
DOT = r"(?:\x20?[\[({<]\x20?(?:[dD][oO][tT]|\.)\x20?[\])}>]\x20?|\x20[dD][oO][tT]\x20|\x20\.\x20|\.)"
PLAIN = [
    re.compile(rf"[A-Za-z0-9._%+-]+{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+"),
    re.compile(rf"[0-9]+(?:{DOT}[0-9]+){{3}}"),
    re.compile(r"[0-9]{4}(?:(?:\x20\x20|[./_])[0-9]{1,4}){2,4}"),
    re.compile(r"(?:(?<![0-9])00[0-9]|\(\+[0-9]{1,3}\)|\+[0-9]{1,3}\x20/\x20)[\x20().0-9-]{6,}[0-9]"),
]
TRIGGER = re.compile(r"[0-9@]|[\[({<]\x20?(?:[aA][tT]|[dD][oO][tT])\x20?[\])}>]|(?<![A-Za-z])[dD][oO][tT](?![A-Za-z])|\x20[aA][tT]\x20[A-Za-z-]+\.[A-Za-z]")


def test_quick_patterns_match_what_the_plain_ones_match():
    rng = np.random.default_rng(2)
    parts = [" at ", "(at)", " [at] ", "@", " @ ", " dot ", "[dot]", ".", "(", "]", "a", "b-c", "_x", "12", "1234", "00", "+1", " ", "/", " / ", "Dot", "d", "at", "10.0", "- ", "é", "\n", "(+49)", "{ at }"]
    met = 0
    for _ in range(20000):
        text = "".join(rng.choice(parts, rng.integers(1, 25)))
        want = [m.span() for p in PLAIN for m in p.finditer(text)]
        assert pii.doubtful(text) == want, text
        assert [m.span() for m in pii.TRIGGER.finditer(text)] == [m.span() for m in TRIGGER.finditer(text)], text
        met += len(want)
    assert met > 500
