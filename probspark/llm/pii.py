"""Personal data: fixed patterns plus a character-level bidirectional LSTM with CRF transitions.

Base spans come from the patterns of four kinds (email, ip, card, phone), leftmost and non-overlapping per
kind, with their numeric checks; a failing match is dropped and its text is not searched again for that kind.
The model is trained in numpy on windows labelled with those spans (a bounded sample: `Config.windows` with a span, as
many that hold a trigger (`TRIGGER`: a digit, an `@`, a bracketed at or dot or the word dot, or what stands beside one) but
no span, and `Config.plain` that hold none, one of a text; windows with what looks like a disguised span (`DOUBTFUL`)
are no examples without one) and on `Config.copies` copies of them whose spans are disguised (`disguised`: at and dot as words or
in brackets, other separators, a phone number's 00 or bare country code), so it learns what the patterns do not match.
It reads whole texts through overlapping windows, all of them: no rule chooses where it looks. Emission scores of overlapping windows are
averaged by how central a character is in each, and one Viterbi path runs over each text, so that no span is cut at a
window's edge. Where a character's score for being outside beats every other tag by more than transitions can make
good, the best path is outside (`Tagger.margins`); only the runs between such characters are decoded, which gives the same
path. Texts are read in pieces of `BLOCK` windows, so a long one is held in no more than its characters and open runs.
Equal windows of a piece are read once, and those that begin (or, backwards, end) alike share the states up to where they part.
A decoded span is added if it overlaps no base span and its mean tag probability is at least `Config.sure`.

Offsets are code points, end exclusive. Null and empty texts have no span. Repeated rows give repeated
results; extra columns are ignored (kept by `redact`). A corpus without any window to learn from gives base
spans only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, write_table

KINDS = ("email", "ip", "card", "phone")
#: Each begins with one set of characters, which the search skips to.
TRIGGER = re.compile(
    r"[0-9@\[({<dD\x20](?:(?<=[0-9@])|(?<=[\[({<])\x20?(?:[aA][tT]|[dD][oO][tT])\x20?[\])}>]"
    r"|(?<=[dD])(?<![A-Za-z][dD])[oO][tT](?![A-Za-z])|(?<=\x20)[aA][tT]\x20[A-Za-z-]+\.[A-Za-z])"
)
PLAIN = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, STRIDE = 96, 48
#: Windows that are read together, and those of them that the network steps through at once.
BLOCK, READ = 32768, 512
N_TAGS = 1 + 2 * len(KINDS)
N_SYMBOLS = 131


@dataclass(frozen=True)
class Config:
    windows: int = 1000
    plain: int = 8000
    copies: int = 3
    hidden: int = 24
    steps: int = 480
    batch: int = 48
    rate: float = 0.012
    sure: float = 0.7
    seed: int = 3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Same matches as the pattern local+@domain, in linear time: only a run of local characters just before an @ can start one."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            yield a, m.end()
            done = m.end()
        at = text.find("@", max(done, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """A dotted chain of numbers is cut into consecutive groups of four; what is left over is no match."""
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    if not text or not PLAIN.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)] + [(a, 1, b) for a, b in _ips(text)]
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdecimal() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def symbols(text: str) -> np.ndarray:
    """ASCII characters by code; other letters, other digits and the rest share three symbols."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(c < 128, c, np.where(c < 0x250, 128, np.where(c < 0x3000, 129, 130)))


def tags_of(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Begin and inside tags of each character; the first span at a character wins."""
    y = np.zeros(length, np.int64)
    for a, kind, b in spans:
        if not y[a:b].any():
            y[a:b] = 2 + 2 * kind
            y[a] = 1 + 2 * kind
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Two LSTMs over symbols (one per direction), a linear layer to tag scores, and tag transitions."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        h = hidden
        self.h = h
        u = lambda *shape: rng.normal(0, 0.25, shape)
        self.p = {"e0": u(N_SYMBOLS + 1, 4 * h), "r0": u(h, 4 * h) / 2, "e1": u(N_SYMBOLS + 1, 4 * h), "r1": u(h, 4 * h) / 2, "o": u(2 * h, N_TAGS), "b": np.zeros(N_TAGS), "t": np.zeros((N_TAGS, N_TAGS))}
        for e in ("e0", "e1"):
            self.p[e][:, h : 2 * h] += 0.5  # forget gates start open

    def _lstm(self, x: np.ndarray, e: np.ndarray, r: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x (m, T) symbols to states (m, T, h)."""
        m, t = x.shape
        h = self.h
        s, c, out = np.zeros((m, h), e.dtype), np.zeros((m, h), e.dtype), np.empty((m, t, h), e.dtype)
        for k in range(t):
            g = e[x[:, k]] + s @ r
            gate = _sigmoid(g[:, : 3 * h])
            new = np.tanh(g[:, 3 * h :])
            before = c
            c = gate[:, h : 2 * h] * c + gate[:, :h] * new
            th = np.tanh(c)
            if keep is not None:
                keep.append((gate, new, before, th, s))
            s = gate[:, 2 * h :] * th
            out[:, k] = s
        return out

    def _back(self, x: np.ndarray, r: np.ndarray, keep: list, dout: np.ndarray, de: np.ndarray, dr: np.ndarray) -> None:
        h, t = self.h, x.shape[1]
        ds, dc = np.zeros_like(dout[:, 0]), np.zeros_like(dout[:, 0])
        dg = np.empty((t, len(x), 4 * h), dout.dtype)
        back = np.ascontiguousarray(r.T)
        for k in range(t - 1, -1, -1):
            gate, new, before, th, s = keep[k]
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            ds = ds + dout[:, k]
            dc = dc + ds * o * (1 - th**2)
            g = dg[k]
            g[:, :h], g[:, h : 2 * h], g[:, 2 * h : 3 * h] = dc * new, dc * before, ds * th
            g[:, : 3 * h] *= gate * (1 - gate)
            g[:, 3 * h :] = dc * i * (1 - new**2)
            dr += s.T @ g
            ds, dc = g @ back, dc * f
        flat = dg.reshape(-1, 4 * h)
        symbol = x.T.ravel()
        by = np.argsort(symbol, kind="stable")
        first = np.flatnonzero(np.diff(symbol[by], prepend=-1))
        de[symbol[by][first]] += np.add.reduceat(flat[by], first, axis=0)

    def _add_scores(self, x: np.ndarray, e: np.ndarray, r: np.ndarray, o: np.ndarray, out: np.ndarray) -> None:
        """Add to out (T, tags, m) what the states of `_lstm` for windows x (m, T) give to the scores. Windows that begin alike
        share their states up to where they part; then `READ` of them go on at once. Gates lie apart, one tanh serves all."""
        m, t = x.shape
        h = self.h
        half = np.array([0.5] * (3 * h) + [1] * h, e.dtype)  # sigmoid(z) = (1 + tanh(z / 2)) / 2
        e = np.ascontiguousarray((e * half).reshape(-1, 4, h).swapaxes(0, 1))
        # states are kept twice as large: the output gate's half is in what they are multiplied by
        r = np.ascontiguousarray((r * half / 2).reshape(h, 4, h).swapaxes(0, 1))
        o = np.ascontiguousarray(o.T / 2)

        def steps(symbols: np.ndarray, s: np.ndarray, c: np.ndarray, scores: np.ndarray) -> np.ndarray:
            """States after some symbols (steps, rows); c is changed in place."""
            g, met, new = np.empty((4, *s.shape), e.dtype), np.empty((4, *s.shape), e.dtype), np.empty_like(c)
            for k, symbol in enumerate(symbols):
                e.take(symbol, 1, g, "clip")
                g += np.matmul(s, r, out=met)
                np.tanh(g, out=g)
                g[:3] += 1
                c *= g[1]
                g[0] *= g[3]
                c += g[0]
                c *= 0.5
                s = g[2] * np.tanh(c, out=new)
                np.matmul(o, s.T, out=scores[k])
            return s

        s, c, at, k = np.zeros((1, h), e.dtype), np.zeros((1, h), e.dtype), np.zeros(m, np.intp), 0
        while k < t:
            key = at * (N_SYMBOLS + 1) + x[:, k]
            met = np.zeros(len(s) * (N_SYMBOLS + 1), bool)
            met[key] = True
            used = np.flatnonzero(met)
            if len(used) > 0.7 * m:
                break
            place = np.empty(len(met), np.int32)
            place[used] = np.arange(len(used))
            at = place[key].astype(np.intp)
            before, symbol = np.divmod(used, N_SYMBOLS + 1)
            c, scores = c[before], np.empty((1, N_TAGS, len(used)), e.dtype)
            s = steps(symbol[None], s[before], c, scores)
            out[k] += scores[0][:, at]
            k += 1
        if k < t:
            for a in range(0, m, READ):
                part = at[a : a + READ]
                scores = np.empty((t - k, N_TAGS, len(part)), e.dtype)
                steps(np.ascontiguousarray(x[a : a + READ, k:].T).astype(np.intp), s[part], c[part], scores)
                out[k:, :, a : a + READ] += scores

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, tags, m) scores of symbol windows (m, T)."""
        p, h = self.p, self.h
        out = np.empty((x.shape[1], N_TAGS, len(x)), p["e0"].dtype)
        out[:] = p["b"][:, None]
        self._add_scores(x, p["e0"], p["r0"], p["o"][:h], out)
        self._add_scores(x[:, ::-1], p["e1"], p["r1"], p["o"][h:], out[::-1])
        return out

    def margins(self) -> np.ndarray:
        """For each tag but outside, the most that a path can gain by that tag at a character instead of outside: by the
        transition into it and by that out of it (first two rows), and the same where the neighbour is outside (last two)."""
        t = self.p["t"].astype(float)
        gains = (t - t[:, :1]).max(0), (t - t[:1]).max(1), t[0] - t[0, 0], t[:, 0] - t[0, 0]
        return np.stack((np.maximum(gains[0], 0), np.maximum(gains[1], 0), *gains[2:]))[:, 1:]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window and its gradients: CRF forward-backward, then back through time."""
        p, (m, t) = self.p, x.shape
        k0: list = []
        k1: list = []
        both = np.concatenate((self._lstm(x, p["e0"], p["r0"], k0), self._lstm(x[:, ::-1], p["e1"], p["r1"], k1)[:, ::-1]), 2)
        e = both @ p["o"] + p["b"]
        a = np.exp(p["t"])
        q = np.exp(e - e.max(2, keepdims=True))
        alpha, beta, logz = np.empty_like(q), np.ones_like(q), e.max(2).sum(1)
        v = np.ones((m, N_TAGS))
        for k in range(t):
            v = q[:, k] * (v @ a if k else v)
            z = v.sum(1, keepdims=True)
            logz += np.log(z[:, 0])
            v = v / z
            alpha[:, k] = v
        for k in range(t - 2, -1, -1):
            b = (q[:, k + 1] * beta[:, k + 1]) @ a.T
            beta[:, k] = b / b.sum(1, keepdims=True)
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a * (q * beta)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        gold = np.eye(N_TAGS)[y]
        truth = np.einsum("mtk,mtl->kl", gold[:, :-1], gold[:, 1:])
        loss = (logz - (e * gold).sum((1, 2))).sum() - (truth * p["t"]).sum()
        de = (post - gold) / m
        g = {"t": (pair.sum((0, 1)) - truth) / m, "b": de.sum((0, 1)), "o": np.einsum("mth,mtk->hk", both, de)}
        dboth = de @ p["o"].T
        for n, keep, xs, d in ((0, k0, x, dboth[:, :, : self.h]), (1, k1, x[:, ::-1], dboth[:, ::-1, self.h :])):
            g[f"e{n}"], g[f"r{n}"] = np.zeros_like(p[f"e{n}"]), np.zeros_like(p[f"r{n}"])
            self._back(xs, p[f"r{n}"], keep, d, g[f"e{n}"], g[f"r{n}"])
        return loss / m, g


#: How disguised spans are written. Email: at, dot; ip and card: separators; phone: beginnings.
AT_DOT = [(" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" @ ", "."), ("{at}", "{dot}"), (" at ", " dot "), (" AT ", " DOT "), (" at ", ".")]
IP_DOTS = ["[.]", " . ", "(.)", "[dot]"]
CARD_GAPS = [".", "/", "_", "  "]
PHONE_STARTS = ["00", "(+{})", "+{} / "]


#: Texts that may be a disguised span: no example of a text without one. An address is found from its at on.
_BRACKETED_AT = r"\x20?[aA][tT]\x20?[\])}>]\x20?"
_AT = rf"[\x20@\[({{<](?:(?<=\x20)(?:[\[({{<]{_BRACKETED_AT}|[aA][tT]\x20|@\x20)|(?<=[\[({{<]){_BRACKETED_AT}|(?<=@))"
_DOT = r"(?:\x20?[\[({<]\x20?(?:[dD][oO][tT]|\.)\x20?[\])}>]\x20?|\x20[dD][oO][tT]\x20|\x20\.\x20|\.)"
AT_DOMAIN = re.compile(rf"{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
DOUBTFUL = [
    re.compile(rf"[0-9][0-9]*(?:{_DOT}[0-9]+){{3}}"),
    re.compile(r"[0-9][0-9]{3}(?:(?:\x20\x20|[./_])[0-9]{1,4}){2,4}"),
    re.compile(r"[0(+](?:(?<=0)(?<![0-9]0)0[0-9]|(?<=\()\+[0-9]{1,3}\)|(?<=\+)[0-9]{1,3}\x20/\x20)[\x20().0-9-]{6,}[0-9]"),
]


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of a local part, an at and a domain, both perhaps written out, in linear time."""
    done = at = 0
    while m := AT_DOMAIN.search(text, at):
        a = m.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            done = at = m.end()
        else:
            at = m.start() + 1


def doubtful(text: str) -> list[tuple[int, int]]:
    return [*_addresses(text), *(m.span() for p in DOUBTFUL for m in p.finditer(text))]


def disguise(kind: int, span: str, rng: np.random.Generator) -> str:
    """One span in a spelling that the patterns do not match as a whole."""
    pick = lambda values: values[int(rng.integers(len(values)))]
    if kind == 0:
        at, dot = pick(AT_DOT)
        local, _, domain = span.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == 1:
        return span.replace(".", pick(IP_DOTS))
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 2:
        return pick(CARD_GAPS).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    start = pick(PHONE_STARTS)
    code = re.match(r"\+([0-9]{1,3})", span)
    return start.format(code[1]) + span[code.end() :] if "{}" in start and code else start + span.lstrip("+")


def disguised(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A window with its spans disguised, cut to WINDOW characters; spans that overlap others or touch an end stay."""
    out, new, at = "", [], 0
    for a, kind, b in spans:
        if a < at:
            continue
        out += text[at:a]
        whole = 0 < a and b < len(text)
        shown = disguise(kind, text[a:b], rng) if whole else text[a:b]
        new.append((len(out), kind, len(out) + len(shown)))
        out, at = out + shown, b
    return (out + text[at:])[:WINDOW], [(a, k, min(b, WINDOW)) for a, k, b in new if a < WINDOW]


def train(windows: list[tuple[str, str]], config: Config = Config()) -> Tagger | None:
    """windows: (text of at most WINDOW characters, spans as kind:start:end joined by commas)."""
    if not windows:
        return None
    rng = np.random.default_rng(config.seed)
    copies = [disguised(text, parse_spans(spans), rng) for text, spans in windows if spans for _ in range(config.copies)]
    windows = [*windows, *((text, format_spans(spans)) for text, spans in copies)]
    x = np.full((len(windows), WINDOW), N_SYMBOLS, np.int64)
    y = np.zeros((len(windows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(windows):
        x[k, : len(text)] = symbols(text)
        y[k] = tags_of(parse_spans(spans), WINDOW)
    model = Tagger(config.hidden, rng)
    m1 = {k: np.zeros_like(v) for k, v in model.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in model.p.items()}
    some, none = np.flatnonzero(y.any(1)), np.flatnonzero(~y.any(1))
    for step in range(1, config.steps + 1):
        half = config.batch // 2
        rows = np.concatenate([rng.choice(pool, half) for pool in (some, none) if len(pool)])
        _, g = model.gradients(x[rows], y[rows])
        norm = np.sqrt(sum((v**2).sum() for v in g.values()))
        rate = config.rate * min(1, 2 * (1 - step / (config.steps + 1)))
        for k, v in g.items():
            v = v * min(1, 5 / (norm + 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * v
            m2[k] = 0.99 * m2[k] + 0.01 * v**2
            model.p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    return model


def format_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def parse_spans(spans: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


def window_starts(text: str) -> list[int]:
    """Starts of all windows of a text, on the stride's grid."""
    return list(range(0, max(0, -(-(len(text) - WINDOW) // STRIDE)) * STRIDE + 1, STRIDE)) if text else []


def trigger_starts(text: str) -> list[int]:
    """Of these, the starts of windows that hold a trigger: what the tagger learns from."""
    starts: set[int] = set()
    last = max(0, -(-(len(text) - WINDOW) // STRIDE)) * STRIDE
    for m in TRIGGER.finditer(text):
        k = min(m.start() // STRIDE * STRIDE, last)
        starts.update((k, max(0, k - STRIDE)))
    return sorted(starts)


def plain_start(text: str, taken: list[int]) -> int | None:
    """Start of one window of a text that is not taken, by hash of the text; none where all are."""
    n, used = len(window_starts(text)), set(taken)
    first = zlib.crc32(text.encode("utf-8", "surrogatepass")) % n
    return next((s for k in range(n) if (s := (first + k) % n * STRIDE) not in used), None)


def sample_windows(docs: DataFrame, config: Config = Config()) -> list[tuple[str, str]]:
    """At most `windows` windows with a span, as many without one among those that hold a trigger and at most `plain`
    among those that hold none (one of each text), by hash of the window; only windows leave the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for text in p["text"]:
                if not text:
                    continue
                starts = trigger_starts(text)
                spans, doubts = (base_spans(text), doubtful(text)) if starts else ([], [])
                other = plain_start(text, starts)
                if other is not None and not starts:
                    at = max(0, other - WINDOW)
                    doubts = [(at + a, at + b) for a, b in doubtful(text[at : other + 2 * WINDOW])]
                for s in [*starts, *([] if other is None else [other])]:
                    piece = text[s : s + WINDOW]
                    # what looks like a disguised span is no example of its absence
                    if any(a < s + WINDOW and b > s and not any(x < b and y > a for x, _, y in spans) for a, b in doubts):
                        continue
                    inside = [(max(a, s) - s, k, min(b, s + WINDOW) - s) for a, k, b in spans if a < s + WINDOW and b > s]
                    rows.append((piece, format_spans(inside), 0 if inside else 1 if s != other else 2))
            yield pd.DataFrame(rows, columns=["piece", "spans", "sort"])

    bounded_batches(docs.sparkSession)
    # written once: counts and windows below read it, not the texts
    found = write_table(docs.select("text").mapInPandas(run, "piece string, spans string, sort int"), "pii-windows").withColumn("h", F.xxhash64("piece"))
    most = (config.windows, config.windows, config.plain)
    top = lambda k: F.slice(F.sort_array(F.collect_set(F.when(F.col("sort") == k, F.struct("h", "piece", "spans")))), 1, most[k])
    # hash cut first, so that what meets is bounded; the share is chosen from a count
    counts = {r["sort"]: r["n"] for r in found.groupBy("sort").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = lambda k: float(int(2**63 * min(1.0, 3 * most[k] / max(1, counts.get(k, 0)))))
    cut = found.where(F.abs(F.col("h") / 2) * 2 <= F.when(F.col("sort") == 0, share(0)).when(F.col("sort") == 1, share(1)).otherwise(share(2)))
    row = cut.agg(*[top(k).alias(f"s{k}") for k in range(3)]).first()
    return [(r["piece"], r["spans"]) for k in range(3) for r in row[f"s{k}"]]


def _viterbi(e: np.ndarray, t: np.ndarray, start: np.ndarray | float = 0, end: np.ndarray | float = 0) -> np.ndarray:
    best, back = e[0].astype(float) + start, np.empty(e.shape, np.int8)
    for k in range(1, len(e)):
        via = best[:, None] + t
        back[k] = via.argmax(0)
        best = via.max(0) + e[k]
    path = np.empty(len(e), np.int64)
    path[-1] = (best + end).argmax()
    for k in range(len(e) - 1, 0, -1):
        path[k - 1] = back[k, path[k]]
    return path


class _Decoder:
    """Spans of one text from the scores of its windows, which come in order, some at a time."""

    def __init__(self, model: Tagger, length: int, base: list[tuple[int, int, int]], sure: float, margins: np.ndarray):
        self.t, self.margins, self.length, self.base, self.sure = model.p["t"], margins, length, base, sure
        self.tail: np.ndarray | None = None  # weighted second half of the last window
        self.at, self.open = 0, np.empty((0, N_TAGS), np.float32)  # first character that is not decoded, scores from there on
        self.out: list[tuple[int, int, int]] = []

    def add(self, e: np.ndarray, last: bool) -> None:
        """Scores (m, WINDOW, tags) of the next windows. Those of a character's two windows are averaged by its place in each."""
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None]
        e = e * weight
        whole = e[:, :STRIDE].copy()
        whole[1:] += e[:-1, STRIDE:]
        total = weight[:STRIDE] + weight[STRIDE:]
        if self.tail is None:
            whole[1:] /= total
            whole[0] /= weight[:STRIDE]
        else:
            whole[0] += self.tail
            whole /= total
        self.tail = e[-1, STRIDE:]
        parts = [self.open, whole.reshape(-1, N_TAGS)]
        self._decode(np.concatenate([*parts, self.tail / weight[STRIDE:]])[: self.length - self.at] if last else np.concatenate(parts), last)

    def _decode(self, e: np.ndarray, last: bool) -> None:
        certain, (into, on, into_0, on_0) = np.ones(len(e), bool), self.margins
        for k, margin in enumerate(into + on + 1e-3):
            certain &= e[:, 0] - e[:, k + 1] > margin
        certain[0] |= self.at > 0  # what is open begins with a certain character or with the text
        unsure = np.flatnonzero(~certain)
        for _ in range(4):  # beside a certain character the gain is known
            left, right = certain[np.maximum(unsure - 1, 0)], certain[np.minimum(unsure + 1, len(e) - 1)]
            gain = np.where(left[:, None], into_0, into) + np.where(right[:, None], on_0, on)
            certain[unsure] = (e[unsure, :1] - e[unsure, 1:] > gain + 1e-3).all(1)
            unsure = unsure[~certain[unsure]]
        runs = np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1) if len(unsure) else []
        keep = len(e)
        if not last:  # a run that goes on stays open, and so does the certain character before it
            keep = int(runs[-1][0]) if runs and runs[-1][-1] == len(e) - 1 else len(e)
            keep = max(0, keep - 1)
        for run in runs:
            if run[0] >= keep:
                continue
            a, b = int(run[0]), int(run[-1]) + 1
            start = self.t[0] if a else 0
            self.spans(self.at + a, e[a:b], _viterbi(e[a:b], self.t, start, self.t[:, 0] if b < len(e) else 0))
        self.at, self.open = self.at + keep, e[keep:].copy()

    def spans(self, at: int, e: np.ndarray, path: np.ndarray) -> None:
        if not path.any():
            return
        p = np.exp(e - e.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True))[np.arange(len(path)), path]
        kind = (path + 1) // 2
        cut = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (path % 2 == 1))
        for k, s in enumerate(cut):
            end = int(cut[k + 1]) if k + 1 < len(cut) else len(path)
            if kind[s] and p[s:end].mean() >= self.sure and not any(x < at + end and y > at + s for x, _, y in self.base):
                self.out.append((at + int(s), int(kind[s]) - 1, at + end))


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows, and the number among them of each."""
    v = np.ascontiguousarray(x).view(np.uint64)
    factors = np.random.default_rng(0).integers(1, 2**63, v.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    _, first, same = np.unique(((v ^ (v >> np.uint64(31))) * factors).sum(1), return_index=True, return_inverse=True)
    # equal hashes of unlike windows: all stay
    return (x[first], same) if len(first) < len(x) and (v[first][same] == v).all() else (x, np.arange(len(x)))


def _decode_whole(decoders: list[_Decoder], counts: np.ndarray, e: np.ndarray, same: np.ndarray) -> None:
    """What `_Decoder.add` does, for texts whose windows are all here (counts of them, one text after the other), at once: e are
    the scores (WINDOW, tags, distinct windows), same is the place there of each window."""
    model_t, margins, sizes = decoders[0].t, decoders[0].margins, np.array([d.length for d in decoders])
    # a cell is a stride of characters: each window's first half, and the last window's second half
    ends = np.cumsum(counts + 1)
    starts = ends - counts - 1
    cells = int(ends[-1])
    this, that = np.zeros(cells, np.intp), np.zeros(cells, np.intp)
    inner = np.ones(cells, bool)
    inner[ends - 1] = False
    this[inner] = same
    inner[:] = True
    inner[starts] = False
    that[inner] = same
    share = (np.arange(1, STRIDE + 1) / (WINDOW - STRIDE + 1)).astype(e.dtype)[:, None] * np.ones(cells, e.dtype)
    share[:, starts], share[:, ends - 1] = 1, 0
    into, on, into_0, on_0 = margins
    certain = np.empty((cells, STRIDE), bool)
    for j in range(STRIDE):
        score = e[j].take(this, 1)
        score *= share[j]
        other = e[STRIDE + j].take(that, 1)
        other *= 1 - share[j]
        score += other
        ok = np.ones(cells, bool)
        for k, margin in enumerate(into + on + 1e-3):
            ok &= score[0] - score[k + 1] > margin
        certain[:, j] = ok
    certain = certain.reshape(-1)
    of = np.repeat(np.arange(len(decoders)), (counts + 1) * STRIDE)
    unsure = np.flatnonzero(~certain)
    unsure = unsure[unsure - starts[of[unsure]] * STRIDE < sizes[of[unsure]]]
    at, text = unsure - starts[of[unsure]] * STRIDE, of[unsure]
    cell, j = np.divmod(unsure, STRIDE)
    part = share[j, cell][:, None]
    scores = e[j, :, this[cell]] * part + e[STRIDE + j, :, that[cell]] * (1 - part)
    for _ in range(4):  # beside a certain character the gain is known
        left = (at > 0) & certain[unsure - (at > 0)]
        right = (at < sizes[text] - 1) & certain[unsure + (at < sizes[text] - 1)]
        gain = np.where(left[:, None], into_0, into) + np.where(right[:, None], on_0, on)
        ok = (scores[:, :1] - scores[:, 1:] > gain + 1e-3).all(1)
        certain[unsure] = ok
        unsure, at, text, scores = unsure[~ok], at[~ok], text[~ok], scores[~ok]
    cuts = np.flatnonzero((np.diff(unsure) > 1) | (np.diff(text) > 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(unsure)], strict=True):
        if a == b:
            continue
        decoder = decoders[text[a]]
        start, end = model_t[0] if at[a] else 0, model_t[:, 0] if at[b - 1] < decoder.length - 1 else 0
        decoder.spans(int(at[a]), scores[a:b], _viterbi(scores[a:b], model_t, start, end))


def added_spans(model: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], sure: float) -> list[list[tuple[int, int, int]]]:
    """Spans that the model adds to the base spans of each text. All windows are read, in blocks that may hold those of several texts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    queue: list[tuple[_Decoder, np.ndarray, bool]] = []

    def read() -> None:
        x, same = _distinct(np.concatenate([x for _, x, _ in queue]))
        e = model.emissions(x)
        at, whole = 0, []
        for decoder, x, last in queue:
            if last and decoder.tail is None:
                whole.append((decoder, np.arange(at, at + len(x))))
            else:
                for a in range(0, len(x), READ):
                    some = same[at + a : at + min(a + READ, len(x))]
                    decoder.add(e[:, :, some].transpose(2, 0, 1), last and a + READ >= len(x))
            at += len(x)
        if whole:
            _decode_whole([d for d, _ in whole], np.array([len(w) for _, w in whole]), e, same[np.concatenate([w for _, w in whole])])
        queue.clear()

    room, margins = BLOCK, model.margins()
    for i, text in enumerate(texts):
        if not text:
            continue
        n = max(0, -(-(len(text) - WINDOW) // STRIDE)) + 1
        x = np.full((n + 1) * STRIDE, N_SYMBOLS, np.uint8)
        x[: len(text)] = symbols(text)
        windows = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::STRIDE]
        decoder, k = _Decoder(model, len(text), base[i], sure, margins), 0
        out[i] = decoder.out
        while k < n:
            m = min(room, n - k)
            queue.append((decoder, windows[k : k + m], k + m == n))
            k, room = k + m, room - m
            if not room:
                read()
                room = BLOCK
    if queue:
        read()
    return out


def find(texts: list, model: Tagger | None, sure: float) -> tuple[list, list]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    more = added_spans(model, texts, base, sure) if model else [[]] * len(texts)
    return base, [sorted(b + m) for b, m in zip(base, more, strict=True)]


def detect(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (all, as kind:start:end) of every document."""
    model = train(sample_windows(docs, config), config)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            base, spans = find(p["text"].tolist(), shared.value, config.sure)
            out = pd.DataFrame({"doc_id": p["doc_id"].astype("Int64")})
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[1] == k for s in b) for b in base]
            out["base_sha256"] = [hashlib.sha256(format_spans(b).encode()).hexdigest() for b in base]
            out["spans"] = [format_spans(s) for s in spans]
            yield out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, schema)


def redact(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """All rows and columns of docs, with each span (overlapping ones as one) replaced by its kind in brackets;
    n_chars, where there is one, follows the new text."""
    model = train(sample_windows(docs, config), config)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, kind, b in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[kind].upper()}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            _, spans = find(p["text"].tolist(), shared.value, config.sure)
            new = [clean(t, s) for t, s in zip(p["text"], spans, strict=True)]
            yield p.assign(text=new)

    out = docs.mapInPandas(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(out.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out
