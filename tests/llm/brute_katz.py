"""The Katz model of probspark.llm.katz over plain strings and dictionaries, for small tables."""

import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def discounts(n, large):
    share = (large + 1) * n[large + 1] / n[1] if n[1] else 1.0
    d = {}
    for r in range(1, large + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        x = (star - share) / (1 - share) if share < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return lambda c: d.get(c, 1.0) if c <= large else 1.0


def counts_of(counter, large):
    n = [0] * (large + 3)
    for c in counter.values():
        n[min(c, large + 2)] += 1
    return n


def katz(rows, frequent, large=5):
    """rows: (doc_id, text). Returns per row (held_out, n_tokens, n_known, N, base, score) and the model's parts."""
    docs = [(d, zlib.crc32(str(d).encode()) % 5 != 1, [*WORD.findall(lower(t)), "</s>"]) for d, t in rows]
    uni, pair, ctx = Counter(), Counter(), Counter()
    for _, train, ws in docs:
        if train:
            uni.update(ws)
            p = list(zip(["<s>", *ws[:-1]], ws))
            pair.update(p)
            ctx.update(v for v, _ in p)
    total, kinds = sum(uni.values()), len(uni)
    d1 = discounts(counts_of(uni, large), large)
    p = {w: d1(uni[w]) * uni[w] / max(1, total) for w in frequent}
    p.setdefault("</s>", 0.0)
    mass = sum(p.values())
    p = {w: x * min(1.0, (1 - 1 / (total + 2)) / max(mass, 1e-300)) for w, x in p.items()}
    rest = kinds - sum(uni[w] > 0 for w in p) + 1
    other = (1 - sum(p.values())) / rest
    p1 = lambda w: p.get(w, other)
    d2 = discounts(counts_of(pair, large), large)
    kept, seen = Counter(), Counter()
    for (v, w), c in pair.items():
        kept[v] += d2(c) * c
        seen[v] += p1(w)

    def parts(v):
        t = ctx[v]
        if not t:
            return 1.0, 1.0
        free = max(1 - kept[v] / t, 0.5 / (t + 1))
        if 1 - seen[v] <= 1e-12:
            free = 0.0
        return free / max(1 - seen[v], 1e-12), (1 - free) / max(kept[v] / t, 1e-300)

    def prob(v, w):
        alpha, factor = parts(v)
        c = pair[v, w]
        return d2(c) * c / ctx[v] * factor if c else alpha * p1(w)

    out = []
    for _, train, ws in docs:
        base = sum(math.log10((uni[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in ws)
        s = sum(math.log10(max(prob(v, w), 1e-300)) for v, w in zip(["<s>", *ws[:-1]], ws))
        out.append((not train, len(ws), sum(uni[w] > 0 for w in ws), total, base, s))
    return out, prob, uni, ctx
