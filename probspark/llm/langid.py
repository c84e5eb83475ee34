"""Language identification of words in code-switched text by a linear-chain conditional random field.

Words are maximal runs of letters, lower-cased. A word's emission scores sum the weights of its features:
prefixes and suffixes of one to three letters, character 2- and 3-grams with word ends, and membership in a
lexicon of frequent words. Transition weights between languages are learned with them, by gradient ascent on
the exact conditional likelihood (forward-backward in numpy), over a bounded sample of labelled rows
(`Config.rows_per_language` windows of `Config.window` characters at a hashed place of a text), whose pieces
are also strung together into code-switched sequences.

Inference labels whole texts of any length: forward-backward runs over chunks of `CHUNK` words of many
documents at once; documents of several chunks first multiply the chunks' transfer matrices, which gives the
exact messages at chunk borders. A document's language is the one with the greatest mean posterior.

Null texts and texts without a letter: language `und`, score 0. Rows with a null language are not learned
from. Without any learnable row every text is `und`. Ties go to the first language by name. Repeated rows are
repeated in the result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold

WORD = re.compile(r"[^\W\d_]+")
CHUNK = 512


@dataclass(frozen=True)
class Config:
    """Bounds and settings of training; none of them depends on the size of the corpus."""

    rows_per_language: int = 400
    window: int = 1200
    buckets: int = 1 << 15
    lexicon: int = 300
    sequences: int = 1200
    words: int = 48
    rounds: int = 40
    rate: float = 0.4
    ridge: float = 2e-6
    seed: int = 5


def words_of(text: str | None) -> list[str]:
    """Maximal runs of letters (str.isalpha, which is Unicode's category L), lower-cased."""
    words = WORD.findall(text.lower()) if text else []
    if not "".join(words).isalpha():  # the pattern also takes numerals that are no digits
        words = "".join([c if c.isalpha() else " " for c in " ".join(words)]).split(" ")
        return [w for w in words if w]
    return words


def scan(v: np.ndarray, e: np.ndarray, start: np.ndarray, size: np.ndarray, a: np.ndarray, backward: bool = False, out: np.ndarray | None = None) -> np.ndarray:
    """Carry messages v (chunks, rows, K) through chunks of words. Chunks come longest first.

    e: (words, K) emission factors. Forward: v <- (v a) * e, kept in out after each word.
    Backward: v is kept at each word before v <- (v * e) a'. Every step is scaled to sum 1."""
    for t in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -t, side="left"))
        at = start[:n] + (size[:n] - 1 - t if backward else t)
        if backward:
            if out is not None:
                out[at] = v[:n, 0]
            v[:n] = (v[:n] * e[at][:, None, :]) @ a.T
        else:
            v[:n] = (v[:n] @ a) * e[at][:, None, :]
            if out is not None:
                out[at] = v[:n, 0]
        v[:n] /= v[:n].sum((1, 2), keepdims=True) + 1e-300
        if out is not None and not backward:
            out[at] = v[:n, 0]
    return v


def posteriors(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Exact word posteriors of documents that lie one after another in scores (words, K)."""
    k = scores.shape[1]
    e = np.exp(scores - scores.max(1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    pieces = -(-sizes // CHUNK)
    doc = np.repeat(np.arange(len(sizes)), pieces)
    first = np.cumsum(pieces) - pieces
    nth = np.arange(len(doc)) - first[doc]
    start = (np.cumsum(sizes) - sizes)[doc] + nth * CHUNK
    size = np.minimum(CHUNK, sizes[doc] - nth * CHUNK)
    ahead, behind = np.full((len(doc), 1, k), 1 / k), np.full((len(doc), 1, k), 1 / k)
    many = np.flatnonzero(pieces[doc] > 1)
    if len(many):
        by = many[np.argsort(-size[many], kind="stable")]
        m = np.empty((len(doc), k, k))
        m[by] = scan(np.tile(np.eye(k), (len(by), 1, 1)), e, start[by], size[by], a)
        for d in np.unique(doc[many]):
            c = np.arange(first[d], first[d] + pieces[d])
            for i in c[:-1]:
                x = ahead[i] @ m[i]
                ahead[i + 1] = x / x.sum()
            for i in c[:0:-1]:
                x = behind[i] @ m[i].T
                behind[i - 1] = x / x.sum()
    by = np.argsort(-size, kind="stable")
    alpha, beta = np.empty_like(e), np.empty_like(e)
    scan(ahead[by], e, start[by], size[by], a, False, alpha)
    scan(behind[by], e, start[by], size[by], a, True, beta)
    p = alpha * beta
    return p / p.sum(1, keepdims=True)


class _Codes(dict):
    """Weight rows of feature names, worked out once for each name."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, name: str) -> int:
        if len(self) > 300_000:
            self.clear()
        code = self[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) % self.buckets
        return code

    def __reduce__(self):
        return _Codes, (self.buckets,)


class Tagger:
    """Feature weights, lexicon and transitions: at most (buckets + K) x K numbers."""

    def __init__(self, languages: list[str], lexicon: set[str], weights: np.ndarray, transitions: np.ndarray):
        self.languages, self.lexicon, self.weights, self.transitions = languages, lexicon, weights, transitions
        self.codes = _Codes(len(weights))
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(languages)))

    def features(self, word: str) -> list[int]:
        w = f"<{word}>"
        # affixes of one and two letters are n-grams with a word end
        names = [w[:4], w[-4:], *[w[i : i + 2] for i in range(len(w) - 1)], *[w[i : i + 3] for i in range(len(w) - 2)]]
        if word in self.lexicon:
            names.append("lex" + word)
        return list(map(self.codes.__getitem__, names))

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, K) scores; a bounded memory of known words saves most of the work."""
        known = self.known
        if len(known) > 200_000:
            known.clear()
            self.rows = self.rows[:0]
        new = [w for w in set(words) if w not in known]
        if new:
            found = [self.features(w) for w in new]
            head = np.cumsum([0] + [len(f) for f in found[:-1]])
            flat = np.fromiter((x for f in found for x in f), np.int64)
            rows = np.vstack([np.add.reduceat(self.weights[flat[head[k] : head[k + 4096] if k + 4096 < len(head) else None]], head[k : k + 4096] - head[k], axis=0) for k in range(0, len(head), 4096)])
            known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.vstack([self.rows, rows])
        return self.rows[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].astype(float)


def train(sample: list[tuple[str, str]], config: Config = Config()) -> Tagger | None:
    """sample: (language, text) windows. None if no window has a word."""
    rng = np.random.default_rng(config.seed)
    pieces: dict[str, list[list[str]]] = {}
    for lang, text in sample:
        if ws := words_of(text):
            pieces.setdefault(lang, []).append(ws)
    languages = sorted(pieces)
    if not languages:
        return None
    k = len(languages)
    lexicon = {w for lang in languages for w, _ in Counter(w for ws in pieces[lang] for w in ws).most_common(config.lexicon)}
    tagger = Tagger(languages, lexicon, np.zeros((config.buckets, k)), np.zeros((k, k)))
    if k == 1:
        return tagger
    seqs, gold = [], []
    for _ in range(config.sequences):
        ws: list[str] = []
        ys: list[int] = []
        alone = rng.random() < 0.5
        lang = int(rng.integers(k))
        while len(ws) < config.words:
            own = pieces[languages[lang]]
            piece = own[int(rng.integers(len(own)))]
            n = config.words if alone else 1 + int(rng.geometric(0.15))
            at = int(rng.integers(max(1, len(piece) - n)))
            part = piece[at : at + n][: config.words - len(ws)]
            ws += part
            ys += [lang] * len(part)
            lang = lang if alone else int(rng.integers(k))
        seqs.append(ws)
        gold.append(ys)
    y = np.array(gold)
    feats = [tagger.features(w) for ws in seqs for w in ws]
    flat = np.concatenate([np.array(f) for f in feats])
    owner = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    head = np.cumsum([0] + [len(f) for f in feats[:-1]])
    g2w, g2t = np.full_like(tagger.weights, 1e-6), np.full((k, k), 1e-6)
    s, t = y.shape
    want = np.zeros((s, t, k))
    np.put_along_axis(want, y[:, :, None], 1, 2)
    for _ in range(config.rounds):
        e = np.add.reduceat(tagger.weights[flat], head, axis=0).reshape(s, t, k)
        e = np.exp(e - e.max(2, keepdims=True))
        a = np.exp(tagger.transitions - tagger.transitions.max())
        alpha, beta = np.empty((s, t, k)), np.full((s, t, k), 1 / k)
        v = np.full((s, k), 1 / k)
        for i in range(t):
            v = (v @ a) * e[:, i]
            v /= v.sum(1, keepdims=True)
            alpha[:, i] = v
        for i in range(t - 2, -1, -1):
            b = (beta[:, i + 1] * e[:, i + 1]) @ a.T
            beta[:, i] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        pair = alpha[:, :-1, :, None] * a * (e * beta)[:, 1:, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        gt = np.einsum("stk,stl->kl", want[:, :-1], want[:, 1:]) - pair.sum((0, 1))
        diff = (want - p).reshape(-1, k)[owner]
        gw = np.stack([np.bincount(flat, diff[:, j], minlength=config.buckets) for j in range(k)], 1) / s
        gw -= config.ridge * s * tagger.weights
        gt = gt / s - config.ridge * s * tagger.transitions
        g2w += gw**2
        g2t += gt**2
        tagger.weights += config.rate * gw / np.sqrt(g2w)
        tagger.transitions += config.rate * gt / np.sqrt(g2t)
    tagger.weights = tagger.weights.astype(np.float32)
    return tagger


def sample_windows(docs: DataFrame, config: Config = Config()) -> list[tuple[str, str]]:
    """At most rows_per_language (language, window) pairs of each language, chosen by hash; no sort, no texts shuffled."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.abs(F.xxhash64("doc_id", "text") % 1_000_000).alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, int(1.3e6 * config.rows_per_language / n) + 50))])
    place = F.col("h") % F.greatest(F.length("text") - F.lit(config.window), F.lit(0) + 1) + 1
    cut = usable.where(F.col("h") < F.element_at(share, F.col("lang"))).select("lang", "h", F.substr("text", place.cast("int"), F.lit(config.window)).alias("t"))
    rows = sorted((r["lang"], r["h"], r["t"]) for r in cut.collect())
    taken: Counter = Counter()
    out = []
    for lang, _, t in rows:
        if taken[lang] < config.rows_per_language:
            taken[lang] += 1
            out.append((lang, t))
    return out


def label_batch(tagger: Tagger, texts: list) -> list[tuple[list[str], np.ndarray]]:
    """Words and posteriors of each text."""
    words = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in words])
    if not sizes.sum():
        return [([], np.zeros((0, len(tagger.languages))))] * len(words)
    p = posteriors(tagger.emissions([w for ws in words for w in ws]), sizes[sizes > 0], tagger.transitions)
    ends = np.cumsum(sizes)
    return [(w, p[e - n : e]) for w, n, e in zip(words, sizes, ends, strict=True)]


def predict(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """doc_id, lang_pred, score, n_switches (changes of the most likely language between words) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for p in parts:
            rows = []
            for _, post in label_batch(model, p["text"].tolist()) if model else [(None, ())] * len(p):
                if len(post) == 0:
                    rows.append(("und", 0.0, 0))
                else:
                    mean = post.mean(0)
                    best = int(mean.argmax())
                    rows.append((model.languages[best], min(1.0, float(mean[best])), int((np.diff(post.argmax(1)) != 0).sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "n_switches"]).assign(doc_id=p["doc_id"].astype("Int64").to_numpy())[["doc_id", "lang_pred", "score", "n_switches"]]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double, n_switches long")


def label_words(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """One row per run of words of one most likely language: doc_id, first_word, n_words, lang, mean posterior p."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    bounded_batches(docs.sparkSession)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for d, (_, post) in zip(p["doc_id"], label_batch(shared.value, p["text"].tolist()), strict=True):
                if len(post):
                    best = post.argmax(1)
                    cut = np.concatenate(([0], np.flatnonzero(np.diff(best)) + 1, [len(best)]))
                    rows += [(d, int(a), int(b - a), shared.value.languages[best[a]], float(post[a:b, best[a]].mean())) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "first_word", "n_words", "lang", "p"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, first_word long, n_words long, lang string, p double")


def identify(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """The whole operator: learn outside fold 0, label every document. Returns doc_id, held_out, lang_pred, score, n_switches."""
    tagger = train(sample_windows(docs.where(fold("doc_id") != 0), config), config)
    out = predict(docs, tagger)
    return out.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "n_switches")
