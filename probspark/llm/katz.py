"""Language-model scoring by Katz backoff over word bigrams.

Tokens: words (runs of other than white space, A-Z lower-cased), then one end per text; the first token's context
is the begin mark. P(w | v) = d(c) c(v, w) / c(v) for pairs seen in training, else alpha(v) P1(w), where d is the
Good-Turing discount (counts up to `Config.large`) and alpha makes each context's probabilities sum to 1 exactly.
P1 holds the Good-Turing discounted share of every training word; the unknown word has the remaining mass.

Words are 64-bit hashes (the chance of any collision among n distinct words is about n*n / 2**65); the `Config.codes`
most frequent ones are known to every task with their counts, as short codes, which changes sizes but no result. Counts
cover all training texts:
1. words, by word bucket: training counts and counts of counts, summed per task before the shuffle;
2. pairs, by context bucket, with the texts that hold them: one shuffle of packed arrays, pre-summed per batch of
   texts; each bucket is one row of the partitioned n-gram table that is written. Contexts with more than a
   bucket's share of all tokens are spread over all buckets by their second word. The training counts of second
   words without a code come along: tasks ask the word table for those of each pair bucket. Rows that describe the
   texts of a batch travel in the same pass, so that batches come from one reading;
3. discounts from the counts of counts, sums of spread contexts, then one pass over the table scores every pair
   and adds up per text, together with the base score of words without a code.
Buckets grow in number with the tokens, so a task's share stays the same at any size. A batch whose tokens do not all
come back (a source that changed between attempts of a task) raises an error.

Null texts count as empty (one end token). Repeated rows of one doc_id and text get equal results each. An empty
table gives an empty result; without training texts every token is unknown. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, slices, write_table

END, BEGIN = np.uint64(1), np.uint64(2)
_RNG = np.random.default_rng(17)
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64) | np.uint64(1)
RARE = np.uint64(1 << 63)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class Config:
    """codes: words known to every task (bounds the broadcast at 24 bytes each; at most 2**24). large: counts above are
    not discounted. batch: tokens packed together. bucket: tokens of a bucket, about. held: distinct words or questions
    that a task sums up before it sends them on. held_out: the fold that is not learned from."""

    codes: int = 500_000
    large: int = 5
    batch: int = 600_000
    bucket: int = 1_000_000
    held: int = 2_000_000
    held_out: int = 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, modulo 2 ** 64."""
    a = np.full(n + 1, base, np.uint64)
    a[0] = 1
    return np.cumprod(a)


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the text that each belongs to."""
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        for lo, hi in slices(texts, 250_000):
            raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[lo:hi]]
            size = np.array([len(r) + 1 for r in raw])
            b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
            space = _SPACE[b]
            edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
            start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
            power = _powers(_BASE, len(b))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power[:-1])))
            back = _powers(_INVERSE, len(b))
            h = (total[end] - total[start]) * back[start]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            own = np.searchsorted(np.cumsum(size), start, "right")
            # an end token behind the words of each text
            at = np.searchsorted(own, np.arange(len(raw)), "right")
            hashes.append(np.insert(h, at, END))
            owners.append(np.insert(own, at, np.arange(len(raw))) + lo)
    return (np.concatenate(hashes), np.concatenate(owners)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join([head, b"".join(a.tobytes() for a in arrays)]))


def unpack(value: bytes) -> list[np.ndarray]:
    head, _, body = zstandard.ZstdDecompressor().decompress(value).partition(b"\n")
    out, at = [], 0
    for kind, n in (x.split(":") for x in head.decode().split(",")):
        out.append(np.frombuffer(body, kind, int(n), at))
        at += out[-1].nbytes
    return out


def _small(a: np.ndarray) -> np.ndarray:
    """Unsigned array in the fewest bytes."""
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32 if most < 2**32 else np.uint64)


def _batches(parts: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
    """(batch number, texts' rows without text, hashes, owners) for about that many tokens at a time."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    rows, hs, os, n, texts = [], [], [], 0, 0
    for p in parts:
        found = p["text"].tolist()
        for lo, hi in slices(found):
            h, o = tokens(found[lo:hi])
            rows.append(p.iloc[lo:hi].drop(columns="text"))
            hs.append(h)
            os.append((o + texts).astype(np.int32))
            n, texts = n + len(h), texts + hi - lo
            if n >= size or texts >= 60_000:
                full = number, pd.concat(rows, ignore_index=True), np.concatenate(hs), np.concatenate(os)
                number, rows, hs, os, n, texts = number + 1, [], [], [], 0, 0
                yield full
                del full
    if rows:
        yield number, pd.concat(rows, ignore_index=True), np.concatenate(hs), np.concatenate(os)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def _mix(a: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets


def _sources(docs: DataFrame, config: Config) -> DataFrame:
    doc = F.col("doc_id").cast("long")
    return docs.select(doc.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (fold("doc_id") != config.held_out).alias("train"))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts."""
    key = np.concatenate(keys)
    by = np.argsort(key, kind="stable")
    key, count = key[by], np.concatenate(counts)[by]
    at = _runs(key)
    return key[at], np.add.reduceat(count, at) if len(at) else count


def _dealt(bucket: np.ndarray, buckets: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, the bucket's part of each array), in order."""
    by = np.argsort(bucket, kind="stable")
    arrays = tuple(a[by] for a in arrays)
    cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if a < b:
            yield k, *(x[a:b] for x in arrays)


def count_words(source: DataFrame, buckets: int, config: Config) -> DataFrame:
    """bucket, value: hashes and training counts of the words of each word bucket, written."""

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, pack(h, _small(n))) for k, h, n in _dealt(_mix(keys[0], buckets), buckets, keys[0], counts[0])], columns=["bucket", "value"])

        keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for _, _, h, _ in _batches(parts, config.batch):
            h = np.sort(h)
            at = _runs(h)
            key, count = _merged([*keys, h[at]], [*counts, _sizes(at, len(h))])
            keys, counts = [key], [count]
            if len(key) >= config.held:
                yield rows()
                keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        yield rows()

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(v) for v in p["value"]]
        key, count = _merged([g[0] for g in got], [g[1].astype(np.int64) for g in got])
        return pd.DataFrame({"bucket": p["bucket"].iloc[:1], "value": [pack(key, _small(count))]})

    packed = source.where("train").mapInPandas(emit, "bucket int, value binary")
    return write_table(packed.groupBy("bucket").applyInPandas(merge, "bucket int, value binary"), "katz-words")


@dataclass
class Model:
    """What goes to every task: the words with codes, and a few numbers."""

    buckets: int
    frequent: np.ndarray  # hashes of the words with codes, sorted
    code: np.ndarray  # their codes: 0 for the most frequent
    counts: np.ndarray  # training counts by code
    total: int  # training tokens
    kinds: int  # distinct training tokens
    texts: int  # training texts
    share: np.ndarray  # P1 per training count, by count 0 .. large + 1
    unknown: float  # P1 of the unknown word
    hot: np.ndarray | None = None  # codes of spread contexts, sorted
    discount: np.ndarray | None = None  # by count, 0 .. large + 1
    alpha: dict | None = None  # of spread contexts: (total, alpha, factor on seen pairs)


def good_turing(n: np.ndarray, large: int) -> np.ndarray:
    """Discounts d[0 .. large + 1] from counts of counts n[0 .. large + 1]; where the counts of counts are too thin
    for Katz's formula to give values in (0, 1), (r - 0.5) / r."""
    d = np.ones(large + 2)
    n = n.astype(float)
    share = (large + 1) * n[large + 1] / n[1] if n[1] else 1.0
    for r in range(1, large + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        x = (star - share) / (1 - share) if share < 1 else 0.0
        d[r] = x if 0 < x < 1 else (r - 0.5) / r
    return d


def word_model(words: DataFrame, buckets: int, tokens_all: int, config: Config) -> Model:
    """Frequent words, their counts, and the totals, from the word table; only histograms and the frequent words reach
    the driver."""
    large = config.large

    def summary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for v in p["value"]:
                h, c = unpack(v)
                c = c.astype(np.int64)
                level = np.floor(np.log2(np.maximum(c, 1)) * 8).astype(int)
                yield pd.DataFrame({"n": [np.bincount(np.minimum(c, large + 2), minlength=large + 3)], "levels": [np.bincount(level, minlength=512)], "total": [int(c.sum())], "ends": [int(c[h == END].sum())]})

    sums = words.select("value").mapInPandas(summary, "n array<long>, levels array<long>, total long, ends long")
    add = lambda c, size: F.array(*[F.sum(F.element_at(c, i + 1)) for i in range(size)]).alias(c)
    row = sums.agg(add("n", large + 3), add("levels", 512), F.sum("total").alias("total"), F.sum("ends").alias("ends")).first()
    n, levels = np.array([x or 0 for x in row["n"]]), np.array([x or 0 for x in row["levels"]])
    above = np.cumsum(levels[::-1])[::-1]
    least = int(np.argmax(above <= config.codes))

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for v in p["value"]:
                h, c = unpack(v)
                c = c.astype(np.int64)
                some = (np.floor(np.log2(np.maximum(c, 1)) * 8).astype(int) >= least) | (h == END)
                yield pd.DataFrame({"h": h[some].view(np.int64), "c": c[some]})

    top = words.select("value").mapInPandas(pick, "h long, c long").toPandas()
    h, c = top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    if END not in h:
        h, c = np.append(h, END), np.append(c, 0)
    by = np.argsort(h)
    h, c = h[by], c[by]
    rank = np.lexsort((h, -c))
    code = np.empty(len(h), np.int32)
    code[rank] = np.arange(len(h))
    total = int(row["total"] or 0)
    d, r = good_turing(n, large), np.arange(1, large + 1)
    mass = (total - ((1 - d[r]) * r * n[r]).sum()) / max(1, total)
    scale = min(1.0, (1 - 1.0 / (total + 2)) / max(mass, 1e-300))
    model = Model(buckets, h, code, c[rank], total, int(n[1:].sum()), int(row["ends"] or 0), d / max(1, total) * scale, float(1 - mass * scale))
    return _with_hot(model, tokens_all)


def _with_hot(model: Model, tokens_all: int) -> Model:
    most = tokens_all / model.buckets / 2
    model.hot = np.append(np.flatnonzero(model.counts > most), len(model.frequent) if model.texts > most else -1)
    model.hot = model.hot[model.hot >= 0]
    return model


def _codes(model: Model, h: np.ndarray) -> np.ndarray:
    """Codes of frequent words, -1 for others."""
    word, back = np.unique(h, return_inverse=True)
    i = np.minimum(np.searchsorted(model.frequent, word), len(model.frequent) - 1)
    return np.where(model.frequent[i] == word, model.code[i], -1)[back]


def _keyed(m: Model, h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and second words of all tokens as sortable keys: a word's code, or its hash with the top bit set."""
    code = _codes(m, h)
    key = np.where(code >= 0, code.astype(np.uint64), h | RARE)
    context = np.concatenate(([0], key[:-1])).astype(np.uint64)
    context[_runs(o)] = len(m.frequent)  # code of the begin mark, only ever a context
    return context, key


def _bucket(m: Model, context: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The pair bucket: by context, of spread contexts by both words."""
    spread = np.isin(context, m.hot.astype(np.uint64))
    with np.errstate(over="ignore"):
        return _mix(np.where(spread, context * np.uint64(31) + key * np.uint64(_BASE), context * np.uint64(_BASE)), m.buckets)


def rare_counts(source: DataFrame, words: DataFrame, model: Model, config: Config) -> DataFrame:
    """bucket, batch (-1), value: keys and training counts of the second words without a code in each pair bucket, by
    word bucket. Each task asks for what its pairs need; words not seen in training get no answer."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    buckets = model.buckets

    def distinct(h: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by = np.lexsort((h, to))
        h, to = h[by], to[by]
        one = _runs(h, to)
        return h[one], to[one]

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        hs, tos = np.empty(0, np.uint64), np.empty(0, np.int64)

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(k, 0, pack(h, _small(to))) for k, h, to in _dealt(_mix(hs, buckets), buckets, hs, tos)], columns=["bucket", "batch", "value"])

        for _, _, h, o in _batches(parts, config.batch):
            context, key = _keyed(m, h, o)
            rare = key >= RARE
            hs, tos = distinct(np.concatenate((hs, h[rare])), np.concatenate((tos, _bucket(m, context[rare], key[rare]))))
            if len(hs) >= config.held:
                yield rows()
                hs, tos = hs[:0], tos[:0]
        yield rows()

    def answer(p: pd.DataFrame) -> pd.DataFrame:
        known = (p["batch"] == -1).to_numpy()
        asked = [unpack(v) for v in p["value"][~known]]
        rows = []
        if known.any() and asked:
            word, count = unpack(p["value"][known].iloc[0])
            h, to = distinct(np.concatenate([g[0] for g in asked]), np.concatenate([g[1].astype(np.int64) for g in asked]))
            at = np.minimum(np.searchsorted(word, h), len(word) - 1)
            seen = word[at] == h
            h, to, count = h[seen], to[seen], count[at[seen]]
            rows = [(k, -1, pack(h_ | RARE, _small(n))) for k, h_, n in _dealt(to, buckets, h, count)]
        return pd.DataFrame(rows, columns=["bucket", "batch", "value"])

    schema = "bucket int, batch long, value binary"
    asked = source.mapInPandas(ask, schema)
    return asked.unionByName(words.select("bucket", F.lit(-1).cast("long").alias("batch"), "value")).groupBy("bucket").applyInPandas(answer, schema)


def count_pairs(source: DataFrame, words: DataFrame, model: Model, config: Config) -> DataFrame:
    """The n-gram table: a row per context bucket with contexts, second words, training counts, texts, and training
    counts of the second words without a code (keys are sorted: codes before hashes); and rows, with `batch`, that tell
    what the texts of a batch are."""
    shared = source.sparkSession.sparkContext.broadcast(model)
    buckets = model.buckets

    def emit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        logs = np.append(np.log10(m.counts + 0.5), 0.0)
        known = np.append(m.counts > 0, False)
        for number, meta, h, o in _batches(parts, config.batch):
            # training texts come first in a batch: one number tells which they are
            train = meta["train"].to_numpy(bool)
            order = np.argsort(~train, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order))
            context, key = _keyed(m, h, o)
            o = place[o]
            del h
            code = np.where(key < RARE, key, len(m.counts)).astype(np.int64)
            lengths, base, seen = (np.bincount(o, w, len(meta)) for w in (None, logs[code], known[code].astype(float)))
            meta = meta.iloc[order]
            texts = pack(meta["doc_id"].fillna(0).to_numpy(np.int64), meta["doc_id"].isna().to_numpy(np.uint8), meta["train"].to_numpy(np.uint8), _small(lengths), base, _small(seen.astype(np.int64)))
            rows = [(buckets + int(_mix(np.array([number], np.uint64), buckets)[0]), number, texts)]
            by = np.lexsort((o, key, context))
            context, key, o = context[by], key[by], o[by]
            at = _runs(context, key, o)
            n = _sizes(at, len(key))
            context, key, o = context[at], key[at], o[at]
            del by, at, code
            learn = np.array([train.sum()], np.uint32)
            for k, v, w, t, c in _dealt(_bucket(m, context, key), buckets, context, key, o, n):
                pair = _runs(v, w)
                rows.append((k, number, pack(*_keys(v[pair]), *_keys(w[pair], deltas=False), _small(_sizes(pair, len(v))), _small(t), _small(c), learn)))
            yield pd.DataFrame(rows, columns=["bucket", "batch", "value"])

    def merge(p: pd.DataFrame) -> pd.DataFrame:
        if p["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"bucket": p["bucket"], "seen": None, "batches": [[b] for b in p["batch"]], "value": p["value"]})
        answers = [unpack(v) for v in p["value"][p["batch"] == -1]]
        p = p[p["batch"] != -1]
        if not len(p):
            return pd.DataFrame({"bucket": [], "seen": [], "batches": [], "value": []})
        got = [unpack(v) for v in p["value"]]
        context = np.concatenate([_unkeys(*g[:5]) for g in got])
        key = np.concatenate([_unkeys(*g[5:10]) for g in got])
        size = np.concatenate([g[10].astype(np.int64) for g in got])
        source_of = np.repeat(np.arange(len(got)), [len(g[10]) for g in got])
        by = np.lexsort((source_of, key, context))
        first = np.cumsum(size) - size
        order = np.repeat(first[by] - np.cumsum(size[by]) + size[by], size[by]) + np.arange(size.sum())
        context, key, source_of, size = context[by], key[by], source_of[by], size[by]
        o = np.concatenate([g[11].astype(np.uint16) for g in got])[order]
        n = np.concatenate([g[12].astype(np.uint32) for g in got])[order]
        del order, first, by
        run = _runs(context, key)
        posting_source = np.repeat(source_of, size)
        learn = np.array([int(g[13][0]) for g in got])
        pair_of = np.repeat(np.repeat(np.arange(len(run)), _sizes(run, len(key))), size)
        count = np.bincount(pair_of, n * (o < learn[posting_source]), minlength=len(run)).astype(np.int64)
        seen = np.bincount(np.minimum(count, config.large + 2), minlength=config.large + 3)
        value = pack(*_keys(context[run]), *_keys(key[run], deltas=False), _small(count), _small(np.bincount(pair_of, minlength=len(run))), _small(posting_source), _small(o), _small(n), _small(_answered(answers, key[run])))
        return pd.DataFrame({"bucket": p["bucket"].iloc[:1], "seen": [seen], "batches": [p["batch"].to_numpy(np.int64)], "value": [value]})

    packed = source.mapInPandas(emit, "bucket int, batch long, value binary")
    if model.kinds > (model.counts > 0).sum():
        packed = packed.unionByName(rare_counts(source, words, model, config))
    return write_table(packed.groupBy("bucket").applyInPandas(merge, "bucket int, seen array<long>, batches array<long>, value binary"), "katz-pairs")


def _answered(answers: list, key: np.ndarray) -> np.ndarray:
    """Training counts of the keys without a code, in their order; 0 where no answer came."""
    rare = key[key >= RARE]
    if not answers:
        return np.zeros(len(rare), np.int64)
    h, c = np.concatenate([a[0] for a in answers]), np.concatenate([a[1].astype(np.int64) for a in answers])
    by = np.argsort(h)
    h, c = h[by], c[by]
    at = np.minimum(np.searchsorted(h, rare), len(h) - 1)
    return np.where(h[at] == rare, c[at], 0)


def _keys(a: np.ndarray, deltas: bool = True) -> tuple[np.ndarray, ...]:
    """Keys as run lengths (sorted contexts only), whether each is a hash, low and high parts of codes, and hashes."""
    if deltas:
        at = _runs(a)
        lengths, a = _small(_sizes(at, len(a))), a[at]
    else:
        lengths = np.empty(0, np.uint8)
    big = a >= RARE
    code = a[~big].astype(np.uint32)
    return lengths, np.packbits(big), code.astype(np.uint16), (code >> 16).astype(np.uint8), a[big]


def _unkeys(lengths: np.ndarray, big: np.ndarray, low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    n = len(low) + len(hashes)
    flags = np.unpackbits(big)[:n].astype(bool)
    a = np.empty(n, np.uint64)
    a[~flags], a[flags] = low + (high.astype(np.uint32) << 16), hashes
    return np.repeat(a, lengths) if len(lengths) else a


def _counted(model: Model, key: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Training counts of second words; rare: those of the words without a code."""
    big = key >= RARE
    c = model.counts[np.where(big, 0, key).astype(np.int64)]
    c[big] = rare
    return c


def _p1(model: Model, c: np.ndarray) -> np.ndarray:
    """P1 of words by their training counts."""
    return np.where(c > 0, model.share[np.minimum(c, len(model.share) - 1)] * c, model.unknown)


def _sums(model: Model, p1: np.ndarray, count: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of a context: training count, discounted count, and P1 of the seen second words."""
    d = model.discount[np.minimum(count, len(model.discount) - 1)] * count
    return np.add.reduceat(count, starts), np.add.reduceat(d, starts), np.add.reduceat(p1 * (count > 0), starts)


def backoff(total: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha, and a factor on seen pairs (1 unless the discounts left no mass: then half a count is set free)."""
    t = np.maximum(total, 1)
    free = np.maximum(1 - kept / t, 0.5 / (t + 1))
    free = np.where(1 - seen > 1e-12, free, 0.0)
    alpha = np.where(total > 0, free / np.maximum(1 - seen, 1e-12), 1.0)
    return alpha, np.where(total > 0, (1 - free) / np.maximum(kept / t, 1e-300), 1.0)


def _read(value: bytes) -> tuple:
    g = unpack(value)
    return _unkeys(*g[:5]), _unkeys(*g[5:10]), g[10].astype(np.int64), g[11].astype(np.int64), g[12], g[13], g[14], g[15].astype(np.int64)


def _some(a: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.packbits(mask), a[mask]


def score_pairs(pairs: DataFrame, model: Model, config: Config) -> DataFrame:
    """batch, value: per bucket and batch, of each text that has pairs there the sum of log10 probabilities, of each that
    has words without a code there their log10 terms of the base score and how many were known; and all tokens."""
    spark = pairs.sparkSession
    n = pairs.select(*[F.sum(F.element_at("seen", i + 1)).alias(f"n{i}") for i in range(config.large + 2)]).first()
    model.discount = good_turing(np.array([x or 0 for x in n]), config.large)
    shared = spark.sparkContext.broadcast(model)

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for p in parts:
            for v in p["value"]:
                context, key, count, *_, rare = _read(v)
                some = np.isin(context, m.hot.astype(np.uint64))
                context, p1, count = context[some], _p1(m, _counted(m, key, rare))[some], count[some]
                if len(context):
                    at = _runs(context)
                    t, k, s = _sums(m, p1, count, at)
                    yield pd.DataFrame({"code": context[at].astype(np.int64), "total": t.astype(float), "kept": k, "seen": s})

    if len(model.hot):
        hot = pairs.where("seen is not null").select("value").mapInPandas(spread, "code long, total double, kept double, seen double").groupBy("code").agg(*[F.sum(c).alias(c) for c in ("total", "kept", "seen")]).toPandas()
        a, f = backoff(hot["total"].to_numpy(), hot["kept"].to_numpy(), hot["seen"].to_numpy())
        model.alpha = {int(c): (float(t), float(x), float(y)) for c, t, x, y in zip(hot["code"], hot["total"], a, f, strict=True)}
        shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for p in parts:
            for batches, v in zip(p["batches"], p["value"], strict=True):
                context, key, count, postings, source, o, n, rare = _read(v)
                word = _counted(m, key, rare)
                p1 = _p1(m, word)
                at = _runs(context)
                size = _sizes(at, len(key))
                total, kept, seen = _sums(m, p1, count, at)
                total = total.astype(float)
                alpha, factor = backoff(total, kept, seen)
                for i in np.flatnonzero(np.isin(context[at], m.hot.astype(np.uint64))) if len(m.hot) else ():
                    total[i], alpha[i], factor[i] = m.alpha[int(context[at[i]])]
                per = np.repeat(np.arange(len(at)), size)
                d = m.discount[np.minimum(count, len(m.discount) - 1)] * count / np.maximum(total[per], 1) * factor[per]
                logp = np.log10(np.maximum(np.where(count > 0, d, alpha[per] * p1), 1e-300))
                sizes = np.zeros(len(batches), np.int64)
                np.maximum.at(sizes, source, o.astype(np.int64) + 1)
                ends = np.cumsum(sizes)
                text, total_texts = (ends - sizes)[source] + o, int(ends[-1])
                sums = np.bincount(text, np.repeat(logp, postings) * n, minlength=total_texts)
                tokens_in = np.bincount(text, n, minlength=total_texts)
                far = np.repeat(key >= RARE, postings)
                base = np.bincount(text[far], np.repeat(np.log10(word + 0.5), postings)[far] * n[far], minlength=total_texts)
                known = np.bincount(text[far], np.repeat(word > 0, postings)[far] * n[far], minlength=total_texts)
                has, met = tokens_in > 0, np.bincount(text[far], minlength=total_texts) > 0
                rows = []
                for number, a, b in zip(batches, ends - sizes, ends, strict=True):
                    rows.append((int(number), pack(*_some(sums[a:b], has[a:b]), *_some(base[a:b], met[a:b]), _small(known[a:b][met[a:b]].astype(np.int64)), np.array([tokens_in[a:b].sum()], np.int64))))
                yield pd.DataFrame(rows, columns=["batch", "value"])

    return pairs.where("seen is not null").select("batches", "value").mapInPandas(run, "batch long, value binary")


def score(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = _sources(docs, config)
    size = source.agg(F.sum(F.octet_length("text") + 6).alias("b")).first()["b"] or 0
    tokens_all = max(1, size // 6)
    buckets = int(max(12, -(-tokens_all // config.bucket)))
    words = count_words(source, buckets, config)
    model = word_model(words, buckets, tokens_all, config)
    pairs = count_pairs(source, words, model, config)
    texts = pairs.where("seen is null").select(F.lit("texts").alias("kind"), F.element_at("batches", 1).alias("batch"), "value")
    parts = texts.unionByName(score_pairs(pairs, model, config).select(F.lit("score").alias("kind"), "batch", "value"))
    offset = float(np.log10(model.total + 0.5 * (model.kinds + 1)))

    def finish(p: pd.DataFrame) -> pd.DataFrame:
        own = [unpack(v) for v in p["value"][p["kind"] == "texts"]]
        got = [unpack(v) for v in p["value"][p["kind"] == "score"]]
        if len(own) != 1 or sum(int(g[5][0]) for g in got) != int(own[0][3].sum(dtype=np.int64)):
            raise RuntimeError("a batch of texts came back incomplete: documents must read the same in every attempt of a task")
        doc, null, train, length, base, known = own[0]
        base, known, score_ = base.copy(), known.astype(np.int64), np.zeros(len(doc))
        for has, sums, met, more, seen, _ in got:
            score_[np.flatnonzero(np.unpackbits(has)[: len(doc)])] += sums
            at = np.flatnonzero(np.unpackbits(met)[: len(doc)])
            base[at] += more
            known[at] += seen
        out = pd.DataFrame({"doc_id": pd.array(doc, "Int64"), "held_out": train == 0, "n_tokens": length.astype(np.int64), "n_known": known})
        out.loc[null > 0, "doc_id"] = pd.NA
        return out.assign(train_tokens=model.total, base_score=base - offset * length, score=score_)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.groupBy("batch").applyInPandas(finish, schema)
