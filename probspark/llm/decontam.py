"""Benchmark decontamination under word edit distance.

A document is contaminated by an item of n words if some run of its words is within floor((1 - similarity) * n)
word insertions, deletions or substitutions of the item. Words are runs of letters and digits, lower-cased.

1. Index: items are grouped by length (`Group`). Each item is embedded by CGK random walks, which map edit to Hamming
   distance: a pointer emits its word at every step and moves on by a random bit of (walk, step, word). For every walk
   there are `tables` hash tables, each keyed by `coordinates` sampled steps of the embedding (bit-sampling LSH).
2. Windows of texts start at every word and are as long as the items. A group skips the starts behind which a window
   holds fewer of the group's word q-grams than k edits must leave of an item (no match is lost: k edits leave
   n - q + 1 - q*k of them, q being the largest of 3, 2, 1 for which that is positive). Which item a window may hold is
   not known from that: all other windows are embedded, probe the group's tables, and meet their candidates there.
3. Candidates are verified by exact semi-global edit distance.

The number of walks of a group is doubled until items edited at random to the greatest allowed distance are found with
at least `recall` (measured on `trials` items of the group; `Items.recall` keeps the figures). Every item has a key that
an unedited copy always agrees with.

Items go out in blocks of bounded size (`block_chars`), so a large benchmark means more passes, never a large
broadcast; with several blocks, each one's result is written and its broadcast freed before the next. Null or wordless
items and texts match nothing; repeated rows of an item or a document are repeated
in the result of `matches`; equal items match alike. Extra columns are ignored (kept by `drop_contaminated`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, write_table

TOKEN = re.compile(r"[^\W_]+")
GAP = 8


@dataclass(frozen=True)
class Config:
    similarity: float = 0.8
    recall: float = 0.995
    coordinates: int = 3
    tables: int = 8
    trials: int = 200
    block_chars: int = 4_000_000
    seed: int = 11


def words_of(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _walk_bits(walk: int, step: int, words: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(2 * (seed + walk * 1009 + step * 9176867) + 1)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def embed(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int, steps: int, seed: int) -> np.ndarray:
    """CGK embedding of the runs ids[start:end]: (runs, steps), -1 behind the end."""
    at, out = starts.copy(), np.empty((len(starts), steps), np.int64)
    for j in range(steps):
        inside = at < ends
        w = ids[np.where(inside, at, 0)]
        out[:, j] = np.where(inside, w, -1)
        at += _walk_bits(walk, j, w, seed) * inside
    return out


def edit_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the run of text nearest to item: least distance, then first end, then latest start."""
    m = len(text)
    row, begin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    for i, w in enumerate(item, 1):
        sub = row[:-1] + (text != w)
        new, nb = np.empty_like(row), np.empty_like(begin)
        new[0], nb[0] = i, 0
        up = row[1:] + 1
        take = sub <= up
        new[1:] = np.where(take, sub, up)
        nb[1:] = np.where(take, begin[:-1], begin[1:])
        # insertions: running minimum of new[j] - j
        shifted = new - np.arange(m + 1)
        low = np.minimum.accumulate(shifted)
        src = np.maximum.accumulate(np.where(shifted == low, np.arange(m + 1), 0))
        row, begin = low + np.arange(m + 1), nb[src]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


class Group:
    """Items of similar length: their q-grams, and the hash tables over their embeddings."""

    def __init__(self, members: np.ndarray, words: list[np.ndarray], k: np.ndarray, base: int, config: Config):
        self.members, self.config = members, config
        self.words, self.k = [words[i] for i in members], k[members]
        n = np.array([len(w) for w in self.words])
        self.least, self.most, self.edits = int(n.min()), int(n.max()), int(self.k.max())
        self.q = next(q for q in (3, 2, 1) if q == 1 or (n - q + 1 - q * self.k > 0).all())
        self.need = max(1, int((n - self.q + 1 - self.q * self.k).min()))
        self.grams = np.unique(np.concatenate([gram_keys(w, self.q, base) for w in self.words]))
        self.walks, self.keys, self.items, self.found = 0, np.empty(0, np.uint64), np.empty(0, np.int64), 0.0

    def sampled(self, walk: int) -> np.ndarray:
        """(tables, coordinates) steps of one walk. Those of the first table lie within the shortest item."""
        rng = np.random.default_rng([self.config.seed, self.least, walk])
        at = rng.integers(0, max(1, int(1.5 * self.least)), (self.config.tables, self.config.coordinates))
        at[0] %= self.least
        return at

    def signatures(self, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray]:
        """(runs, tables) keys, and whether all of their steps lie within the run."""
        at = self.sampled(walk)
        symbols = embed(ids, starts, ends, walk, int(at.max()) + 1, self.config.seed)[:, at]
        key = np.broadcast_to(np.arange(1, len(at) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(walk), symbols.shape[:2]).copy()
        with np.errstate(over="ignore"):
            for c in range(symbols.shape[2]):
                key = (key ^ symbols[:, :, c].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
                key ^= key >> np.uint64(32)
        return key, (symbols >= 0).all(2)

    def grow(self, walks: int) -> None:
        """Add tables of further walks."""
        size = np.array([len(w) for w in self.words])
        ids, ends = np.concatenate(self.words), np.cumsum(size)
        keys, items = [self.keys], [self.items]
        for walk in range(self.walks, walks):
            key, whole = self.signatures(ids, ends - size, ends, walk)
            keys.append(key[whole])
            items.append(np.broadcast_to(np.arange(len(size))[:, None], key.shape)[whole])
        key, item = np.concatenate(keys), np.concatenate(items)
        by = np.argsort(key, kind="stable")
        self.keys, self.items, self.walks = key[by], item[by], walks

    def candidates(self, ids: np.ndarray, starts: np.ndarray, walks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(start, item of the group) of all windows that share a table key with an item."""
        hits, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(starts), 16_384):
            s = starts[lo : lo + 16_384]
            ends = np.minimum(s + self.most, len(ids))
            for walk in walks or range(self.walks):
                key, whole = self.signatures(ids, s, ends, walk)
                a, b = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                n = np.where(whole, b - a, 0).ravel()
                at = np.repeat(a.ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
                items.append(self.items[at])
                hits.append(np.repeat(np.repeat(s, key.shape[1]), n))
        return np.concatenate(hits), np.concatenate(items)

    def calibrate(self) -> None:
        """Double the walks until items edited to the greatest distance are found with the target recall."""
        rng = np.random.default_rng(self.config.seed)
        ids, starts, trial_of, truth = [], [], [], []
        at = 0
        for i in rng.permutation(len(self.words))[: self.config.trials]:
            for _ in range(1 + self.config.trials // (4 * len(self.words))):
                w, k = list(self.words[i]), int(self.k[i])
                for _ in range(k):
                    kind, where = rng.integers(3), int(rng.integers(max(1, len(w))))
                    w[where : where + (kind != 0)] = [0] if kind < 2 else []
                around = [0] * (self.most + k + 1)
                ids += around + w
                starts.append(np.arange(at + len(around) - k, at + len(around) + k + 1))
                trial_of += [len(truth)] * (2 * k + 1)
                truth.append(i)
                at = len(ids)
        ids, starts, trial_of, truth = np.array(ids + [0] * (2 * self.most), np.int64), np.concatenate(starts), np.array(trial_of), np.array(truth)
        found, walks = np.zeros(len(truth), bool), 1
        while True:
            before = self.walks
            self.grow(walks)
            hit, item = self.candidates(ids, starts, range(before, walks))
            trial = trial_of[np.searchsorted(starts, hit)]
            found[trial[truth[trial] == item]] = True
            self.found = float(found.mean())
            if self.found >= self.config.recall:
                return
            walks *= 2


def gram_keys(ids: np.ndarray, q: int, base: int) -> np.ndarray:
    """One number per q-gram, -1 where it holds a word of no item."""
    m = len(ids) - q + 1
    if m <= 0:
        return np.empty(0, np.int64)
    key, known = np.zeros(m, np.int64), np.ones(m, bool)
    for j in range(q):
        key = key * base + ids[j : j + m]
        known &= ids[j : j + m] > 0
    return np.where(known, key, -1)


class Items:
    """A block of items: word ids and the groups with their tables."""

    def __init__(self, items: list[tuple[int, str]], config: Config):
        self.config = config
        self.vocabulary: dict[str, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            if ws := words_of(text):
                self.ids.append(item_id)
                self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64))
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.k = np.floor((1 - config.similarity) * self.n + 1e-9).astype(np.int64)
        self.base = len(self.vocabulary) + 1
        # groups by length, each a third longer than the one before; and by whether edits are allowed at all
        level = np.floor(np.log(np.maximum(self.n, 1)) / np.log(4 / 3)).astype(int) * 2 + (self.k > 0)
        self.groups = [Group(np.flatnonzero(level == x), self.words, self.k, self.base, config) for x in np.unique(level)]
        for g in self.groups:
            g.calibrate()

    @property
    def recall(self) -> list[tuple[int, int, int, float]]:
        """(shortest, longest item, walks, measured recall) of each group."""
        return [(g.least, g.most, g.walks, g.found) for g in self.groups]

    def search(self, texts: list) -> list[tuple[int, int, int, int, int]]:
        """(text index, item index, distance, first word, end word) of every match, the best of each text and item."""
        if not self.words:
            return []
        get = self.vocabulary.get
        docs = [[get(w, 0) for w in words_of(t)] for t in texts]
        size = np.array([len(d) for d in docs], np.int64)
        start = np.cumsum(size + GAP) - size
        ids = np.zeros(int((size + GAP).sum()) + GAP, np.int64)
        for s, d in zip(start, docs, strict=True):
            ids[s : s + len(d)] = d
        keys = {q: gram_keys(ids, q, self.base) for q in {g.q for g in self.groups}}
        out = []
        for g in self.groups:
            some = np.flatnonzero(keys[g.q] >= 0)
            got = keys[g.q][some]
            known = np.zeros(len(ids) + 1, np.int64)
            known[some[g.grams[np.minimum(np.searchsorted(g.grams, got), len(g.grams) - 1)] == got] + 1] = 1
            known = np.cumsum(known)
            behind = known[np.minimum(np.arange(len(ids)) + g.most + g.edits, len(ids))] - known[:-1]
            hit, item = g.candidates(ids, np.flatnonzero(behind >= g.need))
            owner = np.searchsorted(start, hit, "right") - 1
            own = (owner >= 0) & (hit < start[owner] + size[owner])
            hit, item, owner = hit[own], item[own], owner[own]
            by = np.lexsort((hit, item, owner))
            hit, item, owner = hit[by], item[by], owner[by]
            cut = np.flatnonzero(np.diff(owner, prepend=-1) | np.diff(item, prepend=-1))
            for a, b in zip(cut, np.append(cut[1:], len(hit)), strict=False):
                d, i = int(owner[a]), int(g.members[item[a]])
                if (best := self.verify(i, ids[start[d] : start[d] + size[d]], np.unique(hit[a:b]) - start[d])) is not None:
                    out.append((d, i, *best))
        return out

    def verify(self, i: int, text: np.ndarray, starts: np.ndarray) -> tuple[int, int, int] | None:
        """(distance, first word, end word) of the nearest run around the windows at these starts, if near enough."""
        n, k = int(self.n[i]), int(self.k[i])
        kinds, best = np.unique(self.words[i]), None
        while len(starts):
            near = starts[starts <= starts[0] + 2 * n]
            starts = starts[len(near) :]
            a, b = max(0, int(near[0]) - 2 * k), min(len(text), int(near[-1]) + n + 2 * k)
            # each edit takes away one of the item's different words at most
            if np.isin(kinds, text[a:b]).sum() < len(kinds) - k:
                continue
            dist, s, e = edit_span(self.words[i], text[a:b])
            if dist <= k and (best is None or dist < best[0]):
                best = dist, a + s, a + e
        return best


def _blocks(items: DataFrame, chars: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Items in blocks of about that many characters, and whether a block is the last; two at most are on the driver."""
    block: list[tuple[int, str]] = []
    size, ready = 0, None
    for r in items.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if size >= chars:
            if ready:
                yield ready, False
            ready, block, size = block, [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if ready and block:
        yield ready, False
    if block:
        yield block, True


SCHEMA = "doc_id long, item_id long, distance int, similarity double, first_word long, end_word long"


def matches(docs: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per contaminated document row and item: distance, similarity, and the run of words [first_word, end_word)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], SCHEMA)
    for k, (block, last) in enumerate(_blocks(benchmark, config.block_chars)):
        shared = spark.sparkContext.broadcast(Items(block, config))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            items = shared.value
            for p in parts:
                ids = p["doc_id"].astype("Int64").to_numpy()
                rows = [(ids[d], items.ids[i], dist, 1 - dist / int(items.n[i]), a, b) for d, i, dist, a, b in items.search(p["text"].tolist())]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "similarity", "first_word", "end_word"])

        found = source.mapInPandas(run, SCHEMA)
        if not (k == 0 and last):
            found = write_table(found, "matches")
            shared.destroy()
        out = found if k == 0 else out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, config: Config = Config()) -> DataFrame:
    """Whole rows of the documents that match no item; rows without doc_id are judged by their text like others."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = docs
    for block, last in _blocks(benchmark, config.block_chars):
        shared = spark.sparkContext.broadcast(Items(block, config))

        def run(parts: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for p in parts:
                bad = {d for d, *_ in shared.value.search(p["text"].tolist())}
                yield p[[i not in bad for i in range(len(p))]]

        kept = kept.mapInPandas(run, docs.schema)
        if not last:
            kept = write_table(kept, "uncontaminated")
            shared.destroy()
    return kept


__all__ = ["Config", "Group", "Items", "drop_contaminated", "edit_span", "embed", "matches"]
