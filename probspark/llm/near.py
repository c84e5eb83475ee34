"""Near-duplicate texts of the pipeline: components over SimHash links and over pairs of shingle similarity.

Two distinct texts are linked if their fingerprints are linked (`simhash.links`), or if the Jaccard similarity of their
sets of `width`-word shingles is at least `least`. Candidates for the second kind share a band: `bands` hashes of `rows`
minima each over the shingle hashes; a pair at 0.8 shares one with probability 1 - (1 - 0.8**4)**16 = 0.9998. Candidates
come in two rounds. First every text meets the smallest text of each of its band values, so a group of many copies costs
a few pairs for each member, not for each pair of members. Then all pairs of texts that are still apart and share a band
value are looked at: those of a value of up to `bucket` texts one by one, those of a more frequent value block by block, in
the first band that the two share. A block holds up to `block` texts and about `held` shingles, so a value of n texts sends
each of them to n / `block` tasks; nothing of it is left out. Every candidate is verified on the whole sets of both texts,
as 32-bit hashes of their shingles (two sets of n other shingles agree by chance in about n * n / 2**32).

Null and empty texts, and those without a word, have fingerprint zero and no bands: they are one group. A text shorter than a
shingle is one shingle. Repeated rows are copies like any others. Of a group the row of the smallest doc_id stays, null ids
last, then that of the smallest text hash; of rows that agree in id and text but differ elsewhere any one. Extra columns are
kept, whatever their names. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bounded_batches, write_table
from .components import components


@dataclass(frozen=True)
class Config:
    width: int = 5
    least: float = 0.8
    bands: int = 16
    rows: int = 4
    bucket: int = 16
    block: int = 1024
    held: int = 4_000_000


def shingles(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of the shingles of one text, sorted."""
    return np.unique(simhash.shingle_hashes(text, width))


def bands(h: np.ndarray, config: Config) -> np.ndarray:
    """A hash of the minima of each band; none for a text without words."""
    if not len(h):
        return np.empty(0, np.int64)
    n = config.bands * config.rows
    rng = np.random.default_rng(5)
    factor, shift = (rng.integers(0, 2**64, n, np.uint64) for _ in range(2))
    least = np.full(n, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), 4096):
            # the top bits of a product depend on all bits below: good enough for a minimum of hashes
            x = h[None, k : k + 4096] ^ shift[:, None]
            x *= factor[:, None] | np.uint64(1)
            np.minimum(least, x.min(1), out=least)
        out = np.zeros(config.bands, np.uint64)
        for row in least.reshape(config.bands, config.rows).T:
            out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketch(docs: DataFrame, config: Config) -> DataFrame:
    """doc_id, digest, fp, size (distinct shingles), bands of every document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            sets = [shingles(t, config.width) for t in p["text"]]
            fp = np.array([simhash.fingerprint(t) for t in p["text"]], np.int64)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "digest": p["digest"], "fp": fp, "size": [len(s) for s in sets], "bands": [bands(s, config) for s in sets]})

    bounded_batches(docs.sparkSession, 250)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    return own.mapInPandas(run, "doc_id long, digest long, fp long, size long, bands array<long>")


def _fits(a: str, b: str, config: Config) -> Column:
    """Similarity is at most the ratio of the sizes."""
    return F.least(a, b) >= F.greatest(a, b) * F.lit(config.least)


def _dealt(texts: DataFrame) -> DataFrame:
    return texts.select("digest", "root", "size", "bands", F.posexplode("bands").alias("band", "value"))


def stars(texts: DataFrame, config: Config) -> DataFrame:
    """Pairs (a, b) of each text with the smallest text of each of its band values."""
    dealt = _dealt(texts)
    first = dealt.groupBy("band", "value").agg(F.min(F.struct("digest", "root", "size")).alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    # written, so that the join deals its rows anew and a very common band value is split over tasks
    first = write_table(first.where("low < high").select("band", "value", F.col("first.digest").alias("a"), F.col("first.root").alias("ra"), F.col("first.size").alias("sa")), "near-first")
    met = dealt.drop("bands").join(first, ["band", "value"]).where((F.col("ra") != F.col("root")) & _fits("sa", "size", config))
    return met.select("a", F.col("digest").alias("b")).distinct()


def candidates(texts: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """texts (digest, root, size, bands): distinct. Of those that share a band value with a text of another root: pairs (a, b)
    of a value of few texts that can be similar by size, and the members of all other values with their number of blocks."""
    dealt = _dealt(texts)
    count = dealt.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("size").alias("most")).where("low < high").select("band", "value", "n", "most")
    count = write_table(count, "near-count")
    met = dealt.join(count, ["band", "value"])
    few = write_table(met.where(F.col("n") <= config.bucket).select(F.xxhash64("band", "value").alias("key"), "digest", "root", "size"), "near-few")
    fill = F.greatest(F.lit(2), F.least(F.lit(config.block), F.floor(config.held / F.col("most"))))
    crowd = met.where(F.col("n") > config.bucket).select("band", "value", "digest", "root", "bands", F.ceil(F.col("n") / fill).cast("int").alias("blocks"))
    a = few.select("key", F.col("digest").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"))
    b = few.select("key", F.col("digest").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _fits("sa", "sb", config))
    return pairs.select("a", "b").distinct(), write_table(crowd, "near-crowd")


def _sieve(docs: DataFrame, asked: DataFrame, bits: int = 24) -> DataFrame:
    """docs (digest, text) without most of the rows whose digest is not asked for: a bitmap over 2**bits hash values, at
    most 2**(bits - 6) rows whatever the size of the tables, is broadcast. It lets through all that are asked for."""
    place = lambda c: F.shiftrightunsigned(c, 64 - bits)
    word = F.shiftright(F.col("place"), 6)
    bit = F.expr("shiftleft(1L, int(place & 63))")
    map_ = asked.select(place("digest").alias("place")).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask"))
    placed = docs.select("*", place("digest").alias("place")).withColumn("word", word)
    return placed.join(F.broadcast(map_), "word").where(F.col("mask").bitwiseAND(bit) != 0).select(*docs.columns)


def shingle_sets(docs: DataFrame, asked: DataFrame, config: Config) -> DataFrame:
    """digest, own (the whole set, as sorted 32-bit hashes) of every text asked for. Written."""

    def sets(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"digest": p["digest"], "own": [np.unique(shingles(t, config.width).astype(np.uint32)).tobytes() for t in p["text"]]})

    asked = write_table(asked.distinct(), "near-asked")
    own = _sieve(docs.select(F.xxhash64("text").alias("digest"), "text"), asked)
    # copies are dropped per task first, so a text of very many copies moves once from each
    named = own.dropDuplicates(["digest"]).join(asked.hint("merge"), "digest")
    return write_table(named.mapInPandas(sets, "digest long, own binary"), "near-sets")


def verified(made: DataFrame, pairs: DataFrame, config: Config) -> DataFrame:
    """Of the pairs (a, b), those of similar texts, by whole shingle sets."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            keep = []
            for x, y in zip(p["x"], p["y"], strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= config.least * (len(x) + len(y) - both))
            yield p.loc[keep, ["a", "b"]]

    x, y = made.select(F.col("digest").alias("a"), F.col("own").alias("x")), made.select(F.col("digest").alias("b"), F.col("own").alias("y"))
    # merge joins at every size: the sets are the larger side, and the plan stays the same
    return pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def shared(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Size of the intersection of each set of x with each of y: products of membership matrices, `width` values at a time."""
    out = np.zeros((len(x), len(y)), np.float32)
    value, at = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in [*x, *y]])
    # only values on both sides count
    left = row < len(x)
    met = (np.bincount(at[left], minlength=len(value)) > 0) & (np.bincount(at[~left], minlength=len(value)) > 0)
    row, at = row[met[at]], (np.cumsum(met) - 1)[at[met[at]]]
    by = np.argsort(at, kind="stable")
    row, at = row[by], at[by]
    for k in range(0, int(met.sum()), width):
        lo, hi = np.searchsorted(at, (k, k + width))
        m = np.zeros((len(x) + len(y), width), np.float32)
        m[row[lo:hi], at[lo:hi] - k] = 1
        out += m[: len(x)] @ m[len(x) :].T
    return out


def crowd_links(made: DataFrame, crowd: DataFrame, config: Config) -> DataFrame:
    """Pairs (a, b) of roots that similar texts of a crowded band value link: all pairs of its members, block by block. A pair
    that shares an earlier band as well is looked at there."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        band, one = int(p["band"].iloc[0]), p["own_block"] == p["p"]
        x, y = p[one], p if p["p"].iloc[0] == p["q"].iloc[0] else p[~one]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        rx, ry = x["root"].to_numpy(), y["root"].to_numpy()
        look = rx[:, None] != ry[None, :]
        bx, by = np.stack(x["bands"]), np.stack(y["bands"])
        for k in range(band):
            look &= bx[:, k, None] != by[None, :, k]
        # members without a pair to look at need no sets
        x, y, rx, ry, look = x[look.any(1)], y[look.any(0)], rx[look.any(1)], ry[look.any(0)], look[look.any(1)][:, look.any(0)]
        if not len(x):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sx, sy = ([np.frombuffer(s, np.uint32) for s in side["own"]] for side in (x, y))
        both = shared(sx, sy).astype(float)
        nx, ny = (np.array([len(s) for s in side]) for side in (sx, sy))
        i, j = np.nonzero(look & (both >= config.least * (nx[:, None] + ny[None, :] - both)))
        found = np.stack((np.minimum(rx[i], ry[j]), np.maximum(rx[i], ry[j])), 1)
        return pd.DataFrame(np.unique(found, axis=0), columns=["a", "b"])

    named = crowd.join(made.hint("merge"), "digest").withColumn("own_block", F.expr("int(pmod(digest, blocks))"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = named.select("band", "value", "root", "bands", "own", "own_block", other)
    placed = placed.select("*", F.least("own_block", "other").alias("p"), F.greatest("own_block", "other").alias("q")).drop("other")
    return placed.groupBy("band", "value", "p", "q").applyInPandas(run, "a long, b long")


def _joined(docs: DataFrame, texts: DataFrame, pairs: DataFrame, crowd: DataFrame | None, config: Config) -> DataFrame:
    """texts with new roots: components over the roots of similar texts among the pairs and in the crowds. Written."""
    pairs = write_table(pairs, "near-pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("digest"))
    made = shingle_sets(docs, asked if crowd is None else asked.union(crowd.select("digest")), config)
    a, b = (texts.select(F.col("digest").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    edges = verified(made, pairs, config).join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    if crowd is not None:
        edges = edges.union(crowd_links(made, crowd, config))
    merged = components(edges.where("a != b")).withColumnRenamed("root", "over")
    new = texts.join(merged, texts.root == merged.node, "left").withColumn("root", F.coalesce("over", "root"))
    return write_table(new.select(*texts.columns), "near-texts")


def keep_one(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """Whole rows of one document of every component, elected as in `simhash.keep_one`."""
    own = write_table(sketch(docs, config), "near")
    found = components(simhash.links(own.select("fp").distinct()))
    named = own.join(found, own.fp == found.node, "left").withColumn("root", F.coalesce("root", "fp"))
    texts = write_table(named.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("root", "size", "bands")]), "near-texts")
    texts = _joined(docs, texts, stars(texts, config), None, config)
    texts = _joined(docs, texts, *candidates(texts, config), config)
    rows = own.select("doc_id", "digest").join(texts.select("digest", "root"), "digest")
    return simhash.rows_of(docs, simhash.elected(rows))
