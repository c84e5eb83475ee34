"""SimHash near-duplicates by the general pigeonhole principle.

1. `fingerprint_documents`: 64-bit SimHash over the XXH64 values of 3-word shingles of the whole text.
2. `plan`: on a bounded sample of distinct fingerprints, correlated bits are grouped into partitions, and a
   dynamic programme over partitions chooses thresholds t_i >= -1 with sum(t_i + 1) = tau + 1, for the
   smallest estimated number of probes, candidates and words of crowded buckets at the size of the whole table. The plan only steers
   cost: any plan finds all links.
3. `links`: every fingerprint is indexed under its value in each partition and probes all values within t_i;
   candidates are verified on all 64 bits. A bucket with over `bucket` fingerprints is not paired. Its members
   and probers instead meet at the words within one bit of theirs: two fingerprints differ in at most two
   bits if and only if they have such a word in common, and all that meet at a word are linked, so a star
   to the smallest of them keeps the components with rows in proportion to the fingerprints.
4. `components` over distinct fingerprints; copies join by their fingerprint and are never paired.

Null and empty texts have no shingle: fingerprint zero, linked like any other. Null doc_ids get the component
of their fingerprint but never name one (component_id is null where all are null). Repeated rows stay repeated.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, write_table
from .components import components

BITS = 64


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of all shingles of one text, in order; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(width, len(words)) - 1 :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def fingerprint(text: str | None, width: int = 3) -> int:
    """SimHash of one text as a signed 64-bit integer."""
    h = shingle_hashes(text, width)
    n = len(h)
    if not n:
        return 0
    set_bits = np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):
        part = h[k : k + 65536]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * set_bits > n, bitorder="little").view(np.int64)[0])


def fingerprint_documents(docs: DataFrame, digest: Column | None = None) -> DataFrame:
    """doc_id, fp (and digest, if given) of every document: one narrow pass over whole texts."""
    more = [] if digest is None else ["digest"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "fp": np.array([fingerprint(t) for t in p["text"]], np.int64), **{c: p[c] for c in more}})

    bounded_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[digest.alias(c) for c in more])
    return own.mapInPandas(run, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """m groups of near-equal size; each takes the free bit most correlated with its members in turn."""
    c = np.abs(np.nan_to_num(np.corrcoef(bits.T.astype(float)))) if len(bits) > 1 else np.zeros((BITS, BITS))
    free, groups = list(range(BITS)), []
    for k in range(m):
        size = len(free) // (m - k)
        group = [max(free, key=lambda b: (c[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            b = max(free, key=lambda x: (c[x, group].sum(), -x))
            group.append(b)
            free.remove(b)
        groups.append(sorted(group))
    return groups


def _met(values: np.ndarray, width: int, t: int, total: int, bucket: int) -> float:
    """Estimated rows that one fingerprint of `total` makes beside its own index and probe rows: partners within t bits
    in buckets of up to `bucket`, and BITS + 1 words where it meets a larger one. No fingerprint is its own partner.
    `values` are a sample's, so partners grow in proportion to the table; where the sample shows none, values of equal
    chance are taken."""
    n, even = max(1, len(values)), total / 2.0**width
    grow = (total - 1) / max(1, n - 1)
    _, at, count = np.unique(values, return_inverse=True, return_counts=True)
    own = np.maximum((count - 1.0) * grow, even)[at] if len(values) else np.array([even])
    crowded = own > bucket
    if t <= 0:
        return float(np.where(crowded, BITS + 1.0, own).mean())
    pairs = lambda v: float((np.unique(v, return_counts=True)[1].astype(float) ** 2).sum())
    near = sum(pairs(values & ~np.array(1 << b, np.uint64).view(np.int64)) - pairs(values) for b in range(width)) / n * grow
    near = max(near, width * even) * (1 if t == 1 else 1 + width / 2)
    # a probe that hits a crowded bucket sends the fingerprint to its words, once
    return float((BITS + 1.0) * crowded.mean() + np.where(crowded, 0.0, own).mean() + (0.0 if crowded.all() else near))


def plan(sample: np.ndarray, total: int, tau: int = 2, most: int = 4, bucket: int = 32) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest allocation; partitions with threshold -1 are left out."""
    bits = _bits(sample) if len(sample) else np.zeros((0, BITS), np.uint8)
    best: tuple[float, list] = (np.inf, [])
    for m in range(1, most + 1):
        groups = _group_bits(bits, m)
        # cheapest[s]: cost and thresholds of the partitions so far whose t + 1 sum to s
        cheapest: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for g in groups:
            values = bits[:, g].astype(np.int64) @ (np.int64(1) << np.arange(len(g), dtype=np.int64)) if len(g) < 63 else sample
            cost = {-1: 0.0}
            for t in range(tau + 1):
                ball = sum(comb(len(g), k) for k in range(t + 1))
                cost[t] = 1.0 + ball * (t > 0) * 2 + (t == 0) + _met(values, len(g), t, total, bucket)
            step: dict[int, tuple[float, list]] = {}
            for s, (c, ts) in cheapest.items():
                for t, x in cost.items():
                    if s + t + 1 <= tau + 1 and c + x < step.get(s + t + 1, (np.inf,))[0]:
                        step[s + t + 1] = (c + x, [*ts, t])
            cheapest = step
        if tau + 1 in cheapest and cheapest[tau + 1][0] < best[0]:
            best = cheapest[tau + 1][0], [(g, t) for g, t in zip(groups, cheapest[tau + 1][1], strict=True) if t >= 0]
    return best[1]


def probe_rows(parts: list[tuple[list[int], int]]) -> int:
    """Rows that one fingerprint makes under a plan: one for a partition met at its own value, else its ball."""
    return sum(sum(comb(len(g), k) for k in range(t + 1)) for g, t in parts)


def _mask(bits: list[int]) -> int:
    return int(np.array([sum(1 << b for b in bits)], np.uint64).view(np.int64)[0])


def _ball(value: Column, bits: list[int], t: int) -> Column:
    """Array of all words that differ from value in at most t of the bits."""
    flips = [_mask(list(c)) for k in range(t + 1) for c in combinations(bits, k)]
    return F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: x.bitwiseXOR(value))


def links(fps: DataFrame, tau: int = 2, bucket: int = 32, sample_rows: int = 20_000) -> DataFrame:
    """fps (fp): distinct fingerprints. Returns edges (a, b) whose components are those of all pairs within tau bits.

    Up to tau = 2 oversized buckets are handled exactly as described above; larger tau raises ValueError."""
    if not 0 <= tau <= 2:
        raise ValueError("tau must be 0, 1 or 2")
    total = fps.count()
    sample = np.array([r.fp for r in fps.orderBy(F.xxhash64("fp")).limit(sample_rows).collect()], np.int64)
    parts = plan(sample, total, tau, bucket=bucket)
    key = lambda i, v: F.struct(F.lit(i).cast("int").alias("part"), v.alias("value"))
    own = [key(i, F.col("fp").bitwiseAND(F.lit(_mask(g)))) for i, (g, _) in enumerate(parts)]
    index = fps.select("fp", F.explode(F.array(*own)).alias("k")).select("fp", "k.part", "k.value")
    probing = [F.transform(_ball(F.col("fp").bitwiseAND(F.lit(_mask(g))), g, t), partial(key, i)) for i, (g, t) in enumerate(parts) if t > 0]
    size = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    sized = write_table(index.join(size.where("n > 1") if not probing else size, ["part", "value"]), "simhash-index")
    small = sized.where(F.col("n") <= bucket)
    exact = [i for i, (_, t) in enumerate(parts) if t == 0]
    b = small.select("part", "value", F.col("fp").alias("b"))
    edges = small.where(F.col("part").isin(exact)).select("part", "value", F.col("fp").alias("a")).join(b, ["part", "value"]).where("a < b")
    crowded = sized.where(F.col("n") > bucket).select("fp")
    if probing:
        probes = fps.select("fp", F.explode(F.concat(*probing)).alias("k")).select(F.col("fp").alias("a"), "k.part", "k.value")
        edges = edges.unionByName(probes.join(b, ["part", "value"]).where("a != b"))
        hot = size.where(F.col("n") > bucket).select("part", "value")
        crowded = crowded.union(probes.join(hot, ["part", "value"]).select(F.col("a").alias("fp")))
    edges = edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau).select("a", "b")
    crowded = write_table(crowded.distinct(), "simhash-crowded")
    meet = crowded.select("fp", F.explode(_ball(F.col("fp"), list(range(BITS)), min(tau, 1))).alias("word"))
    if tau == 1:  # words within one bit of both would admit two bits: only the fingerprints themselves may be met
        return edges.union(meet.join(crowded.select(F.col("fp").alias("word")), "word").select("fp", "word"))
    first = meet.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("met")).where("met > 1")
    stars = meet.join(first.select("word", "b"), "word").where("fp != b").select(F.col("fp").alias("a"), "b")
    return edges.union(stars)


def near_duplicates(docs: DataFrame, tau: int = 2, bucket: int = 32) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) of every document."""
    own = write_table(fingerprint_documents(docs), "simhash")
    fps = own.select("fp").distinct()
    roots = components(links(fps, tau, bucket))
    named = own.join(roots, own.fp == roots.node, "left").select("doc_id", "fp", F.coalesce("root", "fp").alias("root"))
    # written, so that the join deals its rows anew and a very large component is split over tasks
    least = write_table(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    out = named.join(least, "root")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, tau: int = 2, bucket: int = 32) -> DataFrame:
    """Whole rows of one document of every component: the row of the smallest doc_id (nulls last), then of the smallest
    hash of its text; of rows that repeat both, one stays."""
    digest = F.xxhash64("text")
    own = write_table(fingerprint_documents(docs, digest), "simhash")
    roots = components(links(own.select("fp").distinct(), tau, bucket))
    named = own.join(roots, own.fp == roots.node, "left").select("doc_id", "digest", F.coalesce("root", "fp").alias("root"))
    return rows_of(docs, elected(named))


def elected(named: DataFrame) -> DataFrame:
    """doc_id, digest: the first of every root. Written."""
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    return write_table(named.groupBy("root").agg(F.min(first).alias("k")).select("k.doc_id", "k.digest"), "simhash-keep")


def rows_of(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """One whole row of docs for every (doc_id, digest) in keep, null ids included. The join is a merge join at every
    size, so the texts always move once; the choice among repeated rows needs no further shuffle."""
    keys = ["i", "no_id", "d"]
    key = lambda c, d: [F.coalesce(c, F.lit(0)).alias("i"), c.isNull().alias("no_id"), d.alias("d")]
    made = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    wanted = keep.select(*key(F.col("doc_id"), F.col("digest")))
    return made.join(wanted.hint("merge"), keys).dropDuplicates(keys).select("row.*")
