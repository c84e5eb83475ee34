"""Compression of vectors to codes of a few bytes: product quantisation over whole numbers, searched by a VA-file.

Vectors are cut into consecutive parts; every part position has a codebook of up to 256 entries. `train` moves entries
to the floored means of the parts that they are nearest to, with sums per partition; `encode` writes the index of the
nearest entry of every part. The nearest entry is found as in a vector approximation file: each coordinate of the
entries is quantised to a few bits, that is, to a cell with a lower and an upper end; a table of squared distances from
the query's coordinate to each cell gives, summed along an entry's cells, a lower and an upper bound of its distance; only
entries whose lower bound is at most the least upper bound are compared with whole numbers. All arithmetic is exact.

Rows whose vector is null, empty, or holds a null or non-finite component are dropped, as are those whose vector has
another length than that of the first row by id (a length that the number of parts doesn't divide raises ValueError). Null
ids are encoded but never start a codebook; repeated ids stay repeated (the first entries are then ordered by id and vector).
Null labels are one label. An empty table gives an empty result. Components beyond 2**26 after scaling are saturated.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, usable, whole_numbers, write_table


class Cells:
    """A codebook's entries (n, d) as a VA-file: `cells` slices of equal population for each coordinate."""

    def __init__(self, entries: np.ndarray, cells: int = 16):
        self.entries = entries
        n, d = entries.shape
        cells = min(cells, n)
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((n, d), np.int64)
        np.put_along_axis(self.cell, order, np.repeat((np.arange(n) * cells // n)[:, None], d, 1), 0)
        ordered = np.take_along_axis(entries, order, 0)
        starts = -(-np.arange(cells) * n // cells)
        self.low, self.high = ordered[starts].T, ordered[np.append(starts[1:], n) - 1].T

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (rows, entries) of the squared distances, by a lookup table for each query and coordinate."""
        x = q[:, :, None]
        under, over = self.low - x, x - self.high
        near, far = np.maximum(np.maximum(under, over), 0) ** 2, np.maximum(-under, -over) ** 2
        low = np.zeros((len(q), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for k, at in enumerate(self.cell.T):
            low += near[:, k].take(at, 1)
            high += far[:, k].take(at, 1)
        return low, high

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, ties to the lower index."""
        if not len(q):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low, high = self.bounds(q)
        open_ = low <= high.min(1)[:, None]
        row, entry = np.nonzero(open_)
        exact = ((q[row] - self.entries[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(exact, np.concatenate(([0], np.cumsum(open_.sum(1))[:-1])))
        hit = np.flatnonzero(exact == best[row])
        _, first = np.unique(row[hit], return_index=True)
        return entry[hit[first]], best


@dataclass
class Codebooks:
    """Entries of each part position, (n, d) whole numbers."""

    parts: list[np.ndarray]
    scale: int

    @property
    def width(self) -> int:
        return sum(p.shape[1] for p in self.parts)

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, with commas."""
        return hashlib.sha256(",".join(str(x) for p in self.parts for x in p.ravel().tolist()).encode()).hexdigest()

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that hexadecimal codes stand for, in the scale of the input."""
        at = np.array([list(bytes.fromhex(c)) for c in codes]).reshape(len(codes), len(self.parts))
        return np.hstack([p[at[:, k]] for k, p in enumerate(self.parts)]) / self.scale


def _split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, 1)


def kept(df: DataFrame, vector: str) -> DataFrame:
    return df.where(usable(vector))


def start(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", parts: int = 4, entries: int = 256, scale: int = 1024) -> Codebooks | None:
    """Codebooks of the first rows by id; None for a table without any."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index takes one byte: 1 to 256 entries")
    named = kept(df, vector).where(F.col(id_).isNotNull()).select(id_, vector).orderBy(id_, vector)
    first = named.first()
    if first is None:
        return None
    width = len(first[1])
    if width % parts:
        raise ValueError(f"{parts} parts don't divide {width} components")
    rows = named.where(F.size(vector) == width).limit(entries).collect()
    return Codebooks(_split(whole_numbers([r[1] for r in rows], scale), parts), scale)


def _sums(df: DataFrame, vector: str, books: Codebooks) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Count and component sums of the parts nearest to each entry: at most one row for each entry leaves a task."""
    n, width = len(books.parts), books.width

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = [Cells(p) for p in books.parts]
        sums = [np.zeros_like(p) for p in books.parts]
        counts = [np.zeros(len(p), np.int64) for p in books.parts]
        for b in batches:
            for k in range(0, len(b), 1024):
                for f, q, s, c in zip(files, _split(whole_numbers(b[vector].iloc[k : k + 1024].to_list(), books.scale), n), sums, counts, strict=True):
                    at, _ = f.nearest(q)
                    order = np.argsort(at, kind="stable")
                    used, first = np.unique(at[order], return_index=True)
                    s[used] += np.add.reduceat(q[order], first, 0)
                    c += np.bincount(at, minlength=len(c))
        part, entry = (np.concatenate(x) for x in ([np.full(np.count_nonzero(c), k) for k, c in enumerate(counts)], [np.flatnonzero(c) for c in counts]))
        yield pd.DataFrame({"part": part, "entry": entry, "n": [counts[p][e] for p, e in zip(part, entry, strict=True)], "s": pd.Series([sums[p][e] for p, e in zip(part, entry, strict=True)], dtype=object)})

    made = df.where(F.size(vector) == width).select(vector).mapInPandas(run, "part int, entry int, n long, s array<long>")
    total = made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width // n)]).alias("s"))
    return {(r.part, r.entry): (r.n, r.s) for r in total.collect()}


def train(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", rounds: int = 4, **options) -> Codebooks | None:
    """Codebooks after `rounds` rounds over all rows; entries that no part is nearest to stay."""
    bounded_batches(df.sparkSession, 4096)
    books = start(df, id_, vector, **options)
    for _ in range(rounds if books else 0):
        parts = [p.copy() for p in books.parts]
        for (k, e), (n, s) in _sums(kept(df, vector), vector, books).items():
            parts[k][e] = [x // n for x in s]
        books = Codebooks(parts, books.scale)
    return books


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label")) -> DataFrame:
    """The kept columns, code (two hex digits a part) and error (squared distance to what the code stands for, scaled)."""
    n = len(books.parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files = [Cells(p) for p in books.parts]
        for b in batches:
            for k in range(0, len(b), 1024):
                c = b.iloc[k : k + 1024]
                found = [f.nearest(q) for f, q in zip(files, _split(whole_numbers(c[vector].to_list(), books.scale), n), strict=True)]
                codes = np.stack([at for at, _ in found], 1).astype(np.uint8)
                yield c[list(keep)].assign(code=[x.tobytes().hex() for x in codes], error=sum(d for _, d in found))

    bounded_batches(df.sparkSession, 4096)
    own = kept(df, vector).where(F.size(vector) == books.width).select(*keep, vector)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != vector] + ["code string", "error long"])
    return own.mapInPandas(run, schema)


def compress(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error (of all rows with an equal label) and the codebooks' hash, for every usable row."""
    own = df.select(F.col(id_).alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label"))
    books = train(own, **options)
    if books is None:
        return own.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = write_table(encode(own, books), "codes")
    # written, so that the join deals the rows of a very common label anew
    errors = write_table(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    out = codes.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle(rounds: int = 4) -> str:
    nearest = """n{k} as materialized (select q.vec_id, q.part, min(struct_pack(d := list_sum(list_transform(list_zip(q.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), entry := b.entry)) as best
 from q join b{k} b on q.part = b.part group by all)"""
    moved = """m{k} as (select n.part, n.best.entry as entry, j, cast(floor(sum(q.x[j]) / count(*)) as bigint) as c from n{k} n join q on n.vec_id = q.vec_id and n.part = q.part, range(1, 17) t(j) group by all),
b{next} as materialized (select b.part, b.entry, coalesce(m.x, b.x) as x from b{k} b left join (select part, entry, list(c order by j) as x from m{k} group by all) m on b.part = m.part and b.entry = m.entry)"""
    steps = ["""kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
 where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        "q as materialized (select vec_id, part, v[16 * part + 1 : 16 * part + 16] as x from kept, range(4) t(part))",
        "f as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit 256)",
        "b0 as materialized (select q.part, f.entry, q.x from q join f on q.vec_id = f.vec_id)"]
    for k in range(rounds):
        steps += [nearest.format(k=k), moved.format(k=k, next=k + 1)]
    steps.append(nearest.format(k=rounds))
    steps.append(f"h as (select sha256(string_agg(cast(u as varchar), ',' order by part, entry, j)) as hash from (select part, entry, unnest(x) as u, generate_subscripts(x, 1) as j from b{rounds}))")
    steps.append(f"e as (select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error from n{rounds} group by vec_id)")
    return "with " + ",\n".join(steps) + "\nselect e.vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, hash as codebooks_sha256 from e join kept using (vec_id), h"


ORACLE = _oracle()
