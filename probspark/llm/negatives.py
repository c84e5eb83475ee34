"""Hard-negative mining by a distributed kNN join over Voronoi cells.

Vectors become whole numbers; the score of a row for an anchor is their inner product. An anchor's positives are its
`positives` best other rows of the same label; for each of them the `negatives` best rows of other labels are wanted whose
score lies between two shares of the positive's.

1. A further coordinate sqrt(M - |x|**2), M the greatest squared norm, makes the largest product the nearest neighbour:
   |(a, 0) - x'|**2 = |a|**2 + M - 2 a.x. Every row goes to the cell of its nearest pivot, with its distance r to it;
   counts and least and greatest r of every cell and label are gathered.
2. Anchors form groups by the cell they are nearest to. From the counts follows, for each anchor, a distance within which
   its positives must lie; by the triangle inequality only rows whose r is within a ring around |(a, 0) - pivot| can be so
   near. The ring of a group and a cell is the union of those of its anchors; rows inside it are copied to that group.
3. A group is dealt out as blocks of anchors by portions of rows, so no task holds more than a block and a portion; each
   joins exactly, and the best of all portions are ranked. Negatives follow in the same way, from the rings of the band of
   scores that the positives found leave open.

Rows with a null id, a null label, or a vector that is null, empty, or holds a null or non-finite component take no part, nor
do those of another length than the first row's by id. Ids name rows: rows that share the anchor's id are no partners of
it, and anchors that repeat one are one anchor (the smallest label and vector); other repeated rows count each. Ties go to
the smaller id. Components beyond 2**26 after scaling are saturated. An empty table, or one without an anchor, gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, usable, whole_numbers, write_table

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
OUT = -(2**62)


@dataclass(frozen=True)
class Config:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score
    high: int = 95
    scale: int = 256
    pivots: int = 64
    block: int = 4096  # anchors in a task, about
    portion: int = 16384  # rows in a task, about
    group: int = 2048  # anchors for which a further group is formed


def _ints(column) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.int32) for b in column]).astype(np.int64)


def prepare(df: DataFrame, id_: str, vector: str, label: str | Column, config: Config) -> DataFrame:
    """id, label, vec (32-bit whole numbers) and norm (squared) of the rows that take part. Written."""
    own = df.select(F.col(id_).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).alias("label"), F.col(vector).alias("v"))
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    first = own.orderBy("id", "v").select(F.size("v").alias("n")).first()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 4096):
                c = b.iloc[k : k + 4096]
                x = whole_numbers(c["v"].to_list(), config.scale)
                yield c[["id", "label"]].assign(vec=[r.tobytes() for r in x.astype(np.int32)], norm=(x * x).sum(1))

    bounded_batches(df.sparkSession, 4096)
    kind = own.schema["label"].dataType.simpleString()
    return write_table(own.where(F.size("v") == (first.n if first else 0)).mapInPandas(run, f"id long, label {kind}, vec binary, norm long"), "negatives-rows")


class Voronoi:
    """Pivots in the augmented space, and the groups of their cells."""

    def __init__(self, sample: np.ndarray, most: int, pivots: int, groups: int):
        self.most = float(most)
        x = self.rows(np.unique(sample, axis=0))
        self.pivots = x[self._spread(x, pivots)]
        centres = self._spread(self.pivots, groups)
        self.group = self._distances(self.pivots, self.pivots[centres]).argmin(1)

    @staticmethod
    def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0))

    def _spread(self, x: np.ndarray, n: int) -> list[int]:
        """Farthest first."""
        chosen = [0]
        far = self._distances(x, x[:1])[:, 0]
        while len(chosen) < min(n, len(x)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, self._distances(x, x[chosen[-1:]])[:, 0])
        return chosen

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.hstack([x, np.sqrt(np.maximum(self.most - (x * x).sum(1), 0))[:, None]])

    def anchors(self, a: np.ndarray) -> np.ndarray:
        """Distances of anchors to the pivots."""
        return self._distances(np.hstack([a.astype(float), np.zeros((len(a), 1))]), self.pivots)

    def slack(self) -> float:
        """More than rounding can move a distance: rings are widened by it."""
        return 1e-5 * max(1.0, np.sqrt(self.most))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self._distances(self.rows(x), self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(x)), cell]


def _placed(rows: DataFrame, space: Voronoi) -> DataFrame:
    """rows with cell and r."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 4096):
                c = b.iloc[k : k + 4096]
                cell, r = space.cells(_ints(c["vec"]))
                yield c[["id", "label", "vec"]].assign(cell=cell, r=r)

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("id", "label", "vec").mapInPandas(run, f"id long, label {kind}, vec binary, cell int, r double")


class _Rings:
    """Union of rings by key, group and cell, in one task."""

    def __init__(self, groups: np.ndarray):
        self.groups, self.found = groups, {}

    def add(self, key, group: int, cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        for c, lo, hi in zip(cells.tolist(), low.tolist(), high.tolist(), strict=True):
            old = self.found.get((key, group, c))
            self.found[key, group, c] = (lo, hi) if old is None else (min(lo, old[0]), max(hi, old[1]))

    def frame(self) -> pd.DataFrame:
        keys, values = list(self.found), list(self.found.values())
        return pd.DataFrame({"label": [k[0] for k in keys], "grp": [k[1] for k in keys], "cell": [k[2] for k in keys], "low": [v[0] for v in values], "high": [v[1] for v in values]})


def _positive_rings(anchors: DataFrame, stats: DataFrame, space: Voronoi, config: Config) -> DataFrame:
    """label, grp, cell, low, high: where the anchors' positives can be."""
    known = ["cell", "n", "least", "most"]
    # written, so that the join deals the anchors of a very common label anew
    cells = write_table(stats.groupBy("label").agg(F.collect_list(F.struct(*known)).alias("k")).select("label", *[F.col(f"k.{c}").alias(f"all_{c}") for c in known]), "negatives-labels")
    kind = anchors.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rings = _Rings(space.group)
            if len(b):
                d = space.anchors(_ints(b["vec"]))
                for own, label, grp, cell, n, least, most in zip(d, b["label"], b["grp"], *[b[f"all_{c}"] for c in known], strict=True):
                    own = own[cell]
                    far = own + most
                    order = np.argsort(far, kind="stable")
                    # one more than asked for: the anchor itself is among the counted rows
                    at = np.searchsorted(np.cumsum(n[order]), config.positives + 1)
                    within = far[order[at]] if at < len(order) else np.inf
                    reach = np.maximum(np.maximum(own - most, least - own), 0) <= within + space.slack()
                    rings.add(label, grp, cell[reach], own[reach] - within - space.slack(), own[reach] + within + space.slack())
            yield rings.frame()

    made = anchors.join(cells, "label").drop("id").mapInPandas(run, f"label {kind}, grp int, cell int, low double, high double")
    return made.groupBy("label", "grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _negative_rings(anchors: DataFrame, stats: list, space: Voronoi, config: Config) -> DataFrame:
    """grp, cell, low, high: where rows in the bands of the anchors' positives can be. stats: a row for each cell."""
    cell, least, most = (np.array([c[k] for c in stats]) for k in ("cell", "least", "most"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rings = _Rings(space.group)
            if len(b):
                vec = _ints(b["vec"])
                d, norm = space.anchors(vec), (vec.astype(float) ** 2).sum(1)
                for own, n, grp, scores in zip(d, norm, b["grp"], b["scores"], strict=True):
                    scores = [s for s in scores if s >= 0]  # a negative score leaves no band
                    if not scores:
                        continue
                    far, near = (np.sqrt(max(n + space.most - 2 * x, 0)) for x in (min(scores) * config.low / 100, max(scores) * config.high / 100))
                    far, near = far + space.slack(), near - space.slack()
                    own = own[cell]
                    reach = (own - most <= far) & (least - own <= far) & (own + most >= near)
                    rings.add(0, grp, cell[reach], np.maximum(own[reach] - far, near - own[reach]), own[reach] + far)
            yield rings.frame()

    made = anchors.select("vec", "grp", "scores").mapInPandas(run, "label int, grp int, cell int, low double, high double")
    return made.groupBy("grp", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def _dealt(rows: DataFrame, anchors: DataFrame, rings: DataFrame, counts: DataFrame, keys: list[str], more: list[str], config: Config) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows under the keys at, block and portion. keys: what rows share with the ring's cell, besides it."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    at = [*keys, "grp"]
    rings = write_table(rings, "negatives-rings")
    held = rings.join(counts, [*keys, "cell"]).groupBy(*at).agg(F.sum("n").alias("n"))
    sizes = held.join(anchors.groupBy(*at).agg(F.count(F.lit(1)).alias("anchors")), at)
    portions = F.greatest(F.ceil(F.col("n") / config.portion), F.least(F.lit(2 * cores), F.ceil(F.col("n") / 1024)))
    sizes = write_table(sizes.select(*at, portions.cast("int").alias("portions"), F.ceil(F.col("anchors") / config.block).cast("int").alias("blocks")), "negatives-sizes")
    where = F.struct(*at).alias("at")
    part = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    a = anchors.join(sizes, at).select(where, part("blocks", 1).alias("block"), each("portions", "portion"), *more)
    # written, so that the join deals the rows of a very full cell anew
    near = write_table(rings.join(sizes, at), "negatives-served")
    r = rows.join(near, [*keys, "cell"]).where((F.col("r") >= F.col("low")) & (F.col("r") <= F.col("high")))
    return a, r.select(where, each("blocks", "block"), part("portions", 2).alias("portion"), "id", "label", "vec")


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where they fit, in whole numbers else."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1] < 2**53:
        return (a.astype(float) @ x.T.astype(float)).astype(np.int64)
    return a @ x.T


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest scores above OUT of each row, ties to the lower column."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    row, col = np.nonzero((scores >= least[:, None]) & (scores > OUT))
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], col[nth < k]


def _tiles(a: pd.DataFrame, b: pd.DataFrame):
    """Slices of anchors with their scores over rows in ascending id."""
    b = b.sort_values("id", kind="stable")
    x, ids, labels = _ints(b["vec"]), b["id"].to_numpy(), b["label"].to_numpy()
    step = max(1, 2_000_000 // len(b))
    for k in range(0, len(a), step):
        own = a.iloc[k : k + step]
        yield own, ids, own["label"].to_numpy()[:, None] == labels[None], _products(_ints(own["vec"]), x)


def mine(df: DataFrame, anchor: Column, id_: str = "vec_id", vector: str = "embedding", label: str | Column = "label", config: Config = Config()) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id and both scores; anchor: condition on `id`."""
    spark = df.sparkSession
    rows = prepare(df, id_, vector, label, config)
    kind = rows.schema["label"].dataType.simpleString()
    most = rows.agg(F.max("norm")).first()[0]
    chosen = rows.where(anchor).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("k")).select("id", "k.label", "k.vec")
    n = chosen.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    sample = rows.orderBy(F.xxhash64("id"), "vec").limit(4 * config.pivots).select("vec").collect()
    space = Voronoi(_ints([r.vec for r in sample]), most, config.pivots, -(-n // config.group))

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(grp=space.group[space.anchors(_ints(b["vec"])).argmin(1)])

    anchors = write_table(chosen.mapInPandas(grouped, f"id long, label {kind}, vec binary, grp int"), "negatives-anchors")
    placed = _placed(rows, space)
    stats = write_table(placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("least"), F.max("r").alias("most")), "negatives-cells")

    def positives(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own, ids, same, scores in _tiles(a, b) if len(a) and len(b) else ():
            scores[~same | (own["id"].to_numpy()[:, None] == ids[None])] = OUT
            row, col = _best(scores, config.positives)
            out.append(pd.DataFrame({"anchor_id": own["id"].to_numpy()[row], "positive_id": ids[col], "positive_score": scores[row, col]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="int64")

    def negatives(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"]
        out = []
        for own, ids, same, scores in _tiles(a, b) if len(a) and len(b) else ():
            for k in range(config.positives):
                here = np.array([len(p) > k for p in own["scores"]])
                p = np.array([q[k] if len(q) > k else 0 for q in own["scores"]])[:, None]
                fits = here[:, None] & ~same & (100 * scores >= config.low * p) & (100 * scores <= config.high * p)
                row, col = _best(np.where(fits, scores, OUT), config.negatives)
                mine_ = own.iloc[row]
                out.append(pd.DataFrame({"anchor_id": mine_["id"].to_numpy(), "nth": [q[k] for q in mine_["nths"]], "positive_id": [q[k] for q in mine_["partners"]], "positive_score": p[row, 0], "negative_id": ids[col], "negative_score": scores[row, col]}))
        return pd.concat(out).astype("int64") if out else pd.DataFrame({c: [] for c in names}, dtype="int64")

    keys = ["at", "block", "portion"]
    a, r = _dealt(placed, anchors, _positive_rings(anchors, stats, space, config), stats.select("label", "cell", "n"), ["label"], ["id", F.col("label"), "vec"], config)
    found = a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(positives, "anchor_id long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= config.positives)
    partners = found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score", "nth")).alias("k"))
    partners = partners.select("id", F.col("k.positive_id").alias("partners"), F.col("k.positive_score").alias("scores"), F.col("k.nth").alias("nths"))
    served = write_table(anchors.join(partners, "id"), "negatives-partners")
    cells = stats.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    a, r = _dealt(placed, served, _negative_rings(served, cells.collect(), space, config), cells.select("cell", "n"), [], ["id", "label", "vec", "partners", "scores", "nths"], config)
    met = a.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(negatives, "anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    out = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= config.negatives)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from kept a join kept b on a.vec_id != b.vec_id where a.vec_id % 50 = 0),
pos as (
  select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from scored where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from pos p join scored s on p.anchor_id = s.anchor_id and s.label != p.anchor_label
where 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""
