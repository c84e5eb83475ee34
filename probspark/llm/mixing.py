"""Mixing sources to target weights by a min-cost flow over membership patterns.

A document belongs to one source or to several; documents of the same set of sources form a pattern.

1. `patterns`: documents and words of every pattern, one aggregate.
2. `targets`: each source's share of all words by its weight, at most `most` times its own words; what exceeds that is shared
   again by weight, until none is above. Shares are whole multiples over the sum of weights, so they are exact.
3. `route`: a flow from the patterns' words to the sources' quotas. A pattern's words may be used `most` times, each time at
   a higher cost, so the cost is convex and nothing is repeated while other words fit. All shortest augmenting paths cost what
   their first arc costs, so successive shortest paths are blocking flows, one level of repetition after the other.
4. `take`: a pattern that owes x words takes all of its documents x // words times, and once more the first ones in a seeded
   order (MD5 of seed and id) up to the word; the last of these is cut. The place of the cut is found by two histograms
   of 256 bins of the order, and only the bin within a bin that holds it (a 65,536th of the pattern) is sorted.

The driver holds one number for each pattern and source, not for a document; more than `most_patterns` raise ValueError.
A null source is a source of its own, last in order; no source at all (a null or empty array) means that nothing is taken. Null and
empty texts have no words and take none. Repeated rows count each; rows that agree in id, size and sources share a place in
the order, and which of them is cut doesn't show. Null ids come first in a seeded place of their own. An empty table gives an
empty result. A null size is 0. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordered(sources) -> list:
    """By code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights: dict, total: int, most: int = 3) -> dict:
    """source -> (numerator, denominator) of its target in words, with shares of `total` by weight."""
    open_, rest, out = set(sizes), total, {}
    while open_:
        weight = sum(weights[s] for s in open_)
        above = [s for s in open_ if rest * weights[s] > most * sizes[s] * weight]
        if not above:
            return out | {s: (rest * weights[s], weight) for s in open_}
        for s in above:
            out[s] = (most * sizes[s], 1)
            rest -= most * sizes[s]
        open_ -= set(above)
    return out


class Flow:
    """Whole flow over arcs with capacities; `augment` adds a greatest flow to what is there."""

    def __init__(self):
        self.to: list[int] = []
        self.left: list[int] = []
        self.at: dict[int, list[int]] = defaultdict(list)

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.at[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc + 1]

    def _levels(self, s: int, t: int) -> dict[int, int]:
        level, queue = {s: 0}, deque([s])
        while queue and t not in level:
            x = queue.popleft()
            for e in self.at[x]:
                if self.left[e] and self.to[e] not in level:
                    level[self.to[e]] = level[x] + 1
                    queue.append(self.to[e])
        return level

    def augment(self, s: int, t: int) -> int:
        total = 0
        while t in (level := self._levels(s, t)):
            nth, path = dict.fromkeys(level, 0), []
            x = s
            while True:  # walk along the levels, step back from dead ends
                if x == t:
                    got = min(self.left[e] for e in path)
                    total += got
                    for e in path:
                        self.left[e] -= got
                        self.left[e ^ 1] += got
                    path, x = [], s
                    continue
                arcs = self.at[x]
                while nth[x] < len(arcs) and not (self.left[arcs[nth[x]]] and level.get(self.to[arcs[nth[x]]]) == level[x] + 1):
                    nth[x] += 1
                if nth[x] < len(arcs):
                    path.append(arcs[nth[x]])
                    x = self.to[path[-1]]
                elif path:
                    x = self.to[path.pop() ^ 1]
                    nth[x] += 1
                else:
                    break
        return total


def route(supply: dict[tuple, int], quotas: dict, most: int = 3) -> dict[tuple, dict]:
    """pattern -> source -> words: the greatest flow within the quotas, and of those the one of the least cost of repetition."""
    net, names = Flow(), {s: k + 2 for k, s in enumerate(_ordered(quotas))}
    given, arcs = {}, []
    for k, p in enumerate(sorted(supply, key=lambda p: [(s is None, s or "") for s in p])):
        node = len(names) + 2 + k
        given[p] = net.arc(0, node, 0)
        arcs += [(p, s, net.arc(node, names[s], most * supply[p])) for s in p]
    for s, node in names.items():
        net.arc(node, 1, quotas[s])
    for _ in range(most):  # each level costs more than the last; its arcs open when no path of a lower cost is left
        for p, e in given.items():
            net.left[e] += supply[p]
        net.augment(0, 1)
    out: dict[tuple, dict] = {p: {} for p in supply}
    for p, s, e in arcs:
        out[p][s] = net.flow(e)
    return out


def take(docs: DataFrame, owed: dict[str, tuple[int, int]], seed: int = 42) -> DataFrame:
    """docs (doc_id, size, pattern) with `taken`. owed: pattern -> (times all are taken, words taken once more)."""
    spark = docs.sparkSession
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    bins = [F.conv(F.substring("place", k, 2), 16, 10).cast("int").alias(name) for k, name in ((1, "bin"), (3, "sub"))]
    own = write_table(docs.withColumn("place", place).select("*", *bins), "mix-documents")
    plan = spark.createDataFrame([(p, t, m) for p, (t, m) in owed.items()], "pattern string, times long, more long")

    def cut(rows: DataFrame, keys: list[str], bin_: str) -> DataFrame:
        """The bin of each pattern where the owed words end, and what is owed within it. A bin that ends at the cut holds it."""
        sums = rows.groupBy(*keys, "more", bin_).agg(F.sum("size").alias("words"))
        before = F.sum("words").over(Window.partitionBy(*keys).orderBy(bin_)) - F.col("words")
        held = sums.withColumn("before", before).where((F.col("before") < F.col("more")) & (F.col("more") <= F.col("before") + F.col("words")))
        return held.select("pattern", F.col(bin_).alias(f"cut_{bin_}"), (F.col("more") - F.col("before")).alias(f"{bin_}_more"))

    # the plan and the cuts have one row for each pattern, as the driver's own tables
    named = own.join(F.broadcast(plan), "pattern")
    first = write_table(cut(named.where("more > 0"), ["pattern"], "bin"), "mix-bins")
    inside = own.join(F.broadcast(first), "pattern").where("bin = cut_bin").withColumnRenamed("bin_more", "more")
    second = write_table(cut(inside, ["pattern"], "sub"), "mix-subs")
    whole = named.join(F.broadcast(first), "pattern", "left").join(F.broadcast(second), "pattern", "left")
    at, sub = F.col("bin"), F.col("sub")
    before = (F.col("more") > 0) & ((at < F.col("cut_bin")) | ((at == F.col("cut_bin")) & (sub < F.col("cut_sub"))))
    here = F.coalesce((at == F.col("cut_bin")) & (sub == F.col("cut_sub")), F.lit(False))
    placed = whole.withColumn("here", here).withColumn("taken", F.col("times") * F.col("size") + F.when(before, F.col("size")).otherwise(0))
    order = Window.partitionBy("pattern").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum("size").over(order), F.lit(0))
    last = placed.where("here").withColumn("taken", F.col("taken") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("sub_more") - passed)))
    cols = [*docs.columns, "taken"]
    return placed.where("not here").select(*cols).unionByName(last.select(*cols))


def mix(docs: DataFrame, id_: str, size: str, sources: str | Column, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 42, most_patterns: int = 200_000) -> DataFrame:
    """doc_id, sources, size, taken (words taken, repeats counted), and for its sources, in order: source_size and target.

    sources: array column of a document's sources. weights: repeated over the sources in order."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_).alias("doc_id"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), (F.col(sources) if isinstance(sources, str) else sources).alias("sources"))
    own = own.withColumn("sources", F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>")))))
    own = own.withColumn("pattern", F.to_json("sources"))
    found = own.groupBy("pattern", "sources").agg(F.sum("size").alias("words")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"over {most_patterns} different sets of sources")
    supply = {tuple(_ordered(r.sources)): r.words for r in found}
    sizes: dict = defaultdict(int)
    for p, n in supply.items():
        for s in p:
            sizes[s] += n
    each = {s: weights[k % len(weights)] for k, s in enumerate(_ordered(sizes))}
    target = targets(dict(sizes), each, sum(n for p, n in supply.items() if p), most)
    flows = route(supply, {s: a // b for s, (a, b) in target.items()}, most)
    owed, facts = {}, []
    for r in found:
        p = tuple(_ordered(r.sources))
        x = sum(flows[p].values())
        owed[r.pattern] = divmod(x, r.words) if r.words else (0, 0)
        facts.append((r.pattern, [sizes[s] for s in p], [target[s][0] / target[s][1] for s in p]))
    told = F.broadcast(spark.createDataFrame(facts, "pattern string, source_sizes array<long>, targets array<double>"))
    return take(own.drop("sources"), owed, seed).join(told, "pattern").select("doc_id", "pattern", "size", "taken", "source_sizes", "targets")


ORACLE = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size, md5('42|' || cast(doc_id as varchar)) as place from documents),
s as (
  select source, cast(sum(size) as bigint) as size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as w from d group by source),
-- a source is at its greatest when, with all of a smaller greatest size for its weight, the share of the rest is above it
o as (
  select *, sum(3 * size) over before as taken, sum(w) over behind as weight, sum(size) over () as total from s
  window before as (order by size / w, source nulls last rows between unbounded preceding and 1 preceding),
    behind as (order by size / w, source nulls last rows between current row and unbounded following)),
c as (select *, (total - coalesce(taken, 0)) * w > 3 * size * weight as above from o),
f as (
  select source, size, w, above, max(total) over () - coalesce(sum(case when above then 3 * size end) over (), 0) as rest, sum(case when above then 0 else w end) over () as weight from c),
t as (
  select source, size, case when above then cast(3 * size as double) else cast(rest * w as double) / weight end as target,
    cast(case when above then 3 * size else (rest * w) // weight end as bigint) as owed from f),
r as (
  select doc_id, d.size, t.size as source_size, target, owed // greatest(1, t.size) as times, owed % greatest(1, t.size) as more,
    coalesce(sum(d.size) over (partition by d.source order by place, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as passed
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(times * size + greatest(0, least(size, more - passed)) as bigint) as taken from r
"""
