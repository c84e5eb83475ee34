"""URL filter: explicit rules first, then a path-template tree per host judged by smoothed labelled purity.

1. Host and path are cut out of the URL; of the rules that fit (host or a parent domain of it, and a prefix of the
   path), the longest decides.
2. Template tree, level by level to the last segment: under each node (host, template so far) a segment that is
   frequent enough stays constant (`support` pages, and either `share` of the node or `labels` labelled pages), all
   others become `*`. Constants with labels are dealt to `bins` by their share of blocked labels; neighbouring bins
   that a two-proportion z-test cannot tell apart (`z`) merge into one branch, written `{a|+k}`: its least segment
   and the number of the others. So a node is at most `bins` rows wherever its siblings meet. Levels end early once no
   node has `support` pages: whatever follows is `*`.
3. A template's purity is (blocked + strength * prior) / (labelled + strength); pages of templates at or above
   `threshold` are blocked. Labels are the verdicts of rules (`judge`), or any given ones (`templates`).

Every level is a count with partial sums and a join on (host, template, segment) with the constants, which are written
first: a small table is broadcast, a larger one joined with hot keys split. Pages whose path has ended leave the loop.
A null URL, or one without `://`, has empty host and path and the empty template. Ties between equally long rules go to
the first in the list. Repeated rows are repeated; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

#: The rules of the test query, in order: (verdict, host, path prefix).
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


@dataclass(frozen=True)
class Config:
    support: int = 5
    share: float = 0.02
    labels: int = 10
    bins: int = 64
    z: float = 1.96
    strength: float = 4.0
    prior: float = 0.25
    threshold: float = 0.5


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract of this module."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)], F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def _sums() -> list[Column]:
    count = lambda v: F.count(F.when(F.col("label") == v, 1)).alias({"block": "blocked", "allow": "allowed"}[v])
    return [F.count(F.lit(1)).alias("n"), count("block"), count("allow")]


def _branches(counts: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    """host, template, segment, name: the constants of one level, after merging."""
    node = ["host", "template"]
    labelled = F.col("blocked") + F.col("allowed")
    kept = counts.where(F.col("n") >= config.support).join(nodes, node).where((F.col("n") >= F.col("total") * config.share) | (labelled >= config.labels))
    bin_of = F.when(labelled >= config.labels, F.least(F.floor(F.col("blocked") / labelled * config.bins), F.lit(config.bins - 1)).cast("int"))
    kept = kept.select(*node, "segment", "blocked", labelled.alias("met"), bin_of.alias("bin"))
    bins = kept.where("bin is not null").groupBy(*node, "bin").agg(F.sum("blocked").alias("blocked"), F.sum("met").alias("met"), F.count(F.lit(1)).alias("members"), F.min("segment").alias("least"))
    w = Window.partitionBy(*node).orderBy("bin")
    n0, p1, p0 = F.lag("met").over(w), F.col("blocked") / F.col("met"), F.lag(F.col("blocked") / F.col("met")).over(w)
    pooled = (F.col("blocked") + F.lag("blocked").over(w)) / (F.col("met") + n0)
    error = F.sqrt(F.greatest(pooled * (1 - pooled) * (1 / F.col("met") + 1 / n0), F.lit(1e-12)))
    apart = F.when(p0.isNotNull() & (F.abs(p1 - p0) <= config.z * error), 0).otherwise(1)
    branch = bins.withColumn("apart", apart).withColumn("branch", F.sum("apart").over(w))
    all_of = Window.partitionBy(*node, "branch")
    members, least = F.sum("members").over(all_of), F.min("least").over(all_of)
    name = F.when(members > 1, F.concat(F.lit("{"), least, F.lit("|+"), (members - 1).cast("string"), F.lit("}"))).otherwise(least)
    named = write_table(branch.select(*node, "bin", name.alias("name")), "url-bins")
    merged = kept.where("bin is not null").join(named, [*node, "bin"]).select(*node, "segment", "name")
    return write_table(merged.unionByName(kept.where("bin is null").select(*node, "segment", F.col("segment").alias("name"))), "url-branches")


def templates(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """pages: page_id, host, path, label (block, allow or null). Adds template, blocked, allowed, purity, method verdict."""
    segments = F.split(F.substr("path", F.lit(2)), "/")
    at = pages.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments)).withColumn("template", F.lit(""))
    columns = at.columns
    wild = lambda x: F.concat(F.lit("/"), F.when(x == "", "").otherwise("*"))
    done = at.where(F.size("segments") == 0)
    at = at.where(F.size("segments") > 0)
    level = 0
    while True:
        now = at.withColumn("segment", F.element_at("segments", level + 1))
        counts = write_table(now.groupBy("host", "template", "segment").agg(*_sums()), "url-counts")
        nodes = write_table(counts.groupBy("host", "template").agg(F.sum("n").alias("total")), "url-nodes")
        if (nodes.agg(F.max("total")).first()[0] or 0) < config.support:
            rest = F.array_join(F.transform(F.slice("segments", F.lit(level + 1), F.size("segments")), wild), "")
            done = done.unionByName(at.withColumn("template", F.concat("template", rest)))
            break
        named = now.join(_branches(counts, nodes, config), ["host", "template", "segment"], "left")
        step = F.coalesce(F.concat(F.lit("/"), "name"), wild(F.col("segment")))
        level += 1
        # written, as each level is both counted and joined: else the plan would double with every level
        stepped = write_table(named.withColumn("template", F.concat("template", step)).select(*columns), "url-templates")
        done = done.unionByName(stepped.where(F.size("segments") <= level))
        at = stepped.where(F.size("segments") > level)
    judged = done.groupBy("host", "template").agg(*_sums())
    purity = (F.col("blocked") + config.strength * config.prior) / (F.col("blocked") + F.col("allowed") + config.strength)
    judged = judged.withColumn("purity", purity).withColumn("method", F.when(F.col("purity") >= config.threshold, "block").otherwise("allow"))
    return done.drop("segments").join(write_table(judged, "url-judged"), ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, config: Config = Config()) -> DataFrame:
    """pages: page_id, url. Returns page_id, host, path, rule, verdict, template, purity of every row."""
    host, path = parts(F.col("url"))
    cut = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    labelled = cut.select("*", rule.alias("rule"), verdict.alias("label"))
    out = templates(labelled, config)
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "method").alias("verdict"), "template", "purity")
