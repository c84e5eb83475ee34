"""Document fingerprints as Merkle trees over leaves, paragraphs and sections. DataFrame functions only.

A text is cut into sections at empty lines, sections into paragraphs at line ends, paragraphs into leaves of
`WORDS` words (`SHORT_WORDS` in paragraphs under `SHORT` code points). A leaf's hash is the MD5 of its characters (all
128 bits); a paragraph hashes its leaves, a section its paragraphs, the root its sections. The fingerprint
string holds root, sections, paragraphs and leaves: equal roots mean equal trees, and where two trees part,
differing branches lead to the edited leaves. Likeness is the Dice share of common leaf hashes (1 for equal
fingerprints). Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F

WORDS, SHORT_WORDS, SHORT = 8, 2, 64
GAP = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
LEAF = rf"{GAP}*(?:{WORD}{GAP}*){{1,%d}}|{GAP}+"


def _paragraph(p: Column) -> Column:
    """`,` and a `.` with hash for each leaf."""
    leaves = F.when(F.length(p) < SHORT, F.regexp_extract_all(p, F.lit(LEAF % SHORT_WORDS), F.lit(0))).otherwise(F.regexp_extract_all(p, F.lit(LEAF % WORDS), F.lit(0)))
    return F.concat(F.lit(","), F.array_join(F.transform(leaves, lambda x: F.concat(F.lit("."), F.md5(x))), ""))


def _section(s: Column) -> Column:
    """`|`, hash over the paragraphs' hashes, then the paragraphs."""
    paragraphs = F.transform(F.split(s, "\n"), _paragraph)
    # the lambda gives the paragraphs a name, so that they are made once
    made = F.transform(F.array(paragraphs), lambda ps: F.concat(F.lit("|"), F.md5(F.array_join(F.transform(ps, F.md5), "")), F.array_join(ps, "")))
    return F.element_at(made, 1)


def fingerprint(text: Column) -> Column:
    """Root (32 hex digits) and tree of a text."""
    sections = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), _section)
    made = F.transform(F.array(sections), lambda ss: F.concat(F.md5(F.array_join(F.transform(ss, lambda s: F.substring(s, 2, 32)), "")), F.array_join(ss, "")))
    return F.element_at(made, 1)


def leaves(fp: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(fp, F.lit(r"\.([0-9a-f]{32})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Dice share of two arrays of leaf hashes; 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing_leaves(a: Column, b: Column) -> Column:
    """Leaf hashes of the first fingerprint that the second lacks: where an edit took place."""
    return F.array_except(leaves(a), leaves(b))


FAN = 128


def _order() -> WindowSpec:
    """Within a group: the copy of the document before the range first, then by id, start of the MD5, and text."""
    return Window.partitionBy("bucket").orderBy("place", "doc_id", "h", "text")


def _place(c: Column, borders: list[int]) -> Column:
    """How many of the sorted borders are at most c, by a search tree of literal arrays with `FAN` branches."""
    below = lambda values: F.size(F.filter(values, lambda b: b <= c))
    if len(borders) <= FAN:
        return below(F.lit(borders).cast("array<bigint>"))
    heads = borders[::FAN]
    which = F.greatest(_place(c, heads), F.lit(1))
    leaves_ = F.lit([borders[k : k + FAN] for k in range(0, len(borders), FAN)]).cast("array<array<bigint>>")
    return (which - 1) * FAN + below(F.element_at(leaves_, which))


def with_next(docs: DataFrame, rows_per_bucket: int = 1_000, most_buckets: int = 16_384) -> DataFrame:
    """doc_id, text, next_text: the following document by descending doc_id (after the last: the first).

    One shuffle of texts: ranges of ids between sampled quantiles are window groups, so ids may lie as they like, and
    each group also gets a copy of the document just before its range. Rows of one doc_id follow each other by
    descending (start of the MD5 of the text, text). Null ids come last; there the MD5 makes the ranges, so that they
    are spread as well. The borders are at most `most_buckets` numbers, whatever the table's size: beyond
    `rows_per_bucket` rows for each of them the groups grow, and a task sorts its groups with Spark's spilling."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("known")).first()
    buckets = int(max(1, min(most_buckets, got["known"] // rows_per_bucket)))
    spare = int(max(1, min(most_buckets, (got["n"] - got["known"]) // rows_per_bucket)))
    borders: list[int] = []
    if buckets > 1:
        cuts = F.approx_percentile("doc_id", [k / buckets for k in range(1, buckets)], F.lit(20 * buckets))
        borders = sorted({*rows.agg(cuts.alias("q")).first()["q"]})
    rows = rows.withColumn("h", F.substring(F.md5("text"), 1, 8))
    without = F.floor(F.conv("h", 16, 10).cast("double") / F.lit(2.0**32) * spare) - spare
    place = _place(F.col("doc_id"), borders) if borders else F.lit(0)
    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), without).otherwise(place).cast("int"))
    ends = rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    to = ends.select("last", F.lead("bucket").over(order).alias("to"), F.min("bucket").over(Window.partitionBy(F.lit(0))).alias("least"))
    to = to.select(F.col("last.doc_id").alias("last_id"), F.col("last.h").alias("last_h"), F.coalesce("to", "least").alias("target"), F.col("to").isNull().alias("wraps"))
    meets = F.col("doc_id").eqNullSafe(F.col("last_id")) & (F.col("h") == F.col("last_h"))
    copies = rows.join(F.broadcast(to), meets).select("doc_id", "text", "h", F.col("target").alias("bucket"), F.when(F.col("wraps"), 0).otherwise(1).alias("place"))
    both = rows.withColumn("place", F.lit(2)).unionByName(copies)
    return both.select("doc_id", "text", "place", "bucket", "h", F.lag("text").over(_order()).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the document with its last half replaced by the beginning of the next document. Repeated
    rows follow each other like any documents. Empty texts have the fingerprint of the empty tree; their edited
    text is empty too. A table of one row has itself as the next document. Extra columns are ignored."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = with_next(docs).withColumn("fingerprint", fingerprint(F.col("text")))
    rows = rows.select("*", F.lag("fingerprint").over(_order()).alias("next_fingerprint")).where("place = 2")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    rows = rows.select("*", leaves(F.col("fingerprint")).alias("a"), leaves(F.col("edited_fingerprint")).alias("b"), leaves(F.col("next_fingerprint")).alias("c"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))


def _sql_fingerprint(text: str) -> str:
    leaf = lambda k: f"regexp_extract_all(p, '{LEAF % k}')"
    paragraph = f"list_transform(string_split(s, chr(10)), lambda p: ',' || array_to_string(list_transform(CASE WHEN length(p) < {SHORT} THEN {leaf(SHORT_WORDS)} ELSE {leaf(WORDS)} END, lambda x: '.' || md5(x)), ''))"
    section = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {paragraph})"
    hashed = f"list_transform({section}, lambda ps: '|' || md5(array_to_string(list_transform(ps, lambda p: md5(p)), '')) || array_to_string(ps, ''))"
    return f"list_transform([{hashed}], lambda ss: md5(array_to_string(list_transform(ss, lambda s: substr(s, 2, 32)), '')) || array_to_string(ss, ''))[1]"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lag(text) OVER (ORDER BY doc_id NULLS FIRST, substr(md5(text), 1, 8), text), last_value(text) OVER (ORDER BY doc_id NULLS FIRST, substr(md5(text), 1, 8), text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_text FROM d),
e AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited FROM n),
f AS (SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, {_sql_fingerprint("text")} AS fingerprint, {_sql_fingerprint("edited")} AS edited_fingerprint, {_sql_fingerprint("next_text")} AS nf FROM e),
g AS (SELECT *, list_distinct(regexp_extract_all(fingerprint, '\\.([0-9a-f]{{32}})', 1)) AS a, list_distinct(regexp_extract_all(edited_fingerprint, '\\.([0-9a-f]{{32}})', 1)) AS b, list_distinct(regexp_extract_all(nf, '\\.([0-9a-f]{{32}})', 1)) AS c FROM f)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_edited,
  CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) END AS near_next
FROM g
"""
