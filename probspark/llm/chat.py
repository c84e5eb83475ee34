"""Preference formatting: the common turns of a chosen and a rejected conversation become one prompt, the rest
two completions whose assistant spans are marked for training. DataFrame functions only.

Turns meet by (pair, turn number): one shuffle, whose keys spread however long a conversation is. The first
turn at which the two sides differ (or one has none) ends the prompt. Text is assembled in blocks of
`BLOCK` consecutive turn numbers, one row each, so that no task gathers an endless conversation; nearly every
pair is one row, and concatenating a pair's blocks in order gives its whole prompt and completions.

Rendering: `<|role|>` newline text `<|end|>` newline. `<|` inside a text is written `< |`, so no text can
forge a marker. Masks are `start-end` code points of assistant texts with their end marker, comma-joined,
within the completion of the row.

Null texts count as empty, null roles as `unknown`, null turns come first (turn -1). Rows without a pair are
left out. Repeated rows of one turn count once; of different rows for the same turn the least (role, text)
counts. A side without conversation gives an empty completion. Empty tables give no row. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _render(x: Column) -> Column:
    return F.concat(_head(x["role"]), x["text"], F.lit("<|end|>\n"))


def _mask(turns: Column) -> Column:
    """Spans of assistant texts in the concatenation of rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(_head(x["role"]))
        end = start + F.length(x["text"]) + F.lit(len("<|end|>"))
        span = F.concat(F.when(acc["spans"] == "", "").otherwise(","), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.concat(acc["spans"], F.when(x["role"] == "assistant", span).otherwise("")).alias("spans"))

    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_preferences(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """turns: pair_id, chosen (boolean side), turn, role, text. Returns pair_id, block, n_prompt_turns (of the row),
    prompt, chosen, rejected, chosen_mask, rejected_mask."""
    clean = turns.where("pair_id is not null and chosen is not null").select(
        "pair_id",
        "chosen",
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")).alias("said"),
    )
    met = clean.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("chosen"), F.col("said"))).alias("c"), F.min(F.when(~F.col("chosen"), F.col("said"))).alias("r"))
    same = F.col("c").eqNullSafe(F.col("r"))
    ends = met.select("pair_id", "turn", same.alias("same")).groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("first_diff"))
    n_prompt = met.join(ends, "pair_id")
    shared = F.col("first_diff").isNull() | (F.col("turn") < F.col("first_diff"))
    rows = n_prompt.select("pair_id", F.floor(F.col("turn") / F.lit(block)).cast("long").alias("block"), F.struct("turn", shared.alias("shared"), "c", "r").alias("x"))
    gathered = rows.groupBy("pair_id", "block").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    side = lambda name: F.transform(F.filter("xs", lambda x: ~x["shared"] & x[name].isNotNull()), lambda x: x[name])
    parts = gathered.select(
        "pair_id",
        "block",
        F.transform(F.filter("xs", lambda x: x["shared"]), lambda x: x["c"]).alias("p"),
        side("c").alias("c"),
        side("r").alias("r"),
    )
    joined = lambda name: F.array_join(F.transform(name, _render), "")
    return parts.select("pair_id", "block", F.size("p").cast("long").alias("n_prompt_turns"), joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"), _mask(F.col("c")).alias("chosen_mask"), _mask(F.col("r")).alias("rejected_mask"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of the test table: conversation 2k is chosen, 2k + 1 rejected, for every k."""
    k = F.col("conv_id")
    return conversations.select(F.floor(k / 2).cast("long").alias("pair_id"), (F.pmod(k, F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


ORACLE = f"""
WITH said AS (
  SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, conv_id % 2 AS side, coalesce(turn, -1) AS turn,
         min(struct_pack(r := coalesce(role, 'unknown'), t := replace(coalesce(text, ''), '<|', '< |'))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2, 3),
met AS (SELECT pair_id, turn, any_value(s) FILTER (side = 0) AS c, any_value(s) FILTER (side = 1) AS r FROM said GROUP BY 1, 2),
ends AS (SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS first_diff FROM met GROUP BY 1),
marked AS (
  SELECT met.pair_id, CAST(floor(turn / {BLOCK}) AS BIGINT) AS block, turn, c, r, (first_diff IS NULL OR turn < first_diff) AS shared
  FROM met JOIN ends USING (pair_id)),
pieces AS (
  SELECT pair_id, block, turn, 'p' AS part, c AS s FROM marked WHERE shared
  UNION ALL SELECT pair_id, block, turn, 'c', c FROM marked WHERE NOT shared AND c IS NOT NULL
  UNION ALL SELECT pair_id, block, turn, 'r', r FROM marked WHERE NOT shared AND r IS NOT NULL),
rendered AS (
  SELECT *, '<|' || s.r || '|>' || chr(10) AS head, '<|' || s.r || '|>' || chr(10) || s.t || '<|end|>' || chr(10) AS piece FROM pieces),
placed AS (
  SELECT *, sum(length(piece)) OVER (PARTITION BY pair_id, block, part ORDER BY turn) - length(piece) AS pos FROM rendered)
SELECT pair_id, block, count(*) FILTER (part = 'p') AS n_prompt_turns,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (part = 'p'), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (part = 'c'), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY turn) FILTER (part = 'r'), '') AS rejected,
  coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (part = 'c' AND s.r = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY turn) FILTER (part = 'r' AND s.r = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id, block
"""
