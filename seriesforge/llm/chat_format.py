"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The longest common turn prefix of the two sides (same role and text, in turn
order) is rendered once as the prompt. What follows on each side is its
completion, with a mask that marks the text of assistant turns for training.
One shuffle by pair; the turns of a pair are gathered in one row because the
rendered conversation is one value of the result.

Cases: rows without conversation id belong to no pair; a null role or text
counts as empty; turns sort by (turn, role, text), nulls first, so ties and
repeated rows have one order; identical sides give two empty completions; a side
without turns is null; empty tables give an empty result; other columns are not
read. Native DataFrame code only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Run lengths in code points, in turn: '0:n' is context, '1:n' is trained."""
    head = lambda t: F.length(t["role"]) + F.lit(5)
    trained = lambda t: F.concat(F.lit("0:"), head(t).cast("string"), F.lit(" 1:"), (F.length(t["text"]) + 1).cast("string"))
    context = lambda t: F.concat(F.lit("0:"), (head(t) + F.length(t["text"]) + 1).cast("string"))
    return F.array_join(F.transform(turns, lambda t: F.when(t["role"] == TRAINED_ROLE, trained(t)).otherwise(context(t))), " ")


def preference_pairs(turns: DataFrame) -> DataFrame:
    """turns(pair_id, side, turn, role, text), side 'chosen' or 'rejected' ->
    pair_id, n_prefix, prompt, chosen, chosen_mask, rejected, rejected_mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = (
        turns.where(F.col("pair_id").isNotNull())
        .groupBy("pair_id")
        .agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("chosen", "rejected")))
    )
    same = lambda i: (F.get("chosen", i)["role"] == F.get("rejected", i)["role"]) & (F.get("chosen", i)["text"] == F.get("rejected", i)["text"])
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.array_min(F.filter(places, lambda i: ~same(i)))
    out = gathered.withColumn("n_prefix", F.coalesce(differ, shorter))
    rest = {s: F.slice(F.col(s), F.col("n_prefix") + 1, F.size(s)) for s in ("chosen", "rejected")}
    out = out.select("pair_id", "n_prefix", F.slice("chosen", 1, F.col("n_prefix")).alias("shared"), *(F.when(F.size(s) > 0, r).alias(s) for s, r in rest.items()))
    return out.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        _render(F.col("shared")).alias("prompt"),
        *(c for s in ("chosen", "rejected") for c in (_render(F.col(s)).alias(s), _mask(F.col(s)).alias(f"{s}_mask"))),
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and rejected side of pair k."""
    odd = F.col("conv_id").bitwiseAND(F.lit(1)) == 1
    return conversations.select(F.shiftright("conv_id", 1).alias("pair_id"), F.when(odd, "rejected").otherwise("chosen").alias("side"), "turn", "role", "text")


def query(spark, sf_dir: str) -> DataFrame:
    pairs = preference_pairs(neighbours_as_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    digest = lambda c: F.sha2(F.encode(F.col(c), "UTF-8"), 256).alias(f"{c}_sha256")
    return pairs.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", digest("prompt"), digest("chosen"), "chosen_mask", digest("rejected"), "rejected_mask")


ORACLE = """
WITH turns AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn NULLS FIRST, role, text) AS n FROM turns
),
sizes AS (SELECT pair_id, count(*) FILTER (side = 0) AS c, count(*) FILTER (side = 1) AS r FROM numbered GROUP BY pair_id),
differ AS (
  SELECT a.pair_id, min(a.n) - 1 AS n
  FROM numbered a JOIN numbered b ON a.pair_id = b.pair_id AND a.n = b.n AND a.side = 0 AND b.side = 1
  WHERE a.role <> b.role OR a.text <> b.text GROUP BY a.pair_id
),
prefix AS (SELECT pair_id, c, r, coalesce(n, least(c, r)) AS n_prefix FROM sizes LEFT JOIN differ USING (pair_id)),
lines AS (
  SELECT pair_id, side, n, '<|' || role || '|>' || chr(10) || text || chr(10) AS line,
    CASE WHEN role = 'assistant' THEN '0:' || (length(role) + 5) || ' 1:' || (length(text) + 1)
         ELSE '0:' || (length(role) + length(text) + 6) END AS mask
  FROM numbered
)
SELECT pair_id, n_prefix,
  coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND n <= n_prefix), '') AS prompt,
  CASE WHEN any_value(c) > 0 THEN coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND n > n_prefix), '') END AS chosen,
  CASE WHEN any_value(r) > 0 THEN coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 1 AND n > n_prefix), '') END AS rejected,
  sha256(coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND n <= n_prefix), '')) AS prompt_sha256,
  CASE WHEN any_value(c) > 0 THEN sha256(coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 0 AND n > n_prefix), '')) END AS chosen_sha256,
  CASE WHEN any_value(c) > 0 THEN coalesce(string_agg(mask, ' ' ORDER BY n) FILTER (side = 0 AND n > n_prefix), '') END AS chosen_mask,
  CASE WHEN any_value(r) > 0 THEN sha256(coalesce(string_agg(line, '' ORDER BY n) FILTER (side = 1 AND n > n_prefix), '')) END AS rejected_sha256,
  CASE WHEN any_value(r) > 0 THEN coalesce(string_agg(mask, ' ' ORDER BY n) FILTER (side = 1 AND n > n_prefix), '') END AS rejected_mask
FROM lines JOIN prefix USING (pair_id)
GROUP BY pair_id, n_prefix
"""
