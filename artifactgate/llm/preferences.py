"""Preference formatting in DataFrame functions only.

Two conversations make a pair, one chosen and one rejected. Their longest common
prefix of turns (equal role and text) is rendered once, as the prompt; the rest
of each is its completion. A completion's mask names the ranges, in code points
of the completion, that bear loss: the text of assistant turns with its end mark.

One shuffle brings a pair's turns together; prefix, rendering and masks are folds
over them. A pair's row holds its two conversations and nothing else.

Defined results: turns go in the order of turn, role and text, nulls first, and
equal rows count once; a null role is rendered as "unknown" and a null text as
empty; a pair with one conversation only has no prompt and an empty completion
on the other side; equal conversations are all prompt. A text is rendered as it
is, marks that it holds included: masks go by turns, not by marks. Rows without
conv_id belong to no pair. Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _piece(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(turn["text"], F.lit("")), F.lit(f"{END}\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _piece), "")


def _prefix(a: Column, b: Column) -> Column:
    """Number of leading turns of equal role and text."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def _mask(turns: Column) -> Column:
    """start:end of each assistant turn's text and end mark, comma-joined."""
    fold = F.aggregate(
        turns,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(_piece(t))).alias("at"),
            F.when(
                t["role"] == "assistant",
                F.array_append(s["spans"], F.concat_ws(":", (s["at"] + len(START) + len("assistant\n")).cast("string"), (s["at"] + F.length(_piece(t)) - 1).cast("string"))),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
    )
    return F.array_join(fold["spans"], ",")


def formatted(turns: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected and their masks.

    turns: (pair_id, rejected boolean, turn, role, text).
    """
    both = turns.where("pair_id IS NOT NULL").groupBy("pair_id").agg(F.sort_array(F.collect_set(F.struct("rejected", "turn", "role", "text"))).alias("turns"))
    sides = both.select("pair_id", F.filter("turns", lambda t: ~t["rejected"]).alias("a"), F.filter("turns", lambda t: t["rejected"]).alias("b"))
    cut = sides.withColumn("n", _prefix(F.col("a"), F.col("b")))
    rest = lambda x: F.slice(x, F.col("n") + 1, F.greatest(F.size(x) - F.col("n"), F.lit(0)))
    cut = cut.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("prompt"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return cut.select(
        "pair_id",
        F.col("n").cast("bigint").alias("n_prompt_turns"),
        _rendered(F.col("prompt")).alias("prompt"),
        _rendered(F.col("a")).alias("chosen"),
        _rendered(F.col("b")).alias("rejected"),
        _mask(F.col("a")).alias("chosen_mask"),
        _mask(F.col("b")).alias("rejected_mask"),
    )


def report(conversations: DataFrame) -> DataFrame:
    """Pairs of conversations 2k (chosen) and 2k + 1 (rejected)."""
    turns = conversations.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id").bitwiseAND(1) == 1).alias("rejected"), "turn", "role", "text")
    return formatted(turns)


#: DuckDB SQL for report() over the table conversations.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
         '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)),
m AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         a.i IS NOT NULL AND b.i IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM t WHERE side = 0) a FULL OUTER JOIN (SELECT * FROM t WHERE side = 1) b ON a.pair_id = b.pair_id AND a.i = b.i),
p AS (SELECT pair_id, coalesce(min(i) FILTER (NOT same) - 1, max(i)) AS n FROM m GROUP BY pair_id),
r AS (
  SELECT t.*, n, i > n AS rest,
         coalesce(sum(length(piece)) FILTER (i > n) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM t JOIN p USING (pair_id)),
s AS (SELECT *, CAST(o + 22 AS VARCHAR) || ':' || CAST(o + length(piece) - 1 AS VARCHAR) AS span FROM r)
SELECT pair_id, CAST(any_value(n) AS BIGINT) AS n_prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 0 AND NOT rest), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 0 AND rest), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY i) FILTER (side = 1 AND rest), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 0 AND rest AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 1 AND rest AND role = 'assistant'), '') AS rejected_mask
FROM s GROUP BY pair_id
"""
