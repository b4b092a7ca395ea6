"""Preference pairs from two conversations: one prompt, two masked completions.

The turns that chosen and rejected share from the start, in role and text, are
rendered once as the prompt; what follows in each is a completion. A mask lists
the spans (code points, end exclusive) of a completion that are trained on: the
assistant's texts with their end marks.

The two conversations of a pair meet in one group, which is the training
example itself; nothing larger is gathered.

Defined results: turns go by number, then role, then text; nulls sort first, a
null text is empty and a null role ``unknown``; rows without pair are left out;
a missing side has an empty completion and then there is no common prefix;
equal conversations leave both completions empty; an empty table gives no rows;
columns of other names do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before and after a turn's role and text.
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit(MIDDLE), t["text"], F.lit(END))), "")


def _mask(turns: Column) -> Column:
    """Spans as ``start:end``, joined by commas."""

    def step(a: Column, t: Column) -> Column:
        s = a["at"] + F.lit(len(START) + len(MIDDLE)) + F.length(t["role"])
        e = s + F.length(t["text"]) + F.lit(len(END))
        return F.struct(e.alias("at"), F.when(t["role"] == "assistant", F.array_append(a["out"], F.concat_ws(":", s.cast("string"), e.cast("string")))).otherwise(a["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")), step, lambda a: F.array_join(a["out"], ","))


def format_preferences(turns: DataFrame, pair: Column, is_chosen: Column, turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask, prompt_turns."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(is_chosen, F.lit(False)).alias("side"), turn.alias("t")).filter("pair_id is not null")
    both = rows.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.when(F.col("side"), F.col("t")))).alias("c"), F.sort_array(F.collect_list(F.when(~F.col("side"), F.col("t")))).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    n = F.array_position(same, False)
    both = both.withColumn("n", F.when(n > 0, n - 1).otherwise(F.least(F.size("c"), F.size("r"))).cast("int"))
    c, r = (F.slice(F.col(x), F.col("n") + 1, F.size(x)) for x in ("c", "r"))
    return both.select("pair_id", _render(F.slice(F.col("c"), F.lit(1), F.col("n"))).alias("prompt"), _render(c).alias("chosen"), _render(r).alias("rejected"), _mask(c).alias("chosen_mask"), _mask(r).alias("rejected_mask"), F.col("n").cast("long").alias("prompt_turns"))


def op9_preference_pairs(spark, sf_dir: str) -> DataFrame:
    """Conversations 2i and 2i + 1 as chosen and rejected."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_preferences(turns, F.expr("conv_id div 2"), F.col("conv_id") % 2 == 0)


OP9_SQL = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS side, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
d AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, min(coalesce(a.i, b.i)) FILTER (WHERE a.i IS NULL OR b.i IS NULL OR a.role <> b.role OR a.text <> b.text) AS first
      FROM (SELECT * FROM t WHERE side) a FULL JOIN (SELECT * FROM t WHERE NOT side) b ON a.pair_id = b.pair_id AND a.i = b.i GROUP BY 1),
m AS (SELECT pair_id, max(i) AS most FROM t GROUP BY pair_id),
n AS (SELECT d.pair_id, coalesce(first - 1, most) AS n FROM d JOIN m ON m.pair_id = d.pair_id),
x AS (SELECT t.*, n.n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t JOIN n ON n.pair_id = t.pair_id),
y AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x WHERE i > n),
z AS (SELECT *, before + 13 + length(role) AS s, before + length(line) AS e FROM y)
SELECT n.pair_id,
  coalesce((SELECT string_agg(line, '' ORDER BY i) FROM x WHERE x.pair_id = n.pair_id AND side AND i <= n.n), '') AS prompt,
  coalesce((SELECT string_agg(line, '' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND side), '') AS chosen,
  coalesce((SELECT string_agg(line, '' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND NOT side), '') AS rejected,
  coalesce((SELECT string_agg(s::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND side AND role = 'assistant'), '') AS chosen_mask,
  coalesce((SELECT string_agg(s::BIGINT::VARCHAR || ':' || e::BIGINT::VARCHAR, ',' ORDER BY i) FROM z WHERE z.pair_id = n.pair_id AND NOT side AND role = 'assistant'), '') AS rejected_mask,
  n.n::BIGINT AS prompt_turns
FROM n
"""
