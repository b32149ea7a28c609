"""Multi-party dialogues rendered from every participant's perspective, with loss masks.

For each participant the whole dialogue is rendered with that speaker as `assistant` and every other speaker as a
named `user`; context roles stay as they are. Rows are blocks of a dialogue: all turns whose number falls into one
range of BLOCK turns, so no dialogue is ever collected whole. Ordinary dialogues are one block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
           context: tuple[str, ...] = ("system",), block: int = BLOCK) -> DataFrame:
    """`conv`, speaker, part, n_turns, rendered, spans (start and end of each target, code points in rendered).

    One row per dialogue, participant and block, ordered by part. Participants are the distinct speakers but for
    context roles and null or blank ones (these are rendered as user `unknown`). A dialogue without participant gives
    no row. Turns are ordered by (turn, speaker, text), nulls first; repeated rows stay repeated turns. Turns without
    a number form block -1. A null text is an empty turn, whose target span is empty. Null dialogue ids are one
    dialogue. `<|` inside a text is written `< |`, so a text cannot end its turn. Other columns are not looked at.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(speaker).alias("who"),
                        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("body"))
    blocks = (rows.groupBy("conv", F.coalesce(F.floor(F.col("turn") / block), F.lit(-1)).alias("part"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "who", "body"))).alias("turns")))
    people = rows.where(F.trim("who") != "").where(~F.col("who").isin(*context)).select("conv", F.col("who").alias("me")).distinct()
    seen = blocks.join(people.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of")))
    held = ", ".join("'" + c.replace("'", "\\'") + "'" for c in context) or "''"
    head = (f"concat('<|im_start|>', case when t.who in ({held}) then t.who when t.who = me then 'assistant' "
            "else concat('user name=', if(trim(coalesce(t.who, '')) = '', 'unknown', t.who)) end, '\\n')")
    seen = seen.withColumn("lines", F.expr(
        f"transform(turns, t -> named_struct('head', {head}, 'body', t.body, 'mine', coalesce(t.who = me, false)))"))
    spans = F.expr("""
        aggregate(lines, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)),
            (a, x) -> named_struct('at', a.at + length(x.head) + length(x.body) + length('<|im_end|>\\n'),
                'spans', if(x.mine, concat(a.spans, array(named_struct('start', a.at + length(x.head),
                    'end', a.at + length(x.head) + length(x.body)))), a.spans)),
            a -> a.spans)""")
    return seen.select(
        F.col("conv").alias(conv), F.col("me").alias("speaker"), "part", F.size("turns").cast("long").alias("n_turns"),
        F.expr("array_join(transform(lines, x -> concat(x.head, x.body, '<|im_end|>\\n')), '')").alias("rendered"),
        spans.alias("spans"))
