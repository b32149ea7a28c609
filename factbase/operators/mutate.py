"""Writes to packs as joins of the current tables with a batch of changes.

New rows get positions behind the pack's last one, in request order: last position + sequence
number + 1. That keeps order without numbering a whole pack in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import as_ts, strip

PACK = ["owner_id", "pack"]
KEYS = ["owner_id", "pack", "key"]


def _ends(packs: DataFrame, rows: DataFrame) -> DataFrame:
    """Last position per existing pack, -1 when empty."""
    last = rows.groupBy(*PACK).agg(F.max("pos").alias("_last"))
    return (packs.select(*PACK).join(last, PACK, "left")
            .withColumn("_last", F.coalesce("_last", F.lit(-1).cast("bigint"))))


def upsert_facts(facts: DataFrame, packs: DataFrame, writes: DataFrame, as_of) -> DataFrame:
    """writes(owner_id, pack, seq, key, value_items, value_is_list, type).

    The last write of a key sets the value; the first one fixes the type of a new key. Existing
    keys keep type and confidence. Writes to unknown packs are dropped.
    """
    w = writes.groupBy(*KEYS).agg(
        F.max_by(F.struct("value_items", "value_is_list"), "seq").alias("_w"),
        F.min_by("type", "seq").alias("_type"), F.min("seq").alias("_first"), F.max("seq").alias("_lastseq"))
    first = (facts.select(*KEYS, "pos").join(w.select(*KEYS), KEYS, "left_semi")
             .groupBy(*KEYS).agg(F.min("pos").alias("pos")))
    hits = first.join(w, KEYS).select(*KEYS, "pos", "_w")
    hit = F.col("_w").isNotNull()
    kept = facts.join(hits, [*KEYS, "pos"], "left").withColumns({
        "value_items": F.when(hit, F.col("_w.value_items")).otherwise(F.col("value_items")),
        "value_is_list": F.when(hit, F.col("_w.value_is_list")).otherwise(F.col("value_is_list")),
        "source": F.when(hit, "mcp").otherwise(F.col("source")),
        "updated_at": F.when(hit, as_ts(as_of)).otherwise(F.col("updated_at"))}).select(*facts.columns)
    # a new key written twice is touched by its second write
    new = w.join(first, KEYS, "left_anti").join(_ends(packs, facts), PACK).withColumns({
        "pos": F.col("_last") + F.col("_first") + 1, "value_items": F.col("_w.value_items"),
        "value_is_list": F.col("_w.value_is_list"), "type": F.coalesce("_type", F.lit("context")),
        "confidence": F.lit("high"), "source": F.lit("mcp"), "updated_at": as_ts(as_of)})
    return kept.unionByName(new.select(*facts.columns))


def parse_value(text: str) -> tuple[F.Column, F.Column]:
    """(value_items, value_is_list): a text with a comma is a list of its non-empty parts."""
    listed = F.contains(F.col(text), F.lit(","))
    parts = F.filter(F.transform(F.split(text, ","), strip), lambda x: x != "")
    return F.when(listed, parts).otherwise(F.array(text)), listed


def replace_facts(facts: DataFrame, packs: DataFrame, adds: DataFrame, as_of) -> DataFrame:
    """adds(owner_id, pack, seq, key, value, type): every fact with the key goes, one is appended."""
    known = adds.join(packs.select(*PACK), PACK, "left_semi")
    last = known.groupBy(*KEYS).agg(F.max_by(F.struct("value", "type"), "seq").alias("_a"), F.max("seq").alias("_seq"))
    items, listed = parse_value("value")
    new = (last.join(_ends(packs, facts), PACK)
           .withColumns({"value": F.col("_a.value"), "type": F.coalesce("_a.type", F.lit("context"))})
           .withColumns({"pos": F.col("_last") + F.col("_seq") + 1, "value_items": items, "value_is_list": listed,
                         "confidence": F.lit("high"), "source": F.lit("manual"), "updated_at": as_ts(as_of)}))
    return facts.join(last.select(*KEYS), KEYS, "left_anti").unionByName(new.select(*facts.columns))


def append_rules(rules: DataFrame, packs: DataFrame, adds: DataFrame) -> DataFrame:
    """adds(owner_id, pack, seq, instruction, priority); priority 5 when absent."""
    new = adds.join(_ends(packs, rules), PACK).withColumns({
        "pos": F.col("_last") + F.col("seq") + 1,
        "priority": F.coalesce("priority", F.lit(5)).cast("int")})
    return rules.unionByName(new.select(*rules.columns))


def delete_packs(packs: DataFrame, facts: DataFrame, rules: DataFrame,
                 names: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    gone = names.select(*PACK).distinct()
    return tuple(t.join(gone, PACK, "left_anti") for t in (packs, facts, rules))
