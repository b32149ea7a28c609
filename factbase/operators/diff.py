"""Comparison of two versions of packs by fact key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import strip

KEYS = ["owner_id", "pack", "key"]


def _last_by_key(facts: DataFrame, side: str) -> DataFrame:
    """A repeated key counts with its last fact. Places are settled first, so values are moved once and never sorted."""
    last = facts.groupBy(*KEYS).agg(F.max("pos").alias("pos"))
    return facts.join(last, [*KEYS, "pos"], "left_semi").select(*KEYS, F.struct("value_items", "value_is_list", "pos").alias(side))


def _same_value(a: str, b: str) -> F.Column:
    items_a, items_b = F.col(f"{a}.value_items"), F.col(f"{b}.value_items")
    list_a, list_b = F.col(f"{a}.value_is_list"), F.col(f"{b}.value_is_list")
    as_set = lambda x: F.array_sort(F.array_distinct(x))
    text = lambda x, is_list: F.lower(strip(
        F.when(is_list, F.array_join(F.array_sort(x), ", ")).otherwise(F.get(x, F.lit(0)))))
    return (F.when(list_a & list_b, as_set(items_a) == as_set(items_b))
            .otherwise(text(items_a, list_a) == text(items_b, list_b)))


def diff_packs(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per key: matching, conflict, only_in_source or only_in_target."""
    both = _last_by_key(source, "s").join(_last_by_key(target, "t"), KEYS, "full_outer")
    status = (F.when(F.col("t").isNull(), "only_in_source").when(F.col("s").isNull(), "only_in_target")
              .when(_same_value("s", "t"), "matching").otherwise("conflict"))
    return both.select(
        *KEYS, status.alias("status"), F.col("s.pos").alias("source_pos"), F.col("t.pos").alias("target_pos"),
        F.array_join("s.value_items", ", ").alias("source_value"),
        F.array_join("t.value_items", ", ").alias("target_value"))


def diff_summary(source: DataFrame, target: DataFrame, by: list[str] = KEYS[:2]) -> DataFrame:
    s = F.col("status")
    return diff_packs(source, target).groupBy(*by).agg(
        *[F.count_if(s == n).alias(n) for n in ["matching", "conflict", "only_in_source", "only_in_target"]],
        F.bool_or(s != "matching").alias("has_differences"))
