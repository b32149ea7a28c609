"""Exact duplicates and contradictions across an owner's packs.

Groups are decided by partial aggregates (max_by, min, max) and never collected, so a group
that holds a third of all facts costs one aggregate row per map task. Facts are then joined
back to one row per group; AQE splits that join where a group is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import norm_value, quality, value_text

DUP = ["owner_id", "key", "norm_id"]


def normalized_values(facts: DataFrame) -> DataFrame:
    return facts.withColumn("norm", norm_value())


def with_norm_id(facts: DataFrame) -> DataFrame:
    """Digest of the normalised value: long texts are compared and shuffled by digest. Facts that have it keep it."""
    return facts if "norm_id" in facts.columns else facts.withColumn("norm_id", F.md5(norm_value()))


def _keepers(facts: DataFrame) -> DataFrame:
    """One row per (owner, key, value): group size and the place of the best copy."""
    place = F.struct("pack", "pos")
    return facts.groupBy(*DUP).agg(
        F.count(F.lit(1)).alias("copies"),
        F.max_by(place, F.struct(quality().alias("q"), place.alias("at"))).alias("best"))


def placed_copies(facts: DataFrame) -> tuple[DataFrame, Column]:
    """(all facts without values, with their digest and, where they have copies, the place of the best one; whether a fact goes)."""
    # a small file of many facts is read by few tasks: its copies are sorted and looked up by all
    slim = with_norm_id(facts).select(*DUP, "pack", "pos", "confidence", "updated_at").repartition("owner_id", "pack", "pos")
    groups = _keepers(slim).where(F.col("copies") > 1).select(*DUP, F.col("best.pack").alias("kept_in"), F.col("best.pos").alias("kept_pos"))
    goes = F.coalesce((F.col("pack") != F.col("kept_in")) | (F.col("pos") != F.col("kept_pos")), F.lit(False))
    return slim.join(groups, DUP, "left"), goes


def losing_copies(facts: DataFrame) -> DataFrame:
    """(owner_id, pack, pos, kept_in, kept_pos) of every copy but the best one, without values."""
    placed, goes = placed_copies(facts)
    return placed.where(goes).select("owner_id", "pack", "pos", "kept_in", "kept_pos")


def exact_duplicates(facts: DataFrame) -> DataFrame:
    """Every copy but the best one: where it is removed from and where the value stays.

    The hot (key, value) groups are shuffled without their values; the values of the losers are
    fetched by (owner, pack, pos), which is unique and so spreads evenly.
    """
    losers = losing_copies(facts)
    return (facts.join(losers, ["owner_id", "pack", "pos"])
            .select("owner_id", "key", "pos", value_text().alias("value"), F.col("pack").alias("removed_from"),
                    "kept_in", "kept_pos"))


def drop_exact_duplicates(facts: DataFrame) -> DataFrame:
    return facts.join(losing_copies(facts).select("owner_id", "pack", "pos"), ["owner_id", "pack", "pos"], "left_anti")


def contradictory_keys(facts: DataFrame) -> DataFrame:
    """Keys with more than one distinct value: smallest and largest digest differ."""
    return (with_norm_id(facts).groupBy("owner_id", "key")
            .agg(F.min("norm_id").alias("lo"), F.max("norm_id").alias("hi"), F.count(F.lit(1)).alias("entries"))
            .where(F.col("lo") != F.col("hi")).select("owner_id", "key", "entries"))


def contradictions(facts: DataFrame) -> DataFrame:
    """All entries of contradictory keys, one row per fact in (pack, pos) order."""
    return (normalized_values(facts).join(contradictory_keys(facts), ["owner_id", "key"])
            .select("owner_id", "key", "pack", "pos", "norm", "entries"))


def consolidation_summary(facts: DataFrame) -> DataFrame:
    """Per owner: duplicate copies, contradictory keys, packs that lose facts."""
    losers = exact_duplicates(facts)
    dup = losers.groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("merged"), F.count_distinct("removed_from").alias("modified_packs"))
    conf = contradictory_keys(facts).groupBy("owner_id").agg(F.count(F.lit(1)).alias("contradictions"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["merged", "modified_packs", "contradictions"]}
    return dup.join(conf, "owner_id", "full").withColumns(zero)
