"""Freshness scores 0..100 of facts, packs and owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import age_days

# Days to live per type and the confidence multipliers.
TTL_DAYS = {"skill": 365, "preference": 180, "style": 180, "constraint": 120, "context": 90}
OTHER_TTL = 90
MULTIPLIER = {"high": 1.0, "medium": 0.66, "low": 0.33}
PACK = ["owner_id", "pack"]


def _lookup(col: str, table: dict, default) -> Column:
    out = F.lit(default)
    for name, v in table.items():
        out = F.when(F.col(col) == name, F.lit(v)).otherwise(out)
    return out


def label(score: Column) -> Column:
    return (F.when(score >= 90, "fresh").when(score >= 60, "current").when(score >= 30, "aging")
            .when(score > 0, "stale").otherwise("expired"))


def fact_freshness(facts: DataFrame, packs: DataFrame, as_of, basis: str = "coalesce") -> DataFrame:
    """facts + freshness + label. basis 'coalesce' dates a fact by itself, then by its pack;
    'pack' always by its pack."""
    stamped = facts.join(packs.select(*PACK, F.col("updated_at").alias("_pack_ts")), PACK, "left")
    ref = F.col("_pack_ts") if basis == "pack" else F.coalesce("updated_at", "_pack_ts")
    ttl = _lookup("type", TTL_DAYS, OTHER_TTL).cast("double") * _lookup("confidence", MULTIPLIER, 1.0)
    days = F.greatest(F.lit(0), age_days(as_of, ref))
    # int() drops the fraction; negatives end at 0 either way
    score = F.greatest(F.lit(0), F.least(F.lit(100), (F.lit(100.0) * (F.lit(1.0) - days / ttl)).cast("bigint")))
    score = (F.when(F.col("type") == "identity", 100).when(ref.isNull(), 50).otherwise(score)).cast("bigint")
    return (stamped.withColumn("freshness", score).drop("_pack_ts")
            .withColumn("label", label(F.col("freshness"))))


def _int_avg(total: Column, n: Column) -> Column:
    return F.floor(total / n)


def pack_freshness_summary(facts: DataFrame, packs: DataFrame, as_of, basis: str = "coalesce") -> DataFrame:
    s = F.col("freshness")
    per_pack = fact_freshness(facts, packs, as_of, basis).groupBy(*PACK).agg(
        F.sum(s).alias("_sum"), F.count(F.lit(1)).alias("total"),
        F.count_if(s >= 90).alias("fresh"), F.count_if((s >= 60) & (s < 90)).alias("current"),
        F.count_if((s >= 30) & (s < 60)).alias("aging"), F.count_if((s > 0) & (s < 30)).alias("stale"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["total", "fresh", "current", "aging", "stale"]}
    return (packs.select(*PACK).join(per_pack, PACK, "left").withColumns(zero)
            .withColumn("score", F.when(F.col("total") == 0, 100)
                        .otherwise(_int_avg(F.col("_sum"), F.col("total"))).cast("bigint")).drop("_sum"))


def pack_freshness(facts: DataFrame, packs: DataFrame, as_of, basis: str = "coalesce") -> DataFrame:
    return pack_freshness_summary(facts, packs, as_of, basis).select(*PACK, "score")


def owner_freshness(facts: DataFrame, packs: DataFrame, as_of, owners: DataFrame | None = None,
                    basis: str = "coalesce") -> DataFrame:
    """Average of the pack scores; owners without packs (if `owners` is given) score 100."""
    per_owner = (pack_freshness(facts, packs, as_of, basis).groupBy("owner_id")
                 .agg(_int_avg(F.sum("score"), F.count(F.lit(1))).cast("bigint").alias("freshness")))
    if owners is None:
        return per_owner
    return (owners.select("owner_id").distinct().join(per_owner, "owner_id", "left")
            .withColumn("freshness", F.coalesce("freshness", F.lit(100).cast("bigint"))))
