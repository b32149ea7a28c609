"""Expiry of facts by type, source and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import age_days, as_ts, value_text

# Days to live, import and confidence multipliers, warning window.
BASE_TTL = {"skill": 180, "preference": 120, "style": 150, "constraint": 90, "context": 90}
OTHER_TTL = 90
IMPORT_FACTOR, MEDIUM_FACTOR, LOW_FACTOR = 0.66, 0.75, 0.5
WARNING_DAYS = 14
PACK = ["owner_id", "pack"]


def ttl_days() -> Column:
    base = F.lit(float(OTHER_TTL))
    for name, days in BASE_TTL.items():
        base = F.when(F.col("type") == name, F.lit(float(days))).otherwise(base)
    imported = F.when(F.endswith("source", F.lit("-import")), F.lit(IMPORT_FACTOR)).otherwise(F.lit(1.0))
    conf = (F.when(F.col("confidence") == "low", F.lit(LOW_FACTOR))
            .when(F.col("confidence") == "medium", F.lit(MEDIUM_FACTOR)).otherwise(F.lit(1.0)))
    return F.when(F.col("type") != "identity", F.floor(base * imported * conf)).cast("bigint")


def fact_ttl(facts: DataFrame) -> DataFrame:
    return facts.withColumn("ttl_days", ttl_days())


def decay_status(facts: DataFrame, packs: DataFrame, as_of) -> DataFrame:
    """facts + ttl_days, age_days, remaining_days, status (expired / warning / preserved)."""
    made = packs.select(*PACK, F.col("created_at").alias("_made"))
    age = age_days(as_of, F.coalesce(F.col("updated_at"), F.col("_made"), as_ts(as_of)))
    left = F.col("remaining_days")
    return (fact_ttl(facts).join(made, PACK, "left")
            .withColumn("age_days", age).drop("_made")
            .withColumn("remaining_days", F.col("ttl_days") - F.col("age_days"))
            .withColumn("status", F.when(left <= 0, "expired").when(left <= WARNING_DAYS, "warning")
                        .otherwise("preserved")))


def decay_report(facts: DataFrame, packs: DataFrame, as_of) -> DataFrame:
    """The expired and soon-to-expire facts with their value text."""
    return (decay_status(facts, packs, as_of).where(F.col("status") != "preserved")
            .withColumn("value", value_text()))


def decay_summary(facts: DataFrame, packs: DataFrame, as_of) -> DataFrame:
    s = F.col("status")
    return decay_status(facts, packs, as_of).groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(s == "expired").alias("expired"),
        F.count_if(s == "warning").alias("warning"), F.count_if(s != "expired").alias("preserved"))


def apply_decay(facts: DataFrame, packs: DataFrame, as_of) -> DataFrame:
    return decay_status(facts, packs, as_of).where(F.col("status") != "expired").select(*facts.columns)


def refresh_facts(facts: DataFrame, refreshes: DataFrame, as_of) -> DataFrame:
    """Set updated_at on the first fact with the requested key of each (owner, pack, key)."""
    keys = [*PACK, "key"]
    wanted = refreshes.select(*keys).distinct()
    first = (facts.select(*keys, "pos").join(wanted, keys, "left_semi")
             .groupBy(*keys).agg(F.min("pos").alias("pos")).withColumn("_hit", F.lit(True)))
    return (facts.join(first, [*keys, "pos"], "left")
            .withColumn("updated_at", F.when(F.col("_hit"), as_ts(as_of)).otherwise(F.col("updated_at")))
            .withColumn("refreshed", F.coalesce("_hit", F.lit(False))).drop("_hit"))
