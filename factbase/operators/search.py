"""Listing, filtering, capping and searching packs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions.values import conf_rank, value_text
from factbase.operators.freshness import fact_freshness, pack_freshness

PACK = ["owner_id", "pack"]


def search_context(packs: DataFrame, facts: DataFrame, rules: DataFrame, query: str) -> DataFrame:
    """Hits in key, value text or instruction, ignoring case; `block` orders facts before rules."""
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(c), q)
    hits = (facts.withColumn("value", value_text()).where(has("key") | has("value"))
            .select(*PACK, F.lit(0).alias("block"), "pos", F.concat_ws(": ", "key", "value").alias("line"))
            .unionByName(rules.where(has("instruction")).select(
                *PACK, F.lit(1).alias("block"), "pos", F.concat(F.lit("Rule: "), "instruction").alias("line"))))
    tag = F.concat(F.lit("["), "pack", F.lit("/"), "scope", F.lit("] "))
    return (hits.join(packs.select(*PACK, "scope"), PACK)
            .select(*PACK, "block", "pos", F.concat(tag, F.col("line")).alias("line")))


def filter_scopes(packs: DataFrame, scopes: list[str] | None) -> DataFrame:
    return packs.where(F.col("scope").isin(list(scopes))) if scopes else packs


def select_scope_or_name(packs: DataFrame, name: str) -> DataFrame:
    return packs.where((F.col("scope") == name) | (F.col("pack") == name))


def cap_facts(scored: DataFrame, n: int) -> DataFrame:
    """The n highest-priority facts per pack (Spark limits each map task to n rows per pack)."""
    w = Window.partitionBy(*PACK).orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cap_facts_by_confidence(facts: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy(*PACK).orderBy(conf_rank(), "pos")
    return facts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def list_packs(packs: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Packs with their fact and rule counts (both pre-aggregated before the join)."""
    count = lambda df, out: df.groupBy(*PACK).agg(F.count(F.lit(1)).alias(out))
    return (packs.join(count(facts, "n_facts"), PACK, "left").join(count(rules, "n_rules"), PACK, "left")
            .select(*PACK, "scope", F.coalesce("n_facts", F.lit(0)).alias("n_facts"),
                    F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "description"))


def show_pack(packs: DataFrame, facts: DataFrame, rules: DataFrame, name: str, as_of) -> DataFrame:
    """Everything to display of packs called `name`: a head row, facts with freshness, rules by priority."""
    p, f, r = (t.where(F.col("pack") == name) for t in (packs, facts, rules))
    head = p.join(pack_freshness(f, p, as_of), PACK).select(
        *PACK, F.lit(0).alias("block"), F.lit(0).cast("bigint").alias("ord"), F.lit(0).cast("bigint").alias("pos"),
        F.coalesce("description", F.lit("")).alias("line"), F.col("score"))
    body = fact_freshness(f, p, as_of).select(
        *PACK, F.lit(1).alias("block"), F.lit(0).cast("bigint").alias("ord"), "pos",
        F.concat_ws(": ", F.col("key"), value_text()).alias("line"), F.col("freshness").alias("score"))
    tail = r.select(*PACK, F.lit(2).alias("block"), (-F.col("priority")).cast("bigint").alias("ord"), "pos",
                    F.col("instruction").alias("line"), F.col("priority").cast("bigint").alias("score"))
    return head.unionByName(body).unionByName(tail)
