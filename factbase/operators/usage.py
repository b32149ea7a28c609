"""Access-log aggregation and priority scoring.

Counts are two-level: first per (fact, agent), then per fact, so a hot fact reaches its
reducer as a handful of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions.values import bucketed_rank

# Score weights, confidence weights and the high-priority threshold.
W_USAGE, W_FRESHNESS, W_CONFIDENCE = 0.4, 0.4, 0.2
CONF_WEIGHT = {"high": 1.0, "medium": 0.66, "low": 0.33}
THRESHOLD = 70.0
FACT = ["owner_id", "pack", "key"]
PACK = ["owner_id", "pack"]


def usage_by_agent(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row per (keys, agent): the per-agent call counts behind usage_by_fact / usage_by_pack.

    `log` holds single accesses (ts) or counted ones (calls, last_called), as serve_log returns them. Accesses of
    facts have a key; those of packs have none, and each kind is counted by itself.
    """
    counted = "calls" in log.columns
    calls = F.sum("calls") if counted else F.count(F.lit(1))
    log = log.where(F.col("key").isNotNull() if "key" in keys else F.col("key").isNull())
    return log.groupBy(*keys, "agent").agg(
        calls.alias("calls"), F.max("last_called" if counted else "ts").alias("last_called"))


def _totals(log: DataFrame, keys: list[str]) -> DataFrame:
    return usage_by_agent(log, keys).groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.max("last_called").alias("last_called"),
        F.count(F.lit(1)).alias("n_agents"),
        F.max_by("agent", F.struct("calls", "agent")).alias("top_agent"))


def usage_by_fact(log: DataFrame) -> DataFrame:
    return _totals(log, FACT)


def usage_by_pack(log: DataFrame) -> DataFrame:
    return _totals(log, PACK)


def usage_stats(log: DataFrame, pack: str | None = None, top: int = 20) -> DataFrame:
    """Most-called facts of each owner (a top-k report) together with all of the owner's packs."""
    log = log if pack is None else log.where(F.col("pack") == pack)
    w = Window.partitionBy("owner_id").orderBy(F.desc("calls"), "pack", "key")
    facts = (usage_by_fact(log).withColumn("rank", F.row_number().over(w))
             .where(F.col("rank") <= top).withColumn("kind", F.lit("fact")))
    packs = (usage_by_pack(log).withColumn("key", F.lit(None).cast("string"))
             .withColumn("kind", F.lit("pack")))
    cols = ["owner_id", "kind", "pack", "key", "calls", "last_called"]
    return facts.select(*cols).unionByName(packs.select(*cols))


def reset_usage(log: DataFrame, pack: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(remaining log, entries cleared per owner); an entry is one used fact or one used pack."""
    gone = log if pack is None else log.where(F.col("pack") == pack)
    left = log.limit(0) if pack is None else log.where(~F.col("pack").eqNullSafe(pack))
    entries = gone.select("owner_id", "pack", "key").distinct().groupBy("owner_id").agg(F.count(F.lit(1)).alias("cleared"))
    return left, entries


def drop_opted_out(log: DataFrame, settings: DataFrame) -> DataFrame:
    """Owners with track_usage = false leave no trace."""
    return log.join(settings.where(~F.col("track_usage")), "owner_id", "left_anti")


def usage_norm(calls: Column) -> Column:
    scaled = F.least(F.lit(100.0), F.log10(calls + 1) / F.log10(F.lit(1001.0)) * 100.0)
    return F.when(calls > 0, scaled).otherwise(F.lit(0.0))


def conf_weight(col: str = "confidence") -> Column:
    out = F.lit(1.0)
    for name, w in CONF_WEIGHT.items():
        out = F.when(F.col(col) == name, F.lit(w)).otherwise(out)
    return out


def priority_scores(facts: DataFrame, usage: DataFrame, freshness: Column | None = None) -> DataFrame:
    """facts + calls + score. `freshness` is a 0..100 column; the default is a constant 100.

    The usage side holds one row per fact key, so a hot key sits on the left only and AQE can
    split it.
    """
    fresh = F.lit(100.0) if freshness is None else freshness.cast("double")
    calls = F.coalesce(F.col("calls"), F.lit(0))
    raw = (usage_norm(calls) * W_USAGE + fresh * W_FRESHNESS
           + conf_weight() * F.lit(100.0) * W_CONFIDENCE)
    return (facts.join(usage.select(*FACT, "calls"), FACT, "left")
            .withColumn("calls", calls)
            .withColumn("score", F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 2)))


def rank_facts(scored: DataFrame) -> DataFrame:
    """rank 1.. per pack by score, then position. Score values and position blocks are the buckets."""
    return bucketed_rank(
        scored, PACK,
        {"_b1": -F.round(F.col("score") * 100).cast("int"), "_b2": F.shiftright("pos", 20)},
        [F.col("pos")], "rank")


def high_priority_facts(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") >= threshold)


def serve_log(requests: DataFrame, visible: DataFrame, facts: DataFrame, packs: DataFrame) -> DataFrame:
    """Accesses that requests leave behind, as a counted log (owner_id, pack, key, agent, calls, last_called).

    Card, profile and whole-context requests touch each visible pack once, whole-context requests with scopes only
    the packs of these; a pack request touches the pack and every fact in it. `requests` needs (owner_id, agent, tool,
    pack_arg, scope_arg, ts), where scope_arg is a comma-separated list or null for all; `visible` (owner_id, agent,
    pack); `packs` the scopes. Requests are counted first, so a busy owner is joined as one row per agent and pack
    or list of scopes, not request by request.
    """
    who = ["owner_id", "agent"]
    counts = [F.count(F.lit(1)).alias("calls"), F.max("ts").alias("last_called")]
    cols = [*who, "pack", "calls", "last_called"]
    scoped = visible.join(packs.select(*PACK, "scope"), PACK)
    within = F.when(F.col("tool") == "all", F.col("scope_arg")).alias("within")
    wide = (requests.where(F.col("tool").isin("card", "profile", "all")).groupBy(*who, within).agg(*counts).join(scoped, who)
            .where(F.col("within").isNull() | F.array_contains(F.split("within", ","), F.col("scope"))))
    narrow = (requests.where(F.col("tool") == "pack").withColumnRenamed("pack_arg", "pack").groupBy(*who, "pack")
              .agg(*counts).join(visible, [*who, "pack"], "left_semi"))
    none = F.lit(None).cast("string").alias("key")
    pack_rows = (wide.select(*cols).unionByName(narrow.select(*cols)).groupBy(*who, "pack")
                 .agg(F.sum("calls").alias("calls"), F.max("last_called").alias("last_called")))
    per_key = facts.groupBy(*FACT).agg(F.count(F.lit(1)).alias("n"))
    fact_rows = narrow.join(per_key, PACK).select(
        "owner_id", "pack", "key", "agent", (F.col("calls") * F.col("n")).alias("calls"), "last_called")
    return pack_rows.select("owner_id", "pack", none, "agent", "calls", "last_called").unionByName(fact_rows)
