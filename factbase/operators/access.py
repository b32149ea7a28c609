"""Agent identification and per-agent pack visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import strip

# Name parts of known agents, tried in this order.
ALIASES = {"claude": "claude", "cursor": "cursor", "chatgpt": "chatgpt", "openai": "chatgpt",
           "gemini": "gemini", "copilot": "copilot", "windsurf": "windsurf", "codex": "codex"}
DEFAULT = "default"
WHO = ["owner_id", "agent"]


def _canonical(candidate: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, name in reversed(ALIASES.items()):
        out = F.when(F.contains(candidate, F.lit(part)), name).otherwise(out)
    return out


def resolve_agents(requests: DataFrame) -> DataFrame:
    """requests + agent, from the stated agent id, then from the product part of the user agent."""
    stated = F.when(F.col("agent_id") != "", F.lower(strip("agent_id")))
    product = F.split_part(F.split_part(F.lower("user_agent"), F.lit("/"), F.lit(1)), F.lit(" "), F.lit(1))
    product = F.when(F.col("user_agent") != "", strip(product))
    return (requests.withColumns({"_a": stated, "_b": product})
            .withColumn("agent", F.coalesce(_canonical(F.col("_a")), _canonical(F.col("_b")), "_a", "_b", F.lit("unknown")))
            .drop("_a", "_b"))


def allowed_packs(agents: DataFrame, permissions: DataFrame) -> DataFrame:
    """Per (owner, agent): allow_all and the allowed pack names.

    An agent's own rule counts unless it is an empty list; then the default rule; then all.
    """
    own = permissions.where(F.col("allow_all") | (F.size("packs") > 0)).select(
        *WHO, F.struct("allow_all", "packs").alias("_own"))
    default = permissions.where(F.col("agent") == DEFAULT).select(
        "owner_id", F.struct("allow_all", "packs").alias("_default"))
    rule = F.coalesce("_own", "_default", F.struct(
        F.lit(True).alias("allow_all"), F.array().cast("array<string>").alias("packs")))
    return (agents.select(*WHO).distinct().join(own, WHO, "left").join(default, "owner_id", "left")
            .select(*WHO, rule.alias("_r")).select(*WHO, "_r.allow_all", "_r.packs"))


def visible_packs(agents: DataFrame, packs: DataFrame, permissions: DataFrame,
                  allow_list: list[str] | None = None) -> DataFrame:
    """(owner, agent, pack) for every distinct agent of an owner; list rules join pack by pack."""
    shown = packs if allow_list is None else packs.where(F.col("pack").isin(list(allow_list)))
    shown = shown.select("owner_id", "pack")
    rules = allowed_packs(agents, permissions)
    listed = (rules.where(~F.col("allow_all")).select(*WHO, F.explode(F.array_distinct("packs")).alias("pack"))
              .join(shown, ["owner_id", "pack"]))
    every = rules.where("allow_all").select(*WHO).join(shown, "owner_id")
    return listed.select(*WHO, "pack").unionByName(every.select(*WHO, "pack"))


def apply_permission_changes(permissions: DataFrame, changes: DataFrame) -> DataFrame:
    """changes(owner_id, seq, action, agent, packs), action in set / set_all / reset.

    A reset drops all that came before it. The first set on an owner without configuration also
    stores default = all.
    """
    resets = (changes.where(F.col("action") == "reset").groupBy("owner_id")
              .agg(F.max("seq").alias("_reset")))
    live = (changes.where(F.col("action") != "reset").join(resets, "owner_id", "left")
            .where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))))
    set_rows = live.groupBy(*WHO).agg(F.max_by(F.struct(
        (F.col("action") == "set_all").alias("allow_all"),
        F.when(F.col("action") == "set", F.col("packs")).otherwise(F.array().cast("array<string>")).alias("packs")),
        "seq").alias("_c")).select(*WHO, "_c.allow_all", "_c.packs")
    base = permissions.join(resets, "owner_id", "left_anti")
    kept = base.join(set_rows, WHO, "left_anti").select(*WHO, "allow_all", "packs")
    fresh = (set_rows.select("owner_id").distinct().join(base, "owner_id", "left_anti")
             .join(set_rows.where(F.col("agent") == DEFAULT), "owner_id", "left_anti")
             .select("owner_id", F.lit(DEFAULT).alias("agent"), F.lit(True).alias("allow_all"),
                     F.array().cast("array<string>").alias("packs")))
    return kept.unionByName(set_rows).unionByName(fresh)


def list_permissions(permissions: DataFrame) -> DataFrame:
    return permissions.select(*WHO, F.when(F.col("allow_all"), "all").otherwise(
        F.array_join("packs", ", ")).alias("rule"))
