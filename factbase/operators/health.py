"""Health checks: each returns (owner_id, severity, pack, code, detail, number)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import age_days, as_ts
from factbase.operators import audit
from factbase.operators.search import list_packs

# Recommended sizes, staleness, score penalties.
MAX_FACTS, MAX_RULES, STALE_DAYS = 40, 15, 90
WARNING_COST, INFO_COST = 10, 3
MISSING_PACK = "(missing)"
NO_PACK = "(none)"


def _issue(df: DataFrame, severity, code, pack="pack", detail=None, number=None) -> DataFrame:
    none = F.lit(None)
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return df.select(
        "owner_id", sev.alias("severity"), (F.col(pack) if isinstance(pack, str) else pack).alias("pack"),
        (code if isinstance(code, Column) else F.lit(code)).alias("code"),
        (none if detail is None else detail).cast("string").alias("detail"),
        (none if number is None else number).cast("bigint").alias("number"))


def check_pack_sizes(sizes: DataFrame) -> DataFrame:
    big = _issue(sizes.where(F.col("n_facts") > MAX_FACTS), "warning", "too_many_facts", number=F.col("n_facts"))
    wordy = _issue(sizes.where(F.col("n_rules") > MAX_RULES), "info", "too_many_rules", number=F.col("n_rules"))
    return big.unionByName(wordy)


def check_empty_packs(sizes: DataFrame) -> DataFrame:
    return _issue(sizes.where((F.col("n_facts") == 0) & (F.col("n_rules") == 0)), "warning", "empty_pack")


def check_no_rules(sizes: DataFrame) -> DataFrame:
    return _issue(sizes.where((F.col("n_facts") > 0) & (F.col("n_rules") == 0)), "info", "no_rules")


def _raw_value_id() -> Column:
    val = F.array_join(F.when(F.col("value_is_list"), F.array_sort("value_items"))
                       .otherwise(F.col("value_items")), ", ")
    return F.md5(F.concat(F.col("key"), F.lit("="), val))


def duplicate_groups(facts: DataFrame) -> DataFrame:
    """Same key and same value (case counts) in several places, one pack twice included."""
    return (facts.withColumn("value_id", _raw_value_id()).groupBy("owner_id", "value_id")
            .agg(F.min("key").alias("key"), F.min("pack").alias("pack"), F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def duplicate_locations(facts: DataFrame) -> DataFrame:
    """The places behind each duplicate issue, one row each."""
    return (facts.withColumn("value_id", _raw_value_id())
            .join(duplicate_groups(facts).select("owner_id", "value_id"), ["owner_id", "value_id"], "left_semi")
            .select("owner_id", "value_id", "key", "pack", "pos"))


def check_duplicate_facts(facts: DataFrame) -> DataFrame:
    return _issue(duplicate_groups(facts), "info", "duplicate_fact", detail=F.col("key"), number=F.col("n"))


def check_missing_development(packs: DataFrame) -> DataFrame:
    has = packs.groupBy("owner_id").agg(F.bool_or(F.col("scope") == "development").alias("has"))
    return _issue(has.where(~F.col("has")), "info", "no_development_pack", pack=F.lit(MISSING_PACK))


def check_missing_description(packs: DataFrame) -> DataFrame:
    return _issue(packs.where(F.coalesce("description", F.lit("")) == ""), "info", "no_description")


def check_stale_packs(packs: DataFrame, as_of) -> DataFrame:
    old = packs.where(F.col("updated_at") < as_ts(as_of) - F.make_dt_interval(F.lit(STALE_DAYS)))
    return _issue(old, "info", "stale_pack", number=age_days(as_of, "updated_at"))


def check_secrets(findings: DataFrame) -> DataFrame:
    """Critical findings warn, warnings inform, the rest is silent."""
    loud = findings.where(F.col("severity").isin("critical", "warning"))
    level = F.when(F.col("severity") == "critical", "warning").otherwise("info")
    return _issue(loud, level, "secret", detail=F.concat_ws(" in ", "pattern", "key"))


def _several(df: DataFrame, checks: list[tuple]) -> DataFrame:
    """One pass for checks (condition, severity, code, detail, number) on rows of packs."""
    none = F.lit(None)
    issues = [F.when(cond, F.struct(F.lit(severity).alias("severity"), F.col("pack").alias("pack"), F.lit(code).alias("code"),
                                    (none if detail is None else detail).cast("string").alias("detail"),
                                    (none if number is None else number).cast("bigint").alias("number")))
              for cond, severity, code, detail, number in checks]
    return df.select("owner_id", F.inline(F.filter(F.array(*issues), lambda x: x.isNotNull())))


def diagnose(facts: DataFrame, rules: DataFrame, packs: DataFrame, as_of,
             owners: DataFrame | None = None) -> DataFrame:
    """All checks. Owners listed in `owners` that have no pack get a single warning."""
    n_facts, n_rules = F.col("n_facts"), F.col("n_rules")
    sizes = _several(list_packs(packs, facts, rules), [
        (n_facts > MAX_FACTS, "warning", "too_many_facts", None, n_facts), (n_rules > MAX_RULES, "info", "too_many_rules", None, n_rules),
        ((n_facts == 0) & (n_rules == 0), "warning", "empty_pack", None, None),
        ((n_facts > 0) & (n_rules == 0), "info", "no_rules", None, None)])
    heads = _several(packs, [
        (F.coalesce("description", F.lit("")) == "", "info", "no_description", None, None),
        (F.col("updated_at") < as_ts(as_of) - F.make_dt_interval(F.lit(STALE_DAYS)), "info", "stale_pack", None, age_days(as_of, "updated_at"))])
    checks = [sizes, heads, check_duplicate_facts(facts), check_missing_development(packs),
              check_secrets(audit.audit_packs(facts, rules, packs))]
    if owners is not None:
        bare = owners.select("owner_id").distinct().join(packs.select("owner_id"), "owner_id", "left_anti")
        checks.append(_issue(bare, "warning", "no_packs", pack=F.lit(NO_PACK)))
    return reduce(DataFrame.unionByName, checks)


def health_score(issues: DataFrame, owners: DataFrame) -> DataFrame:
    """Score per owner from counted issues; an owner without packs scores 0."""
    per = issues.groupBy("owner_id").agg(
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if(F.col("severity") == "info").alias("infos"),
        F.bool_or(F.col("code") == "no_packs").alias("bare"))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ["warnings", "infos"]}
    score = F.greatest(F.lit(0), 100 - WARNING_COST * F.col("warnings") - INFO_COST * F.col("infos"))
    s = F.col("score")
    return (owners.select("owner_id").distinct().join(per, "owner_id", "left").withColumns(zero)
            .withColumn("score", F.when(F.coalesce("bare", F.lit(False)), 0).otherwise(score).cast("bigint")).drop("bare")
            .withColumn("is_healthy", s >= 80)
            .withColumn("band", F.when(s >= 90, "excellent").when(s >= 70, "good")
                        .when(s >= 50, "needs attention").otherwise("needs work")))
