"""Secret audit over facts, rules, descriptions and any text table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factbase.functions import secrets as S


def audit_findings(texts: DataFrame, text: str = "text", key: str | None = None,
                   patterns: list[S.Pattern] = S.PATTERNS) -> DataFrame:
    """One row per match; all other columns of `texts` are carried along."""
    keep = [c for c in texts.columns if c != text]
    hit = F.col("_m.hit")
    names = F.array(*[F.lit(p.name) for p in patterns])
    levels = F.array(*[F.lit(p.severity) for p in patterns])
    advice = F.array(*[F.lit(p.suggestion) for p in patterns])
    no = F.col("_m.pattern_no")
    found = (texts.select(*keep, F.explode(S.matches(F.col(text), patterns)).alias("_m"))
             .select(*keep, no.alias("pattern_no"), F.col("_m.match_no").alias("match_no"),
                     F.get(names, no).alias("pattern"), F.get(levels, no).alias("severity"),
                     S.preview(hit).alias("preview"), F.get(advice, no).alias("suggestion")))
    if key is None:
        return found
    return found.where(~((F.col("pattern") == S.UUID_PATTERN) & F.col(key).isin(S.UUID_SAFE_KEYS)))


def pack_texts(facts: DataFrame, rules: DataFrame, packs: DataFrame) -> DataFrame:
    """(owner_id, pack, key, text) of everything that is audited in a pack."""
    return (facts.select("owner_id", "pack", "key", F.array_join("value_items", " ").alias("text"))
            .unionByName(rules.select("owner_id", "pack",
                                      F.concat(F.lit("rule:"), F.col("pos").cast("string")).alias("key"),
                                      F.col("instruction").alias("text")))
            .unionByName(packs.where(F.col("description") != "")
                         .select("owner_id", "pack", F.lit("meta.description").alias("key"),
                                 F.col("description").alias("text"))))


def audit_packs(facts: DataFrame, rules: DataFrame, packs: DataFrame,
                patterns: list[S.Pattern] = S.PATTERNS) -> DataFrame:
    return audit_findings(pack_texts(facts, rules, packs), "text", "key", patterns)


def audit_summary(findings: DataFrame, by: list[str]) -> DataFrame:
    s = F.col("severity")
    return findings.groupBy(*by).agg(
        F.count_if(s == S.CRITICAL).alias("critical"), F.count_if(s == S.WARNING).alias("warning"),
        F.count_if(s == S.INFO).alias("info"), F.count(F.lit(1)).alias("total"),
        (F.count_if(s == S.CRITICAL) == 0).alias("is_clean"))


def _with_masks(facts: DataFrame, patterns: list[S.Pattern]) -> DataFrame:
    """`_steps`: the masks that some item of a fact may need, found once for all its items."""
    return facts.withColumn("_steps", S.masks(F.array_join("value_items", " "), patterns))


def redact_facts(facts: DataFrame, patterns: list[S.Pattern] = S.PATTERNS) -> DataFrame:
    """Mask critical secrets in fact values, list items one by one; values without any anchor
    are passed on untouched."""
    return (_with_masks(facts, patterns)
            .withColumn("value_items", F.when(F.size("_steps") > 0, F.transform(
                "value_items", lambda x: S.applied(x, F.col("_steps")))).otherwise(F.col("value_items")))
            .drop("_steps"))


def redaction_counts(facts: DataFrame, by: list[str], patterns: list[S.Pattern] = S.PATTERNS) -> DataFrame:
    """(fact, pattern) changes that redact_facts makes, per group."""
    return (_with_masks(facts, patterns).where(F.size("_steps") > 0)
            .withColumn("_n", S.redaction_steps(F.col("value_items"), F.col("_steps")))
            .groupBy(*by).agg(F.sum("_n").alias("changes"), F.count_if(F.col("_n") > 0).alias("facts_changed")))


def scrub_secrets(texts: DataFrame, text: str = "text", patterns: list[S.Pattern] = S.PATTERNS) -> DataFrame:
    return texts.withColumn(text, S.scrub(F.col(text), patterns))
