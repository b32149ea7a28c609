"""Packs from templates and from form answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factbase.functions.templates import TEMPLATES, TONES
from factbase.functions.values import strip

PACK = ["owner_id", "pack"]


def template_tables(spark: SparkSession, templates: dict = TEMPLATES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue as three tables. Its size is fixed by the code, so joins may broadcast it."""
    heads = [(t, scope, text) for t, (scope, text, _, _) in templates.items()]
    facts = [(t, i, k, [v] if isinstance(v, str) else v, not isinstance(v, str), kind)
             for t, (_, _, fs, _) in templates.items() for i, (k, kind, v) in enumerate(fs)]
    rules = [(t, i, text, p) for t, (_, _, _, rs) in templates.items() for i, (p, text) in enumerate(rs)]
    return (spark.createDataFrame(heads, "template string, t_scope string, t_text string"),
            spark.createDataFrame(facts, "template string, pos bigint, key string, value_items array<string>, "
                                         "value_is_list boolean, type string"),
            spark.createDataFrame(rules, "template string, pos bigint, instruction string, priority int"))


def instantiate_templates(requests: DataFrame, existing: DataFrame, templates: dict = TEMPLATES) -> dict[str, DataFrame]:
    """requests(owner_id, seq, template, pack_name, scope) to packs, facts, rules and rejected.

    A name that exists, or that an earlier request of the batch takes, is rejected; so is an
    unknown template. Without a template the pack is empty.
    """
    spark = requests.sparkSession
    heads, facts, rules = template_tables(spark, templates)
    named = requests.withColumn("pack", F.coalesce("pack_name", "template"))
    known = (named.join(F.broadcast(heads), "template", "left")
             .join(existing.select(*PACK).distinct().withColumn("_old", F.lit(True)), PACK, "left")
             .withColumn("reason", F.when(F.col("_old"), "exists").when(
                 F.col("template").isNotNull() & F.col("t_scope").isNull(), "unknown template")))
    taken = known.where(F.col("reason").isNull()).groupBy(*PACK).agg(F.min("seq").alias("_first"))
    known = known.join(taken, PACK, "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("seq") > F.col("_first"), "exists")))
    made = known.where(F.col("reason").isNull())
    plain = F.col("template").isNull()
    none = F.array().cast("array<string>")
    packs = made.select(
        *PACK, F.when(plain, F.coalesce("scope", F.lit("general"))).otherwise(F.col("t_scope")).alias("scope"),
        F.when(plain, F.concat(F.lit("Context pack: "), "pack")).otherwise(F.col("t_text")).alias("description"),
        F.when(plain, none).otherwise(F.array("template", F.lit("template"))).alias("tags"))
    used = made.select(*PACK, "template")
    return {
        "packs": packs,
        "facts": used.join(F.broadcast(facts), "template").select(
            *PACK, "pos", "key", "value_items", "value_is_list", "type", F.lit("high").alias("confidence"),
            F.lit("template").alias("source")),
        "rules": used.join(F.broadcast(rules), "template").select(*PACK, "pos", "instruction", "priority"),
        "rejected": known.where(F.col("reason").isNotNull()).select("owner_id", "seq", "template", "pack", "reason")}


# Question -> (order, pack, fact key, fact type).
QUESTIONS = {"role": (0, "work", "role", "identity"), "tone": (1, "writer", "tone", "style"),
             "priorities": (2, "work", "current_focus", "context"), "rules": (3, "writer", None, None),
             "languages": (4, "writer", "languages", "skill")}
PACKS = {"writer": ("writing", "Writing style and communication preferences"),
         "work": ("work", "Professional context and current priorities")}
RULE_PRIORITY, PRESET_SLOTS = 7, 10


def answers_to_packs(answers: DataFrame) -> dict[str, DataFrame]:
    """answers(owner_id, seq, kind, value); the first answer to a question counts.

    Blank answers and "skip" are dropped. A tone number stands for a preset with rules; rules are
    split at commas.
    """
    spark = answers.sparkSession
    given = answers.groupBy("owner_id", "kind").agg(F.min_by("value", "seq").alias("value")).withColumn("value", strip("value"))
    given = given.where((F.col("value") != "") & (F.lower("value") != "skip"))
    dims = spark.createDataFrame([(k, *v) for k, v in QUESTIONS.items() if v[2]],
                                 "kind string, pos bigint, pack string, key string, type string")
    presets = spark.createDataFrame([(n, tone) for n, (tone, _) in TONES.items()], "value string, _tone string")
    preset_rules = spark.createDataFrame(
        [(n, i, text, p) for n, (_, rules) in TONES.items() for i, (p, text) in enumerate(rules)],
        "value string, pos bigint, instruction string, priority int")
    preset = F.when(F.col("kind") == "tone", F.col("_tone"))
    facts = (given.join(F.broadcast(dims), "kind").join(F.broadcast(presets), "value", "left")
             .select(*PACK, "pos", "key", F.array(F.coalesce(preset, F.col("value"))).alias("value_items"),
                     F.lit(False).alias("value_is_list"), "type", F.lit("high").alias("confidence"),
                     F.lit("onboard").alias("source")))
    from_tone = given.where(F.col("kind") == "tone").join(F.broadcast(preset_rules), "value").select(
        "owner_id", "pos", "instruction", "priority")
    split = F.filter(F.transform(F.split("value", ","), strip), lambda x: x != "")
    typed = given.where(F.col("kind") == "rules").select("owner_id", F.posexplode(split).alias("i", "instruction")).select(
        "owner_id", (F.col("i") + PRESET_SLOTS).cast("bigint").alias("pos"), "instruction",
        F.lit(RULE_PRIORITY).alias("priority"))
    rules = from_tone.unionByName(typed).select("owner_id", F.lit("writer").alias("pack"), "pos", "instruction", "priority")
    heads = spark.createDataFrame([(n, s, d) for n, (s, d) in PACKS.items()], "pack string, scope string, description string")
    packs = (facts.select(*PACK).unionByName(rules.select(*PACK)).distinct().join(F.broadcast(heads), "pack")
             .select(*PACK, "scope", "description", F.array(F.lit("onboard"), F.lit("personal")).alias("tags")))
    return {"packs": packs, "facts": facts, "rules": rules}
