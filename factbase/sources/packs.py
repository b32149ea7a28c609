"""Reading and writing pack documents (JSON text, one document per pack part)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factbase.functions.values import as_ts
from factbase.operators.validate import child, listed, text_of, violations, with_variant
from factbase.session import cut_lineage

NAME_RULE = "^[a-z][a-z0-9_-]*$"
# Every pack is written as numbered documents of so many consecutive positions, so that no task ever assembles an
# unbounded pack.
PART_ROWS = 1000


def owner_of(place: Column) -> Column:
    """The owner that a folder owner_id=.. names; files elsewhere are of the owner `me`."""
    owner = F.regexp_extract(place, "/owner_id=([^/]+)/", 1)
    return F.when(owner != "", F.url_decode(owner)).otherwise("me")


def raw_packs_from_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(owner_id, file, doc): one JSON document per file, or with `lines` one per line; the owner by `owner_of`."""
    place = F.col("_metadata.file_path")
    files = spark.read.option("recursiveFileLookup", "true").schema("value string").text(path, wholetext=not lines)
    return files.select(owner_of(place).alias("owner_id"), F.element_at(F.split(place, "/"), -1).alias("file"), F.col("value").alias("doc"))


def _stamp(path: str) -> Column:
    return F.try_to_timestamp(F.try_variant_get("v", path, "string")).cast("timestamp_ntz")


def _judged(raw_packs: DataFrame) -> DataFrame:
    """raw_packs + v (parsed) + good; the model's stricter name rule and readable dates come on top of validation."""
    named = F.coalesce(F.try_variant_get("v", "$.name", "string").rlike(NAME_RULE), F.lit(False))
    dated = F.lit(True)
    for path in ("$.meta.created_at", "$.meta.updated_at"):
        dated = dated & (F.try_variant_get("v", path, "variant").isNull() | F.is_variant_null(F.try_variant_get("v", path, "variant"))
                         | _stamp(path).isNotNull())
    return with_variant(raw_packs).withColumn("good", (F.size(violations()) == 0) & named & dated)


def judge_packs(raw_packs: DataFrame) -> DataFrame:
    """raw_packs + good: one relation for both sides, parsed and validated once; bad ones are the quarantine."""
    return _judged(raw_packs).drop("v")


def split_valid_packs(raw_packs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine). Each side reads the documents; to read them once, persist judge_packs and filter it."""
    judged = judge_packs(raw_packs)
    return tuple(judged.where(cond).select(*raw_packs.columns) for cond in (F.col("good"), ~F.col("good")))


def read_packs(raw_packs: DataFrame, as_of, owner: str = "me") -> tuple[DataFrame, DataFrame, DataFrame]:
    """packs, facts, rules of the valid documents, with the model's defaults.

    A pack is one document, or the numbered parts that write_packs makes (meta.part). Of several documents for one
    part of a pack the first by file name counts, as a whole, so positions stay unique. Documents are parsed and judged
    once, when this is called, and kept parsed for the three results.
    """
    if "owner_id" not in raw_packs.columns:
        raw_packs = raw_packs.withColumn("owner_id", F.lit(owner))

    def get(path, kind="string"):
        return F.try_variant_get("v", path, kind)

    def stamp(path):
        return F.coalesce(_stamp(path), as_ts(as_of))

    file = F.col("file") if "file" in raw_packs.columns else F.lit("")
    docs = cut_lineage(_judged(raw_packs).where("good").select(
        "owner_id", get("$.name").alias("pack"), F.coalesce(get("$.meta.part", "bigint"), F.lit(0)).alias("part"),
        F.struct(file.alias("file"), F.xxhash64("doc").alias("print")).alias("origin"), "v"))
    first = docs.groupBy("owner_id", "pack", "part").agg(F.min("origin").alias("origin"))
    docs = docs.join(first, ["owner_id", "pack", "part", "origin"], "left_semi")
    packs = docs.select(
        "owner_id", "pack", "part", get("$.scope").alias("scope"),
        F.coalesce(get("$.meta.schema_version"), F.lit("0.1.0")).alias("schema_version"),
        stamp("$.meta.created_at").alias("created_at"), stamp("$.meta.updated_at").alias("updated_at"),
        get("$.meta.description").alias("description"),
        F.coalesce(get("$.meta.tags", "array<string>"), F.array().cast("array<string>")).alias("tags"))

    def elements(name):
        return docs.select("owner_id", "pack", F.posexplode(get(f"$.{name}", "array<variant>")).alias("i", "e"))

    def item(name):
        return text_of(child(F.col("e"), name))

    # later parts of a long pack carry the positions of their items
    pos = F.coalesce(F.try_variant_get(F.col("e"), "$.pos", "bigint"), F.col("i").cast("bigint")).alias("pos")
    value = child(F.col("e"), "value")
    items = F.try_variant_get(value, "$", "array<string>")
    facts = elements("facts").select(
        "owner_id", "pack", pos, item("key").alias("key"),
        F.coalesce(items, F.array(item("value"))).alias("value_items"), listed(value).isNotNull().alias("value_is_list"),
        F.coalesce(item("type"), F.lit("context")).alias("type"),
        F.coalesce(item("confidence"), F.lit("high")).alias("confidence"), item("source").alias("source"),
        F.try_to_timestamp(item("updated_at")).cast("timestamp_ntz").alias("updated_at"))
    rules = elements("rules").select(
        "owner_id", "pack", pos, item("instruction").alias("instruction"),
        F.coalesce(F.try_variant_get(F.col("e"), "$.priority", "int"), F.lit(0)).alias("priority"))
    lead = packs.groupBy("owner_id", "pack").agg(F.min("part").alias("part"))
    packs = packs.join(lead, ["owner_id", "pack", "part"], "left_semi").drop("part")
    return packs.dropDuplicates(["owner_id", "pack"]), facts, rules


def pack_documents(packs: DataFrame, facts: DataFrame, rules: DataFrame, as_of,
                   part_rows: int = PART_ROWS) -> DataFrame:
    """(owner_id, pack, part, doc): JSON documents with defaults left out.

    Facts and rules are grouped by (pack, block of positions): a block is bounded, and part 0
    always exists. Every part has the head with its number, and every item its position.
    """
    part = F.floor(F.col("pos") / part_rows).cast("bigint")
    keys = ["owner_id", "pack", "part"]

    def iso(c):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")

    def unless(c, default):
        return F.when(F.col(c) != default, F.col(c)).alias(c)

    def fact_json(value):
        return F.to_json(F.struct("key", value.alias("value"), unless("type", "context"),
                                  unless("confidence", "high"), unless("source", ""),
                                  iso("updated_at").alias("updated_at"), "pos"))

    def bundle(df, text, out):
        rows = F.array_sort(F.collect_list(F.struct("pos", text.alias("j"))))
        return (df.withColumn("part", part).groupBy(*keys).agg(rows.alias("_a"))
                .select(*keys, F.concat(F.lit(f',"{out}":['), F.array_join(F.transform("_a", lambda x: x["j"]), ","),
                                        F.lit("]")).alias(out)))

    fact_parts = bundle(facts, F.when(F.col("value_is_list"), fact_json(F.col("value_items")))
                        .otherwise(fact_json(F.get("value_items", F.lit(0)))), "facts")
    rule_parts = bundle(rules, F.to_json(F.struct(
        "instruction", F.when(F.col("priority") > 0, F.col("priority")).alias("priority"), "pos")), "rules")
    tags = F.col("tags") if "tags" in packs.columns else F.array().cast("array<string>")
    head = F.to_json(F.struct(F.col("pack").alias("name"), "scope", F.struct(
        "schema_version", iso("created_at").alias("created_at"), iso(as_ts(as_of)).alias("updated_at"),
        unless("description", ""), F.when(F.size(tags) > 0, tags).alias("tags"), "part").alias("meta")))
    parts = (fact_parts.select(*keys).unionByName(rule_parts.select(*keys))
             .unionByName(packs.select("owner_id", "pack", F.lit(0).cast("bigint").alias("part"))).distinct())
    whole = (parts.join(packs, ["owner_id", "pack"]).withColumn("head", head).join(fact_parts, keys, "left")
             .join(rule_parts, keys, "left"))
    open_head = F.substring(F.col("head"), F.lit(1), F.length("head") - 1)
    return whole.select(*keys, F.concat(open_head, F.coalesce("facts", F.lit("")),
                                        F.coalesce("rules", F.lit("")), F.lit("}")).alias("doc"))


def write_packs(packs: DataFrame, facts: DataFrame, rules: DataFrame, path: str, as_of) -> None:
    """One JSON document per line, partitioned by owner; raw_packs_from_json(.., lines=True) reads them."""
    (pack_documents(packs, facts, rules, as_of).select("owner_id", F.col("doc").alias("value"))
     .write.mode("overwrite").partitionBy("owner_id").text(path))
