"""Model-based extraction: batches for a model, its answers, and merged results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions.values import bucketed_rank, strip
from factbase.operators.validate import whole_json

BATCH = 50  # fixed value
PROMPT = ("Here are {count} messages a user wrote to assistants.\nScope of interest: {scope}\n\n"
          "{messages}\n\nReturn the facts and rules they state as strict JSON.")
SOURCE = "llm-extraction"
RANK = {"high": 3, "medium": 2, "low": 1}  # fixed values; a missing confidence counts as low


def extraction_batches(messages: DataFrame, size: int = BATCH, max_batches: int | None = None,
                       scope: str = "general", template: str = PROMPT, line_chars: int | None = None) -> DataFrame:
    """(owner_id, batch_no, n, prompt): an owner's longest messages first, in numbered lines.

    All messages, whole, unless `max_batches` or `line_chars` say how much a model may be given. A batch has `size`
    lines; messages are numbered inside their length, so an owner with most of them is not sorted in one task.
    """
    top = bucketed_rank(messages, ["owner_id"], {"_len": -F.length("text"), "_blk": F.col("conv_id")}, [F.col("pos")], "_no")
    if max_batches is not None:
        top = top.where(F.col("_no") <= size * max_batches)
    text = F.col("text") if line_chars is None else F.substring("text", 1, line_chars)
    lines = top.select("owner_id", F.floor((F.col("_no") - 1) / size).cast("bigint").alias("batch_no"), "_no",
                       F.concat(F.lit("["), ((F.col("_no") - 1) % size + 1).cast("string"), F.lit("]: "),
                                text).alias("line"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "line"))),
                                      lambda x: x["line"]), "\n---\n")
    batches = lines.groupBy("owner_id", "batch_no").agg(F.count(F.lit(1)).alias("n"), joined.alias("_m"))
    head, rest = template.replace("{scope}", scope).split("{count}")
    mid, tail = rest.split("{messages}")
    return batches.select("owner_id", "batch_no", "n", F.concat(
        F.lit(head), F.col("n").cast("string"), F.lit(mid), "_m", F.lit(tail)).alias("prompt"))


def extract_with_model(batches: DataFrame, model_fn: Callable[[str], str]) -> DataFrame:
    """(owner_id, batch_no, raw): the callable's answer per prompt; a failing batch is left out."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for owner, no, prompt in zip(pdf["owner_id"], pdf["batch_no"], pdf["prompt"]):
                try:
                    rows.append((owner, no, model_fn(prompt)))
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=["owner_id", "batch_no", "raw"])

    return batches.select("owner_id", "batch_no", "prompt").mapInPandas(
        run, "owner_id string, batch_no bigint, raw string")


def parse_extractions(raw: DataFrame) -> DataFrame:
    """raw + v: the JSON object in an answer, fences removed; else what lies between the outer braces."""
    clean = strip(F.regexp_replace(F.regexp_replace(strip("raw"), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    # one-element explodes are barriers: without them the filter and every use of v parse the answer again
    once = lambda c: F.explode(F.array(c))
    out = raw.withColumn("_c", once(clean)).withColumn("_v", once(whole_json(F.col("_c"))))
    out = out.withColumn("_i", once(F.when(F.col("_v").isNull(), F.regexp_extract("_c", r"\{[\s\S]*\}", 0))))
    inner = F.when(F.col("_v").isNull() & (F.col("_i") != ""), whole_json(F.col("_i")))
    out = out.withColumn("v", once(F.coalesce("_v", inner))).drop("_c", "_v", "_i")
    return out.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def extracted_facts(parsed: DataFrame) -> DataFrame:
    """(owner_id, batch_no, i, key, value_items, value_is_list, type, confidence)."""
    e = parsed.select("owner_id", "batch_no", F.posexplode(
        F.try_variant_get("v", "$.facts", "array<variant>")).alias("i", "e"))
    get = lambda p, t="string": F.try_variant_get("e", f"$.{p}", t)
    listed = get("value", "array<string>")
    return e.select("owner_id", "batch_no", "i", get("key").alias("key"),
                    F.coalesce(listed, F.array(get("value"))).alias("value_items"), listed.isNotNull().alias("value_is_list"),
                    get("type").alias("type"), get("confidence").alias("confidence"))


def extracted_rules(parsed: DataFrame) -> DataFrame:
    e = parsed.select("owner_id", "batch_no", F.posexplode(
        F.try_variant_get("v", "$.rules", "array<variant>")).alias("i", "e"))
    get = lambda p, t="string": F.try_variant_get("e", f"$.{p}", t)
    return e.select("owner_id", "batch_no", "i", get("instruction").alias("instruction"), get("priority", "int").alias("priority"))


def _winners(x: DataFrame) -> DataFrame:
    """Per key: the first row of the highest confidence, and where the key was first seen."""
    rank = F.lit(0)
    for name, r in RANK.items():
        rank = F.when(F.coalesce("confidence", F.lit("low")) == name, r).otherwise(rank)
    return (x.where(F.coalesce("key", F.lit("")) != "").groupBy("owner_id", "key").agg(
        F.min_by(F.struct("pos", "value_is_list"), F.struct((-rank).alias("r"), "pos")).alias("w"),
        F.min("pos").alias("first_pos")))


def merge_extracted_facts(x: DataFrame) -> DataFrame:
    """x(owner_id, pos, key, value_items, value_is_list, ...) to winners (owner_id, key, pos, first_pos, ...)."""
    w = _winners(x).select("owner_id", "key", F.col("w.pos").alias("pos"), "first_pos")
    return x.join(w, ["owner_id", "key", "pos"])


def merged_items(x: DataFrame) -> DataFrame:
    """The values behind the winners, one row per item: (owner_id, key, from_pos, item_no, item).

    A list winner keeps its own items and gains unseen items of later list rows, each once. Items
    stay rows, so a key mentioned everywhere never becomes one cell.
    """
    keys = ["owner_id", "key"]
    w = _winners(x).select(*keys, F.col("w.pos").alias("w_pos"), F.col("w.value_is_list").alias("w_list"))
    near = x.join(w, keys).where((F.col("pos") == F.col("w_pos")) | (
        (F.col("pos") > F.col("w_pos")) & F.col("w_list") & F.col("value_is_list")))
    items = near.select(*keys, "pos", "w_pos", F.posexplode("value_items").alias("item_no", "item"))
    place = F.struct("pos", "item_no")
    first = items.groupBy(*keys, "item").agg(
        F.min(place).alias("at"), F.bool_or(F.col("pos") == F.col("w_pos")).alias("own"))
    own = items.where(F.col("pos") == F.col("w_pos")).select(*keys, F.col("pos").alias("from_pos"), "item_no", "item")
    gained = first.where(~F.col("own")).select(*keys, F.col("at.pos").alias("from_pos"), F.col("at.item_no").alias("item_no"), "item")
    return own.unionByName(gained)


def merge_extracted_rules(x: DataFrame) -> DataFrame:
    """First rule of every normalised wording."""
    norm = F.regexp_replace(F.lower(strip("instruction")), r"[^a-z0-9\s]", "")
    first = F.min_by(F.struct("pos", "instruction", "priority"), "pos")
    return (x.withColumn("norm", norm).groupBy("owner_id", "norm").agg(first.alias("r"))
            .select("owner_id", "r.pos", "r.instruction", "r.priority"))


def extraction_stats(messages: DataFrame, facts: DataFrame, rules: DataFrame, size: int = BATCH,
                     max_batches: int | None = None) -> DataFrame:
    """Per owner: total, processed, batches, facts, rules."""
    count = lambda df, out: df.groupBy("owner_id").agg(F.count(F.lit(1)).alias(out))
    n = F.col("total")
    done = n if max_batches is None else F.least(n, F.lit(size * max_batches))
    return (count(messages, "total").join(count(facts, "facts"), "owner_id", "left")
            .join(count(rules, "rules"), "owner_id", "left")
            .select("owner_id", "total", done.cast("bigint").alias("processed"), F.ceil(done / size).cast("bigint").alias("batches"),
                    F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("rules", F.lit(0)).alias("rules")))


def assemble_extracted_packs(stats: DataFrame, summaries: DataFrame, name: str = "extracted",
                             scope: str = "general") -> DataFrame:
    """Pack rows; the description ends in the owner's first summary. summaries(owner_id, batch_no, summary)."""
    first = (summaries.where(F.col("summary") != "").groupBy("owner_id")
             .agg(F.min_by("summary", "batch_no").alias("summary")))
    text = F.concat(F.lit("Extracted from "), F.col("total").cast("string"), F.lit(" messages ("),
                    F.col("facts").cast("string"), F.lit(" facts, "), F.col("rules").cast("string"), F.lit(" rules)"))
    return stats.join(first, "owner_id", "left").select(
        "owner_id", F.lit(name).alias("pack"), F.lit(scope).alias("scope"),
        F.concat_ws("\n", text, "summary").alias("description"),
        F.array(F.lit("extracted"), F.lit("llm"), F.lit(scope)).alias("tags"))


DEFAULT_PRIORITY = 5  # fixed value


def extracted_pack_rules(rules: DataFrame, name: str = "extracted") -> DataFrame:
    """Merged rules as rules of the extracted pack, with the default priority where the model gave none."""
    return merge_extracted_rules(rules).select("owner_id", F.lit(name).alias("pack"), "pos", "instruction",
                                               F.coalesce("priority", F.lit(DEFAULT_PRIORITY)).alias("priority"))


def extracted_pack_facts(facts: DataFrame, name: str = "extracted") -> DataFrame:
    """Merged facts as facts of the extracted pack, without values: merged_items has these by key, as rows."""
    return extracted_defaults(merge_extracted_facts(facts)).select(
        "owner_id", F.lit(name).alias("pack"), F.col("first_pos").alias("pos"), "key", "value_is_list", "type", "confidence", "source")


def extracted_defaults(facts: DataFrame) -> DataFrame:
    """Facts as stored: type context, confidence medium, fixed source."""
    return facts.withColumns({"type": F.coalesce("type", F.lit("context")),
                              "confidence": F.coalesce("confidence", F.lit("medium")), "source": F.lit(SOURCE)})
