"""Chat exports to messages(owner_id, file, conv_no, pos, text).

`exports` holds (owner_id, file, doc); doc is the JSON text of one export file.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.functions.values import strip
from factbase.operators.validate import kind, whole_json

CONVERSATION = ("struct<mapping: map<string, struct<message: struct<"
                "author: struct<role: string>, content: struct<parts: array<variant>>>>>>")
TREE = f"array<{CONVERSATION}>"
MIN_CHARS = 5
OUT = ["owner_id", "file", "conv_no", "pos", "text"]
# Position inside a conversation: node or message number, then part number.
PART_BITS = 20


def _place(outer: str, inner: str) -> Column:
    return (F.shiftleft(F.col(outer).cast("bigint"), PART_BITS) + F.coalesce(inner, F.lit(0))).alias("pos")


def _string(v: Column) -> Column:
    """The text of a variant that is a string, else NULL."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def read_chat_tree(exports: DataFrame, max_conversations: int | None = None) -> DataFrame:
    """Conversations as trees of nodes: every user node, every text part longer than 5 characters.

    A typed from_json keeps the nodes in file order (a variant object would sort them).
    """
    convs = exports.where(whole_json(F.col("doc")).isNotNull()).select(
        "owner_id", "file", F.posexplode(F.from_json("doc", TREE)).alias("conv_no", "c"))
    if max_conversations:
        convs = convs.where(F.col("conv_no") < max_conversations)
    return tree_messages(convs)


def tree_messages(convs: DataFrame) -> DataFrame:
    """convs(owner_id, file, conv_no, c): c is a parsed CONVERSATION."""
    nodes = convs.select("owner_id", "file", "conv_no",
                         F.posexplode(F.map_values("c.mapping")).alias("n", "node")).where(
        F.col("node.message.author.role") == "user")
    parts = nodes.select("owner_id", "file", "conv_no", "n", F.posexplode("node.message.content.parts").alias("p", "part"))
    return (parts.select("owner_id", "file", "conv_no", _place("n", "p"), strip(_string(F.col("part"))).alias("text"))
            .where(F.length("text") > MIN_CHARS))


def unreadable_exports(exports: DataFrame, layout: str) -> DataFrame:
    """(owner_id, file, error) of the export files that the readers give no messages for: not one JSON value, or one
    of another shape than the layout (`tree`: a list of objects; `flat`: a list or an object)."""
    v = exports.select("owner_id", "file", F.explode(F.array(whole_json(F.col("doc")))).alias("v"))
    shape = kind(F.col("v")) == "list" if layout == "tree" else kind(F.col("v")).isin("list", "dict")
    error = F.when(F.col("v").isNull(), "unreadable").when(~shape, F.concat(F.lit("unexpected "), kind(F.col("v"))))
    return v.select("owner_id", "file", error.alias("error")).where(F.col("error").isNotNull())


def conversations_of(exports: DataFrame) -> DataFrame:
    """(owner_id, file, conv_no, conv): elements of a top-level list, or the single object."""
    v = exports.select("owner_id", "file", whole_json(F.col("doc")).alias("v"))
    listed = F.try_variant_get("v", "$", "array<variant>")
    single = F.when(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.array("v"))
    return v.select("owner_id", "file", F.posexplode(F.coalesce(listed, single)).alias("conv_no", "conv"))


def read_chat_flat(exports: DataFrame, max_conversations: int | None = None) -> DataFrame:
    """Flat conversations in three layouts, tried in this order: chat_messages, messages, role + content."""
    convs = conversations_of(exports)
    if max_conversations:
        convs = convs.where(F.col("conv_no") < max_conversations)
    return flat_messages(convs)


def flat_messages(convs: DataFrame) -> DataFrame:
    """convs(owner_id, file, conv_no, conv): conv is the variant of one conversation."""
    get = lambda c, p, t="variant": F.try_variant_get(F.col(c), f"$.{p}", t)
    convs = convs.withColumns({"first": get("conv", "chat_messages"), "second": get("conv", "messages"),
                               "third": get("conv", "content"), "who": _string(get("conv", "role"))})
    keys = ["owner_id", "file", "conv_no"]

    def messages(col: str, cond: Column) -> DataFrame:
        return convs.where(cond).select(*keys, F.posexplode(
            F.try_variant_get(col, "$", "array<variant>")).alias("n", "m"))

    def texts(df: DataFrame, body: Column) -> DataFrame:
        """A body is a text, or a list whose text-typed parts count."""
        df = df.withColumn("body", body)
        plain = df.select(*keys, _place("n", F.lit(0)), _string(F.col("body")).alias("text"))
        parts = (df.select(*keys, "n", F.posexplode(F.try_variant_get("body", "$", "array<variant>")).alias("p", "part"))
                 .where(_string(get("part", "type")) == "text")
                 .select(*keys, _place("n", "p"), _string(get("part", "text")).alias("text")))
        return plain.unionByName(parts).where(F.col("text").isNotNull())

    one = messages("first", F.col("first").isNotNull()).withColumns(
        {"said": _string(get("m", "text")), "human": _string(get("m", "sender")) == "human"})
    spoken = F.coalesce(F.col("human"), F.lit(False)) & F.coalesce(F.col("said") != "", F.lit(False))
    role_one = F.coalesce(_string(get("m", "role")) == "user", F.lit(False))
    form1 = texts(one.where(spoken | role_one),
                  F.when(spoken, get("m", "text")).otherwise(get("m", "content")))
    form1 = form1.where(F.col("text") != "")
    two = messages("second", F.col("first").isNull() & F.col("second").isNotNull())
    speaker = _string(F.coalesce(get("m", "role"), get("m", "sender")))
    form2 = texts(two.where(speaker.isin("user", "human")), F.coalesce(get("m", "content"), get("m", "text")))
    third = (F.col("first").isNull() & F.col("second").isNull() & F.col("who").isin("user", "human"))
    form3 = convs.where(third).select(*keys, F.lit(0).cast("bigint").alias("pos"), _string(F.col("third")).alias("text"))
    return form1.unionByName(form2).unionByName(form3.where(F.col("text").isNotNull()))


def _pick(names: list[str], layout: str) -> list[str]:
    if layout == "tree":
        return [n for n in names if n.endswith("conversations.json")][:1]
    named = [n for n in names if n.endswith(".json")]
    return [n for n in named if "conversation" in n.lower()] or named


def unpack_archives(archives: DataFrame, layout: str) -> DataFrame:
    """(path, content) of zip files to (file, doc, error): one row per archive, all in parallel.

    Tree exports use the first entry named conversations.json, flat exports each conversation file: one row per
    entry, named archive!entry, so an unreadable entry costs only itself.
    """
    def entries(path: str, content: bytes) -> list[tuple]:
        rows = []
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                names = _pick(zf.namelist(), layout)
                if not names:
                    raise ValueError("no conversation file")
                for name in names:
                    place = path if layout == "tree" else f"{path}!{name}"
                    try:
                        rows.append((place, zf.read(name).decode("utf-8"), None))
                    except Exception as exc:
                        rows.append((place, None, f"{type(exc).__name__}: {exc}"))
        except Exception as exc:  # a bad archive is a row, not a failed job
            rows.append((path, None, f"{type(exc).__name__}: {exc}"))
        return rows

    # not by Arrow: its batches hold 10,000 rows, whatever an archive weighs; these hold 100
    opened = F.udf(entries, "array<struct<file:string,doc:string,error:string>>", useArrow=False)
    return archives.select(F.explode(opened("path", "content")).alias("r")).select("r.*")


def read_export_archives(spark, path: str, layout: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    return unpack_archives(files.load(path), layout)


def limit_conversations(messages: DataFrame, n: int, conv: str = "conv_id") -> DataFrame:
    """Messages of the first n conversations of each owner, by first position."""
    firsts = messages.groupBy("owner_id", conv).agg(F.min("pos").alias("_p"))
    w = Window.partitionBy("owner_id").orderBy("_p", conv)
    kept = firsts.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return messages.join(kept.select("owner_id", conv), ["owner_id", conv], "left_semi")


def import_stats(conversations: DataFrame, messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations and user messages per owner; owners without messages are kept."""
    c = conversations.groupBy("owner_id").agg(F.count_distinct(conv).alias("conversations"))
    m = messages.groupBy("owner_id").agg(F.count(F.lit(1)).alias("messages"))
    return c.join(m, "owner_id", "full").select(
        "owner_id", F.coalesce("conversations", F.lit(0)).alias("conversations"),
        F.coalesce("messages", F.lit(0)).alias("messages"))
