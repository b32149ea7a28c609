"""Chat exports of any size: one file is read by many tasks, conversation by conversation.

Spark's text reader cuts files into splits of `spark.sql.files.maxPartitionBytes`; records end at `}` instead of at a line's
end, so a record is never larger than what lies between two of them. Whether a place is inside a string, and how deep it is,
follows from all that stands before it in the file, so there are three narrow passes, and texts are not shuffled:

1. every split is summed up for both cases, beginning outside and inside a string: whether it changes the case, and how
   much deeper it ends; running sums over the splits of a file give every split its true beginning;
2. with that, splits count the conversations that begin in them, and running sums give their numbers;
3. splits give out the conversations; only those that lie across splits are put together by a shuffle.

What tells of splits is one row for each split after a file's first one, 0.8 million for 100 TB in splits of 128 MB, and
that is all that is broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.operators.validate import whole_json
from factbase.sources.chats import CONVERSATION, flat_messages, tree_messages
from factbase.sources.packs import owner_of

ESCAPED = re.compile(r"\\.", re.S)
TOKEN = re.compile(r'\\.|["\[\]{},]', re.S)
BLANK = " \t\r\n"
SPLIT = ["path", "split"]
SUMS = "path string, split long, size long, held long, turns long, outside long, inside long, head string"
FRAGMENT = "path string, split long, number long, whole boolean, text string"
FLUSH = 4 << 20


def _records(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").schema("value string").text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
                        F.col("_metadata.file_size").alias("size"), F.octet_length("value").cast("long").alias("bytes"), F.make_valid_utf8("value").alias("value"))


def _deeper(runs: list[str]) -> int:
    text = "".join(runs)
    return text.count("[") + text.count("{") - text.count("]") - text.count("}")


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of each split: bytes held, quotes, depth gained if it begins outside or inside a string, first character."""
    def row(place, size, held, quotes, gained, head):
        columns = [*place, size, held, quotes % 2, *gained, head]
        return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns[:-1]] + [pa.array([head], pa.string())],
                                          names=[f.split()[0] for f in SUMS.split(", ")])
    now = None
    for batch in batches:
        for path, split, size, length, value in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (path, split):
                if now:
                    yield row(now, total, held, quotes, gained, head)
                now, total, held, quotes, gained, head = (path, split), size, 0, 0, [0, 0], None
            held += length + 1
            value += "}"
            runs = ESCAPED.sub("", value).split('"')
            for turn in (0, 1):
                gained[(quotes + turn) % 2] += _deeper(runs[turn::2])
            quotes += len(runs) - 1
            head = head or value.strip(BLANK)[:1]
    if now:
        yield row(now, total, held, quotes, gained, head)


def _beginnings(records: DataFrame) -> DataFrame:
    """SUMS + at (the place of the split's first record), whether and how deep the split begins inside a string, the
    file's first character if it stands before the split, and whether the file ends in the middle of something."""
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    none = F.lit(0).cast("long")
    sums = records.select("path", "split", "size", "bytes", "value").mapInArrow(_sum_up, SUMS)
    sums = sums.withColumn("quoted", F.coalesce(F.sum("turns").over(before), none) % 2)
    sums = sums.withColumn("gained", F.when(F.col("quoted") == 1, F.col("inside")).otherwise(F.col("outside")))
    # the file's last record counts as ended by a }, also where there is none
    unended = F.when((F.sum("held").over(whole) > F.col("size")) & (F.sum("turns").over(whole) % 2 == 0), 1).otherwise(0)
    return sums.withColumns({
        "at": F.coalesce(F.sum("held").over(before), none), "depth": F.coalesce(F.sum("gained").over(before), none),
        "head": F.first(F.nullif("head", F.lit("")), True).over(before),
        "broken": (F.sum("turns").over(whole) % 2 == 1) | (F.sum("gained").over(whole) + unended != 0)})


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FRAGMENT rows: the conversations that a split holds, whole ones and the pieces of those that go over its borders.

    number: from 0 for those that begin in the split, -1 for the one that began before, -2 for text after the end of the
    list. Text at depth 0 that is no list is one conversation: a single object. A split that ends between two
    conversations gives an empty piece of the one to come.
    """
    out: list[tuple] = []
    kept, now, buffer = 0, None, []

    def rows() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in FRAGMENT.split(", ")])

    def last() -> None:
        text = "".join(buffer)
        if (first and not over) or text.strip(BLANK):
            out.append((*now, -2 if over else number, not over and now[1] == 0 and place >= size and not listed, text))

    for batch in batches:
        for path, split, size_now, length, value, at, head, quoted, depth_before in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (path, split):
                if now:
                    last()
                if split and at is None:
                    raise RuntimeError(f"{path} is cut into other splits than before: set spark.sql.files.minPartitionNum where the number of cores changes")
                now, buffer, size, first = (path, split), [], size_now, head
                inside, depth, number, place = bool(quoted), depth_before or 0, -1 if head else 0, at or 0
                over = head == "[" and depth <= 0
            place += length
            if place < size:
                value += "}"
                place += 1
            first = first or value.strip(BLANK)[:1]
            listed = first == "["
            if not listed or over or depth - value.count("]") - 1 > 1:  # no border is near: only the state is followed
                runs = ESCAPED.sub("", value).split('"')
                depth += _deeper(runs[int(inside)::2])
                inside ^= len(runs) % 2 == 0
                buffer.append(value)
                continue
            start = 0
            for found in TOKEN.finditer(value):
                token, spot = found.group(), found.start()
                if token == '"':
                    inside = not inside
                elif inside or token[0] == "\\" or over:
                    continue
                elif token in "[{":
                    depth += 1
                    if depth == 1:
                        start = spot + 1
                elif token != ",":
                    depth -= 1
                if (token == "," and depth == 1) or (token in "]}" and depth <= 0):
                    buffer.append(value[start:spot])
                    text, over = "".join(buffer), token != ","
                    if number or not over or text.strip(BLANK):  # [] holds nothing
                        out.append((path, split, number, number >= 0, text))
                        kept += len(text)
                    buffer, start, number = [], spot + 1, number + 1
            buffer.append(value[start:])
        if kept > FLUSH:
            yield rows()
            out, kept = [], 0
    if now:
        last()
    if out:
        yield rows()


def split_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(path, conv_no, doc, error): one row per conversation of the export files under `path`; conv_no counts from 0 in a file.

    A file is a list of conversations or a single object. What cannot be read leaves a row with an error and no doc:
    a conversation that is not one JSON value (`unreadable`), text after the end of the list, and, without
    conv_no, a file that ends too early; its conversations before the damage are read. An empty file has no rows.
    """
    records = _records(spark, path)
    sums = _beginnings(records)
    later = sums.where("split > 0").select(*SPLIT, "at", "head", "quoted", "depth")
    pieces = (records.join(F.broadcast(later), SPLIT, "left")
              .select("path", "split", "size", "bytes", "value", "at", "head", "quoted", "depth").mapInArrow(_fragments, FRAGMENT))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    base = pieces.groupBy(*SPLIT).agg(F.greatest(F.max("number") + 1, F.lit(0)).alias("begun"))
    base = base.withColumn("base", F.coalesce(F.sum("begun").over(before), F.lit(0))).drop("begun")
    placed = pieces.join(base, SPLIT).withColumn("conv_no", F.when(F.col("number") > -2, F.col("base") + F.col("number")))
    parts = F.array_sort(F.collect_list(F.struct("split", "text")))
    joined = (placed.where(~F.col("whole")).groupBy("path", "conv_no").agg(parts.alias("parts"))
              .select("path", "conv_no", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
    every = placed.where("whole").select("path", "conv_no", "text").unionByName(joined)
    blank = (F.col("conv_no") == 0) & (F.trim("text", F.lit(BLANK)) == "")  # an empty list over two splits
    error = F.when(F.col("conv_no").isNull(), "text after the end").when(whole_json(F.col("text")).isNull(), "unreadable")
    read = every.where(F.coalesce(~blank, F.lit(True))).withColumn("error", F.explode(F.array(error)))
    ends = sums.where("split = 0 and broken").select("path", F.lit(None).cast("bigint").alias("conv_no"),
                                                     F.lit(None).cast("string").alias("doc"), F.lit("ends too early").alias("error"))
    return read.select("path", "conv_no", F.when(F.col("error").isNull(), F.col("text")).alias("doc"), "error").unionByName(ends)


def _owned(conversations: DataFrame, conv) -> DataFrame:
    return conversations.where("error is null").select(
        owner_of(F.col("path")).alias("owner_id"), F.col("path").alias("file"), "conv_no", conv)


def split_chat_flat(conversations: DataFrame) -> DataFrame:
    """`read_chat_flat` for the rows of split_conversations; `file` is the whole path."""
    return flat_messages(_owned(conversations, F.explode(F.array(whole_json(F.col("doc")))).alias("conv")))


def split_chat_tree(conversations: DataFrame) -> DataFrame:
    """`read_chat_tree` for the rows of split_conversations; `file` is the whole path."""
    return tree_messages(_owned(conversations, F.from_json("doc", CONVERSATION).alias("c")))
