"""Live paths as Structured Streaming jobs.

Sinks write one folder per micro-batch and overwrite it when a batch is repeated, so a restart
after a lost executor or driver neither loses nor doubles rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from factbase.functions import secrets as S
from factbase.operators.incremental import snapshot_changes
from factbase.operators.usage import FACT, usage_by_agent
from factbase.operators.validate import violations, with_variant
from factbase.session import shared_folder

GAP_MS = 500  # fixed value: bursts closer than this are one reload


def stream_table(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """A Parquet file (or files of that name pattern) of a folder as a stream, or a table that is a folder of part files."""
    table = spark.read.parquet(f"{folder}/{file}")
    reader = spark.readStream.schema(table.schema)
    if any(f"/{file}/" in unquote(path) for path in table.inputFiles()):
        return reader.parquet(f"{folder}/{file}")
    return reader.option("pathGlobFilter", file).parquet(folder)


def run_to_end(stream: DataFrame, out: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process what is available into `out`, one folder per micro-batch, and stop."""
    start(stream, out, transform).awaitTermination()


def start(stream: DataFrame, out: str, transform=None, **trigger) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch) if transform else batch
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def new_output(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def usage_counters(stream: DataFrame, out: str, **trigger) -> StreamingQuery:
    """Keep the accesses of each batch, once per event. There is no watermark: an event counts however late it comes."""
    return start(stream, out, lambda df: df.select("event_id", *FACT, "agent", "ts").dropDuplicates(["event_id"]), **trigger)


def read_usage_counters(spark: SparkSession, out: str) -> DataFrame:
    """Current counters of (fact, agent): every event of all batches once, replayed ones included once."""
    return usage_by_agent(spark.read.parquet(f"{out}/rows").dropDuplicates(["event_id"]), FACT)


def checked(batch: DataFrame) -> DataFrame:
    """Documents of one micro-batch with their number of violations."""
    return with_variant(batch).withColumn("errors", F.size(violations()).cast("bigint")).drop("v")


def pack_files(spark: SparkSession, folder: str) -> DataFrame:
    """(owner_id, path, doc, mtime) of the JSON packs below a folder; the owner comes from owner_id=.. in the path."""
    place = F.col("_metadata.file_path")
    files = (spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true")
             .schema("value string").text(folder))
    owner = F.regexp_extract(place, "/owner_id=([^/]+)/", 1)
    return files.select(F.when(owner != "", F.url_decode(owner)).otherwise("me").alias("owner_id"), place.alias("path"),
                        F.col("value").alias("doc"), F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("mtime"))


def pack_changes(spark: SparkSession, folder: str, out: str, run: int) -> DataFrame:
    """One look at a watched folder, numbered `run` (1, 2, ..): what was created, modified or deleted since the run
    before is validated and stored. A file source of streams would not read a rewritten path again, so each look
    compares paths and modification times. Repeating a run after a failure gives the same rows."""
    return record_changes(pack_files(spark, folder), out, run)


def record_changes(now: DataFrame, out: str, run: int) -> DataFrame:
    """Compare files (owner_id, path, doc, mtime) with the snapshot of the run before and store what changed."""
    spark = now.sparkSession
    seen = f"{out}/snapshot/run={run}"
    now.select("owner_id", "path", "mtime").write.mode("overwrite").parquet(seen)
    after = spark.read.parquet(seen)
    before = spark.read.parquet(f"{out}/snapshot/run={run - 1}") if run > 1 else after.limit(0)
    changes = snapshot_changes(before, after, suffix="")
    docs = changes.join(now, ["owner_id", "path"], "left").select(
        "owner_id", "path", "change", F.element_at(F.split("path", "/"), -1).alias("file"), "doc", "mtime")
    rows = checked(docs).withColumn("errors", F.when(F.col("change") != "deleted", F.col("errors")))
    rows.write.mode("overwrite").parquet(f"{out}/rows/run={run}")
    return spark.read.parquet(f"{out}/rows/run={run}")


def latest_packs(spark: SparkSession, out: str) -> DataFrame:
    """(owner_id, path, file, doc, errors): the last version of each file that is still there; for read_packs."""
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.groupBy("owner_id", "path").agg(F.max("run").alias("run"))
    return (rows.join(last, ["owner_id", "path", "run"]).where("change != 'deleted'")
            .select("owner_id", "path", "file", "doc", "errors"))


def scrub_stream(stream: DataFrame, text: str = "text") -> DataFrame:
    """Stateless scrubbing of a text stream."""
    return stream.withColumn(text, S.scrub(F.col(text)))


def debounced_stream(changes: DataFrame, out: str, bucket: str = "hour", **trigger) -> StreamingQuery:
    """Keep the changes of each batch, counted per owner and instant; read_debounced builds the bursts of all."""
    def seconds(batch: DataFrame) -> DataFrame:
        return batch.groupBy("owner_id", "ts").agg(F.count(F.lit(1)).alias("changes"))
    return start(changes, out, seconds, **trigger)


def read_debounced(spark: SparkSession, out: str, bucket: str = "hour") -> DataFrame:
    """Bursts over all batches, late changes included; a hot owner is split into buckets of time as in batch."""
    return debounced_reloads(spark.read.parquet(f"{out}/rows"), bucket)


def gap() -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(GAP_MS / 1000))


def within_buckets(changes: DataFrame, bucket: str) -> DataFrame:
    """Bursts inside (owner, h), where h is a bucket of time: (owner_id, h, first_ts, last_ts, changes)."""
    number = F.sum("changes") if "changes" in changes.columns else F.count(F.lit(1))
    part = changes.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    part = part.withColumn("h", F.date_trunc(bucket, "ts").cast("timestamp_ntz"))
    return (part.groupBy("owner_id", "h", F.session_window("ts", f"{GAP_MS} milliseconds"))
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), number.alias("changes")).drop("session_window"))


def across_buckets(local: DataFrame, bucket: str) -> DataFrame:
    """Join up bursts that go on in the next bucket; only those within the gap of a bucket's edge are looked at."""
    width = F.expr(f"interval '1' {bucket}")
    edge = (F.col("first_ts") - F.col("h") <= gap()) | (F.col("h") + width - F.col("last_ts") <= gap())
    local = local.withColumn("_edge", edge)
    w = Window.partitionBy("owner_id").orderBy("first_ts")
    ends = (local.where("_edge")
            .withColumn("_new", F.coalesce(F.col("first_ts") - F.lag("last_ts").over(w) > gap(), F.lit(True)))
            .withColumn("_id", F.sum(F.col("_new").cast("int")).over(w)))
    joined = ends.groupBy("owner_id", "_id").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("changes").alias("changes"))
    cols = ["owner_id", "first_ts", "last_ts", "changes"]
    return local.where(~F.col("_edge")).select(*cols).unionByName(joined.select(*cols))


def debounced_reloads(changes: DataFrame, bucket: str = "hour") -> DataFrame:
    """Bursts of changes per owner in batch: (owner_id, first_ts, last_ts, changes).

    Sessions are built inside (owner, bucket of time: day, hour, minute or second), so a busy owner is spread over
    many tasks. Only sessions within the gap of a bucket's edge can go on in another one; those few are joined up
    in a second step. Rows may carry a count of changes of their own.
    """
    return across_buckets(within_buckets(changes, bucket), bucket)
