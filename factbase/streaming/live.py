"""Results that can be read while a stream runs: counters, bursts of changes and a watched folder.

State lies in the shared folder and is cheap to read. Each micro-batch leaves one delta, an aggregate of the batch by the keys of the
result; every few batches the deltas are folded into a base. A reader merges the last base with the deltas
after it, so it touches results and never the events behind them. Deltas may be merged in any order and a repeated batch overwrites its
own, so late events, restarts and replays change nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from factbase.operators.incremental import snapshot_changes
from factbase.operators.usage import FACT, usage_by_agent
from factbase.streaming.jobs import across_buckets, checked, gap, within_buckets

FOLD_EVERY = 16       # batches
TICK = "1 second"     # fixed value: a watched folder is looked at this often


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, place = _place(spark, path)
    fs.delete(place, True)


def numbered(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete tables name=number in a folder, ascending."""
    fs, place = _place(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath() for s in fs.listStatus(place)]
    done = [p.getName() for p in names if fs.exists(_place(spark, f"{p.toString()}/_SUCCESS")[1])]
    return sorted(int(n.rsplit("=", 1)[1]) for n in done)


class Running:
    """A result that grows by one delta for each micro-batch; merge(rows of any deltas) gives the current rows."""

    def __init__(self, spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame], every: int = FOLD_EVERY):
        self.spark, self.out, self.merge, self.every = spark, out, merge, every

    def _rows(self, base: int | None, deltas: list[int]) -> DataFrame | None:
        paths = [f"{self.out}/base/upto={base}"] if base is not None else []
        paths += [f"{self.out}/deltas/batch={n}" for n in deltas]
        return self.merge(self.spark.read.parquet(*paths)) if paths else None

    def add(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.out}/deltas/batch={batch}")
        if (batch + 1) % self.every == 0:
            self.fold(batch)

    def fold(self, upto: int) -> None:
        """Make a new base of all deltas up to a batch. The base before and its later deltas stay for readers that still use
        them and for a repetition of the batch; what is older goes."""
        bases = [n for n in numbered(self.spark, f"{self.out}/base") if n < upto]
        before = bases[-1] if bases else None
        later = [n for n in numbered(self.spark, f"{self.out}/deltas") if n <= upto and (before is None or n > before)]
        self._rows(before, later).write.mode("overwrite").parquet(f"{self.out}/base/upto={upto}")
        for n in bases[:-1]:
            delete_folder(self.spark, f"{self.out}/base/upto={n}")
        for n in numbered(self.spark, f"{self.out}/deltas"):
            if before is not None and n <= before:
                delete_folder(self.spark, f"{self.out}/deltas/batch={n}")

    def read(self, empty: str) -> DataFrame:
        """Current rows; before the first batch none, with the schema `empty`."""
        bases = numbered(self.spark, f"{self.out}/base")
        base = bases[-1] if bases else None
        rows = self._rows(base, [n for n in numbered(self.spark, f"{self.out}/deltas") if base is None or n > base])
        return self.spark.createDataFrame([], empty) if rows is None else rows


def _start(stream: DataFrame, out: str, step: Callable[[DataFrame, int], None], trigger: dict) -> StreamingQuery:
    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{out}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


# ---- usage counters ----
def _counters(rows: DataFrame) -> DataFrame:
    return usage_by_agent(rows, FACT)


def live_usage(stream: DataFrame, out: str, delay: str = "1 hour", every: int = FOLD_EVERY, **trigger) -> StreamingQuery:
    """Count accesses (event_id, owner_id, pack, key, agent, ts) of facts once per event, however late it comes.

    Two lanes of one query. The timely lane drops repeated ids within the watermark by streaming state. What it does
    not let through is repeated or later than the watermark: such rows, and rows without ts, are compared with the stored
    ids of their own days only, and those never seen are counted too. A repeated event must carry the ts it had before.
    Rows without event_id count as one event.
    """
    rows = stream.select("event_id", *FACT, "agent", F.col("ts").cast("timestamp").alias("ts"))
    timely = rows.where("ts is not null").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    lanes = timely.withColumn("lane", F.lit("timely")).unionByName(rows.withColumn("lane", F.lit("all")))
    id_type = rows.schema["event_id"].dataType.simpleString()

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = f"{out}/lanes/batch={number}"
        batch.write.mode("overwrite").parquet(path)  # the state is used once; all that follows reads this
        day = F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
        both = spark.read.parquet(path).withColumn("day", day).withColumn("id", F.coalesce(F.col("event_id").cast("string"), F.lit("")))
        fresh = both.where("lane = 'timely'")
        left = both.where("lane = 'all'").join(fresh.select("id"), "id", "left_anti").dropDuplicates(["id"])
        days = [r.day for r in left.select("day").distinct().collect()]
        if days:
            if numbered(spark, f"{out}/ids"):
                stored = spark.read.schema(f"event_id {id_type}, batch int, day date").parquet(f"{out}/ids")
                known = stored.where((F.col("batch") < number) & F.col("day").isin(days)).select(
                    "day", F.coalesce(F.col("event_id").cast("string"), F.lit("")).alias("id"))
                left = left.join(known, ["day", "id"], "left_anti")
            fresh = fresh.unionByName(left)
        fresh.select("event_id", "day").write.mode("overwrite").partitionBy("day").parquet(f"{out}/ids/batch={number}")
        Running(spark, out, _counters, every).add(_counters(fresh), number)
        delete_folder(spark, f"{out}/lanes/batch={number - 1}")

    return _start(lanes, out, step, trigger)


def read_live_usage(spark: SparkSession, out: str) -> DataFrame:
    """Current counters of (fact, agent), as usage_by_agent gives them for all events so far."""
    empty = "owner_id string, pack string, key string, agent string, calls long, last_called timestamp"
    return Running(spark, out, _counters).read(empty)


# ---- bursts of changes ----
def _pieces(rows: DataFrame) -> DataFrame:
    """Pieces of bursts (owner_id, h, first_ts, last_ts, changes) that meet within the gap become one; h is a bucket of time."""
    w = Window.partitionBy("owner_id", "h").orderBy("first_ts", "last_ts")
    reach = F.max("last_ts").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("first_ts") - reach > gap(), F.lit(True)).cast("int")
    part = rows.withColumn("_new", starts).withColumn("_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("owner_id", "h", "_id").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("changes").alias("changes")).drop("_id")


def live_bursts(changes: DataFrame, out: str, bucket: str = "hour", every: int = FOLD_EVERY, **trigger) -> StreamingQuery:
    """Keep the bursts of changes (owner_id, ts) of each owner. A change of any age joins the bursts that it touches, so
    a late one reopens or connects stored bursts. Pieces are kept by bucket of time: a busy owner is spread over many tasks."""
    def step(batch: DataFrame, number: int) -> None:
        Running(batch.sparkSession, out, _pieces, every).add(within_buckets(batch, bucket), number)

    return _start(changes.select("owner_id", "ts"), out, step, trigger)


def read_live_bursts(spark: SparkSession, out: str, bucket: str = "hour") -> DataFrame:
    """(owner_id, first_ts, last_ts, changes, closed) of all bursts so far; one is closed when a change of any owner is
    more than the gap later than its last one."""
    empty = "owner_id string, h timestamp_ntz, first_ts timestamp_ntz, last_ts timestamp_ntz, changes long"
    pieces = Running(spark, out, _pieces).read(empty)
    newest = pieces.agg(F.max("last_ts")).first()[0]
    return across_buckets(pieces, bucket).withColumn("closed", F.lit(newest).cast("timestamp_ntz") - F.col("last_ts") > gap())


# ---- watched packs ----
def _owner(path: Column) -> Column:
    owner = F.regexp_extract(path, "/owner_id=([^/]+)/", 1)
    return F.when(owner != "", F.url_decode(owner)).otherwise("me")


def look(spark: SparkSession, folder: str, out: str, run: int, pattern: str = "*.json", unit: str = "file") -> None:
    """One look at the documents below a folder: what was created, modified or deleted since the last look that found
    something is validated and stored as rows/run=.. (for latest_packs).

    The folder is listed once: first only paths and times are read, then the texts of files no older than the oldest change. unit "folder": the
    parts in a folder, as Spark writes them, are one document. A repeated look overwrites its own rows.
    """
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
              .option("ignoreMissingFiles", "true").load(folder))
    file = F.col("_metadata.file_path")
    path = F.regexp_replace(file, "/[^/]*$", "") if unit == "folder" else file
    seen = f"{out}/snapshot/run={run}"
    (listed.select(_owner(file).alias("owner_id"), path.alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime"))
     .groupBy("owner_id", "path").agg(F.max("mtime").alias("mtime")).write.mode("overwrite").parquet(seen))
    earlier = [n for n in numbered(spark, f"{out}/snapshot") if n < run]
    after = spark.read.parquet(seen)
    before = spark.read.parquet(f"{out}/snapshot/run={earlier[-1]}") if earlier else after.limit(0)
    changes = snapshot_changes(before, after, suffix="").join(after, ["owner_id", "path"], "left")
    found = changes.agg(F.count(F.lit(1)).alias("n"), F.min("mtime").alias("oldest")).first()
    if not found.n:
        delete_folder(spark, seen)
        return
    written = listed
    if found.oldest:
        since = F.lit((found.oldest - timedelta(seconds=2)).strftime("%Y-%m-%dT%H:%M:%S")).cast("timestamp")
        written = listed.where(F.col("modificationTime") > since)  # the reader opens no older file
    texts = written.select(path.alias("path"), file.alias("part"), F.col("content").cast("string").alias("value"))
    docs = texts.join(changes.select("path"), "path", "left_semi").groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda p: p["value"]), "").alias("doc"))
    rows = checked(changes.join(docs, "path", "left").select(
        "owner_id", "path", "change", F.element_at(F.split("path", "/"), -1).alias("file"), "doc", "mtime"))
    rows = rows.withColumn("errors", F.when(F.col("change") != "deleted", F.col("errors")))
    rows.write.mode("overwrite").parquet(f"{out}/rows/run={run}")
    for n in earlier[:-1]:
        delete_folder(spark, f"{out}/snapshot/run={n}")


def watch_packs(spark: SparkSession, folder: str, out: str, pattern: str = "*.json", unit: str = "file", **trigger) -> StreamingQuery:
    """Look at a folder once for each trigger (TICK where none is given), for as long as the query runs; a restarted
    query goes on with the snapshot that it stored last."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()

    def step(batch: DataFrame, number: int) -> None:
        look(batch.sparkSession, folder, out, number + 1, pattern, unit)

    return _start(ticks, out, step, trigger or {"processingTime": TICK})
