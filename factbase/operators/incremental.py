"""Content hashes, change detection and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factbase.functions.values import as_ts

KEYS = ["owner_id", "source_key"]


def content_hashes(sources: DataFrame) -> DataFrame:
    """sources(owner_id, source_key, content); unreadable content has a NULL hash."""
    return sources.select(*KEYS, F.sha2("content", 256).alias("hash"))


def changed_sources(current: DataFrame, cache: DataFrame) -> DataFrame:
    """current + changed: the hash is new, different or unknown."""
    old = cache.select(*KEYS, F.col("hash").alias("_old"))
    same = F.col("hash").isNotNull() & F.col("hash").eqNullSafe(F.col("_old"))
    return current.join(old, KEYS, "left").withColumn("changed", ~same).drop("_old")


def change_summary(flags: DataFrame) -> DataFrame:
    return flags.groupBy("owner_id").agg(F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("skipped"))


def update_hash_cache(cache: DataFrame, current: DataFrame, as_of) -> DataFrame:
    """cache(owner_id, source_key, hash, scanned_at) after a scan; last_full_scan is the scan time."""
    new = current.where(F.col("hash").isNotNull()).select(*KEYS, F.col("hash").alias("_new"))
    both = cache.join(new, KEYS, "full_outer")
    return both.select(*KEYS, F.coalesce("_new", "hash").alias("hash"),
                       F.when(F.col("_new").isNotNull(), as_ts(as_of)).otherwise(F.col("scanned_at")).alias("scanned_at"),
                       as_ts(as_of).alias("last_full_scan"))


def hash_cache_stats(cache: DataFrame) -> DataFrame:
    """Entries of each owner and the time of the last full scan that the cache itself states."""
    return cache.groupBy("owner_id").agg(F.count(F.lit(1)).alias("entries"), F.max("last_full_scan").alias("last_scan"))


def snapshot_changes(before: DataFrame, after: DataFrame, suffix: str = ".yaml") -> DataFrame:
    """(owner_id, path, change): created, modified (other mtime) or deleted files with the suffix."""
    side = lambda df, name: df.where(F.endswith("path", F.lit(suffix))).select(
        "owner_id", "path", F.col("mtime").alias(name))
    change = (F.when(F.col("_b").isNull(), "created").when(F.col("_a").isNull(), "deleted")
              .when(F.col("_a") != F.col("_b"), "modified"))
    return (side(before, "_b").join(side(after, "_a"), ["owner_id", "path"], "full_outer")
            .select("owner_id", "path", change.alias("change")).where(F.col("change").isNotNull()))
