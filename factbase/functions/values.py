"""Column expressions used by many operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_ts(as_of: str | Column) -> Column:
    """An as-of instant given as text ('2024-02-01 00:00:00') or as a column."""
    return F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of


# Fixed value: every character that counts as whitespace.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(col: Column | str) -> Column:
    """Trim every kind of whitespace, not only blanks. Looks at the ends of the text only."""
    return F.btrim(col, F.lit(WHITESPACE))


def value_text(items: str = "value_items") -> Column:
    return F.array_join(items, ", ")


def norm_value(items: str = "value_items", is_list: str = "value_is_list") -> Column:
    """Comparable form: lists are stripped, lowered and sorted; scalars stripped and lowered."""
    listed = F.array_join(F.array_sort(F.transform(items, lambda x: F.lower(strip(x)))), ", ")
    scalar = F.lower(strip(F.get(items, F.lit(0))))
    return F.when(F.col(is_list), listed).otherwise(scalar)


def conf_rank(col: str = "confidence") -> Column:
    """0 high, 1 medium, 2 anything else."""
    c = F.col(col)
    return F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)


def age_days(as_of: str | Column, ts: Column | str) -> Column:
    """Whole 24-hour periods between ts and as_of, rounded down (also for future dates)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    gap = as_ts(as_of) - col
    days = F.extract(F.lit("DAY"), gap)
    exact = F.make_dt_interval(days) == gap
    below = gap < F.expr("interval '0' day")
    return (days - F.when(below & ~exact, 1).otherwise(0)).cast("bigint")


def quality(conf: str = "confidence", ts: str = "updated_at") -> Column:
    """Orderable quality of a fact: confidence first, then recency (unknown dates are oldest)."""
    return F.struct(
        (-conf_rank(conf)).alias("c"),
        F.coalesce(F.col(ts), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("d"),
    )


def contains_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def bucketed_rank(df: DataFrame, group: list[str], buckets: dict[str, Column], order: list[Column],
                  out: str) -> DataFrame:
    """row_number over `group`, without ever sorting a whole group in one task.

    `buckets` are leading parts of the ordering. Rows are ranked inside (group, buckets) and
    shifted by the number of rows in earlier buckets; only the small count table sees a window
    over the whole group. Both sides hash on the same keys, so the join adds no shuffle.
    """
    names = list(buckets)
    df = df.withColumns(buckets)
    keys = group + names
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return (local.join(offsets, keys)
            .withColumn(out, (F.col("_off") + F.col("_rn")).cast("bigint"))
            .drop("_off", "_rn", *names))


def running_max_before(df: DataFrame, group: list[str], pos: str, value: str, out: str,
                       width: int = 1 << 16, rows: DataFrame | None = None) -> DataFrame:
    """max(value) over earlier rows of the group, in two levels of position blocks.

    Only groups of several blocks need the second level. `rows`: a stored frame of the same rows to take it from.
    """
    block = F.floor(F.col(pos) / width).alias("_blk")
    keys = group + ["_blk"]
    inner = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    slim = (df if rows is None else rows).select(*group, block, F.col(value).alias("_value"))
    wide = slim.groupBy(*group).agg(F.min("_blk").alias("_lo"), F.max("_blk").alias("_hi")).where(F.col("_lo") < F.col("_hi"))
    blocks = (slim.join(wide.select(*group), group, "left_semi").groupBy(*keys).agg(F.max("_value").alias("_bm"))
              .withColumn("_prev", F.max("_bm").over(outer)).drop("_bm"))
    return (df.withColumn("_blk", block).withColumn("_in", F.max(value).over(inner)).join(blocks, keys, "left")
            .withColumn(out, F.greatest("_in", "_prev")).drop("_in", "_prev", "_blk"))
