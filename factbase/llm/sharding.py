"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Rows stand on a ring of CELLS places, ordered in a place by the rest of their hash; shards stand there with `vnodes`
virtual nodes each. Going round clockwise, a virtual node takes the rows that wait for it until its shard is full;
the others continue to the next one, first come, first served. Because rows wait in ring order, each virtual node
takes one run of ring ranks, so only the counts of arcs are needed to decide everything: a fold over at most
2 x shards x vnodes steps, whose size does not depend on the data. Rows then need one narrow shuffle for their rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BITS = 14
CELLS = 1 << BITS


def _cell(digest: Column) -> Column:
    return F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - BITS)


def _arcs(spark, shards: int, vnodes: int) -> tuple[DataFrame, DataFrame]:
    """Virtual nodes in ring order (arc, shard) and the arc of each cell; both have a fixed size."""
    node = spark.range(shards * vnodes).select(
        F.floor(F.col("id") / vnodes).cast("int").alias("shard"), F.md5(F.concat(F.lit("node-"), "id")).alias("digest"))
    node = node.select("shard", "digest", _cell(F.col("digest")).alias("cell"))
    arcs = node.select((F.row_number().over(Window.orderBy("digest")) - 1).alias("arc"), "shard")
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
             .join(node.groupBy("cell").agg(F.count("*").alias("n")), "cell", "left")
             .select("cell", (F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0))
                              % (shards * vnodes)).cast("int").alias("arc")))
    return arcs, cells


def _runs(counts: DataFrame, shards: int, slack: float) -> DataFrame:
    """One row per arc with rows: base (rank of its first row) and the takes that touch it (start, n, shard, slot)."""
    before = Window.orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    based = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    laps = based.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n", "base"))).alias("lap"), F.sum("n").alias("total"))
    room = (f"transform(sequence(0, {shards - 1}), s -> total div {shards} + if(s < total % {shards}, 1L, 0L))" if not slack
            else f"transform(sequence(0, {shards - 1}), s -> cast(ceil(total * {1 + slack!r} / {shards}) as bigint))")
    laps = laps.withColumn("room", F.expr(room))
    fold = F.expr("""
        aggregate(
            concat(lap, transform(lap, x -> named_struct('arc', x.arc, 'shard', x.shard, 'n', 0L, 'base', x.base))),
            named_struct('waiting', 0L, 'start', 0L, 'free', room,
                         'takes', cast(array() as array<struct<start:bigint,n:bigint,shard:int,slot:bigint>>)),
            (a, x) -> named_struct(
                'waiting', a.waiting + x.n - least(a.waiting + x.n, a.free[x.shard]),
                'start', a.start + least(a.waiting + x.n, a.free[x.shard]),
                'free', transform(a.free, (f, i) -> if(i = x.shard, f - least(a.waiting + x.n, f), f)),
                'takes', if(least(a.waiting + x.n, a.free[x.shard]) > 0,
                    concat(a.takes, array(named_struct('start', a.start, 'n', least(a.waiting + x.n, a.free[x.shard]),
                        'shard', x.shard, 'slot', room[x.shard] - a.free[x.shard]))),
                    a.takes)),
            a -> a.takes)""")
    touching = F.expr("""
        transform(filter(lap, x -> x.n > 0), x -> named_struct('arc', x.arc, 'base', x.base,
            'takes', filter(takes, t -> t.start < x.base + x.n and t.start + t.n > x.base)))""")
    return laps.select("lap", fold.alias("takes")).select(F.inline(touching))


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float = 0.0, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """`id_col`, size, text_crc32, law, shard, slot and grown_shard of every row.

    With slack 0 the law is `rows`: a shard is full at the n-th part of all rows, so counts differ by one at most.
    With slack e a shard holds up to (1 + e) times the mean and fewer rows move when shards are added (law `loads`).
    The ring place comes from the id as text, for a null id from the text's checksum; equal ids are ordered by
    checksum and size, and wholly equal rows are interchangeable. A null text has size 16 and a null checksum.
    """
    ring = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text-"), F.crc32(F.col(text).cast("binary"))),
                            F.lit("null")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"), ring.alias("digest"))
    rows = rows.withColumn("cell", _cell(F.col("digest")))
    arcs, cells = _arcs(docs.sparkSession, shards, vnodes)
    cells = F.broadcast(cells)  # CELLS rows
    counts = rows.join(cells, "cell").groupBy("arc").agg(F.count("*").alias("n"))
    counts = arcs.join(counts, "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).alias("n"))
    slim = rows.join(cells, "cell").select(
        "id", "arc", "digest", (F.coalesce(F.octet_length("t"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"))
    order = Window.partitionBy("arc").orderBy("digest", "id", "text_crc32", "size")
    ranked = slim.withColumn("rank", F.row_number().over(order) - 1)
    placed = ranked.join(F.broadcast(_runs(counts, shards, slack)), "arc").withColumn("rank", F.col("rank") + F.col("base"))
    placed = placed.withColumn("take", F.expr("filter(takes, t -> rank >= t.start and rank < t.start + t.n)[0]"))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("loads" if slack else "rows").alias("law"),
        F.col("take.shard").cast("int").alias("shard"), (F.expr("take.slot + rank - take.start")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
