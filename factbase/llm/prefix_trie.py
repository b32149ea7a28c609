"""Prefix trie of conversations by hashing of fixed-length blocks of turns.

Turns are ranked and replaced by digests; texts go no further. A conversation is cut into blocks of BLOCK turns, and
the salted digests of successive blocks are added up, so that a path (all blocks up to here) is known without walking
the conversation. Conversations are first grouped by their paths: one row for each block instead of one for each
turn. Where all that go on from a path share one next block, its inner turns have the members of that block.
Only where siblings diverge, the few distinct blocks (not the conversations) are opened, and their turns are grouped anew.

Each node has one owner, its smallest member, and a conversation owns the nodes from some depth on. A member saves all
turns before those that it owns, so saved turns and leaves of a subtree are sums over its members and need no walk up
the tree: one more round of sums by block, opened in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.llm.storage import cut

BLOCK = 4       # turns in a block
STRETCH = 256   # blocks of a conversation that are added up in one window
ENDS = 4096     # width of the id ranges in which ends are listed
SUMS = ["s0", "s1", "s2", "s3"]  # sums of the 32-bit parts of block digests
EMPTY = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, node (a key).
    ends: node, range, ids (ids that end there and lie in the range, ascending, comma-joined)."""
    nodes: DataFrame
    ends: DataFrame


def _before(order: list[Column | str], keys: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _earlier(value: str, window) -> Column:
    return F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long")


def _rank(rows: DataFrame, key: str, levels: list[str], last: str, number: str) -> DataFrame:
    """pos: sum of `number` over earlier rows of the key, by levels and `last`. Sums are formed level by level, so that
    no window sees more than the values of one level inside the level above."""
    out = rows.withColumn("pos", _earlier(number, _before([last], [key, *levels])))
    for i in reversed(range(len(levels))):
        keys = [key, *levels[: i + 1]]
        sums = rows.groupBy(*keys).agg(F.sum(number).alias("_n"))
        sums = sums.select(*keys, _earlier("_n", _before([levels[i]], keys[:-1])).alias("_off"))
        out = out.join(sums, keys).withColumn("pos", F.col("pos") + F.col("_off")).drop("_off")
    return out


def turn_digests(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """conv_id, pos (0, 1, ..), digest (of role and text), chars (code points of the text) of each turn.

    Turns are in order of their numbers, a null number first, and equal numbers in order of their digests; repeated
    rows are repeated turns. Null role or text count as empty. Rows without conv_id belong to no conversation and are
    left out. Ids and numbers must be whole numbers. Turns of one number are ranked in 256 parts, equal ones together.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    number = F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 63)))
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), number.alias("turn"), F.length(said).cast("long").alias("chars"),
        F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")).alias("digest"))
    rows = rows.where("conv_id is not null").groupBy("conv_id", "turn", "digest", "chars").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"far": F.shiftright("turn", 10), "near": F.col("turn"), "part": F.substring("digest", 1, 2)})
    ranked = _rank(rows, "conv_id", ["far", "near", "part"], "digest", "copies")
    return ranked.select("conv_id", F.explode(F.sequence("pos", F.col("pos") + F.col("copies") - 1)).alias("pos"), "digest", "chars")


def _digest(size: Column) -> Column:
    """Digest of the first `size` turns of a block."""
    return F.md5(F.array_join(F.slice("digests", F.lit(1), size), "").cast("binary"))


def _parts(size: Column) -> list[Column]:
    """What the block's first `size` turns add to the sums: a digest that the number of the block salts, in four parts."""
    salted = F.md5(F.concat(F.col("block").cast("string"), F.lit(":"), _digest(size)).cast("binary"))
    return [F.conv(F.substring(salted, 8 * i + 1, 8), 16, 10).cast("long") for i in range(len(SUMS))]


def _added(size: Column) -> list[Column]:
    """Sums with the block's first `size` turns added."""
    return [F.col(s) + p for s, p in zip(SUMS, _parts(size))]


def _key(sums: list[Column], depth: Column) -> Column:
    return F.md5(F.concat_ws(",", *[s.cast("string") for s in sums], depth.cast("string")).cast("binary"))


def _root() -> Column:
    return _key([F.lit(0)] * len(SUMS), F.lit(0))


def _blocks(turns: DataFrame, block: int, stretch: int) -> DataFrame:
    """conv_id, block, digests and chars of its turns, before (chars of earlier turns), sums of earlier blocks, path
    and parent (path of the block before)."""
    at = turns.where("pos is not null").withColumns({
        "block": F.floor(F.col("pos") / block), "stretch": F.floor(F.col("pos") / (block * stretch))})
    lists = F.array_sort(F.collect_list(F.struct("pos", "digest", "chars")))
    rows = (at.repartition("conv_id", "stretch").groupBy("conv_id", "stretch", "block").agg(lists.alias("steps"))
            .select("conv_id", "stretch", "block", F.col("steps.digest").alias("digests"), F.col("steps.chars").alias("chars")))
    rows = rows.withColumn("all_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumns({f"p{s}": v for s, v in zip(SUMS, _parts(F.size("digests")))})
    values = {"before": "all_chars", **{s: f"p{s}" for s in SUMS}}
    inside = _before(["block"], ["conv_id", "stretch"])
    within = rows.withColumns({name: _earlier(v, inside) for name, v in values.items()})
    totals = rows.groupBy("conv_id", "stretch").agg(*[F.sum(v).alias(v) for v in values.values()])
    across = _before(["stretch"], ["conv_id"])
    offsets = totals.select("conv_id", "stretch", *[_earlier(v, across).alias(f"off_{name}") for name, v in values.items()])
    rows = within.join(offsets, ["conv_id", "stretch"]).withColumns({name: F.col(name) + F.col(f"off_{name}") for name in values})
    depth = F.col("block") * block
    return rows.select("conv_id", "block", "digests", "chars", "all_chars", "before", *SUMS,
                       _key([F.col(s) for s in SUMS], depth).alias("parent"),
                       _key([F.col(s) + F.col(f"p{s}") for s in SUMS], depth + F.size("digests")).alias("path"))


def _opened(groups: DataFrame, block: int) -> DataFrame:
    """Turns of the distinct blocks: path, node, up (node before), depth, before, chars, n, owner, split (siblings diverge)."""
    several = groups.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("parent", F.lit(True).alias("split"))
    rows = groups.join(several, "parent", "left").withColumn("j", F.explode(F.sequence(F.lit(1), F.size("digests"))))
    depth = (F.col("block") * block + F.col("j")).cast("long")
    up = F.when(F.col("j") == 1, F.col("parent")).otherwise(_key(_added(F.col("j") - 1), depth - 1))
    earlier = F.aggregate(F.slice("chars", F.lit(1), F.col("j") - 1), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("path", _key(_added(F.col("j")), depth).alias("node"), up.alias("up"), depth.alias("depth"),
                       (F.col("before") + earlier).alias("before"), F.element_at("chars", F.col("j")).alias("chars"),
                       "n", "owner", F.coalesce("split", F.lit(False)).alias("split"))


def _by_node(steps: DataFrame, **values: Column) -> DataFrame:
    """Aggregates of the turns of diverging siblings by node; the other turns are nodes as they are."""
    fixed = ["up", "depth", "before"]
    names = list(values)
    grouped = steps.where("split").groupBy("node").agg(*[F.first(c).alias(c) for c in fixed], *[v.alias(n) for n, v in values.items()])
    alone = steps.where("not split").select("node", *fixed, *names)
    return grouped.select("node", *fixed, *names).unionByName(alone)


def prefix_trie(turns: DataFrame, block: int = BLOCK, stretch: int = STRETCH, width: int = ENDS) -> Trie:
    """Trie over turns (conv_id, pos from 0 without gaps, digest, chars); a row with null pos says that a conversation
    exists, also one without turns.

    A node is a distinct sequence of a conversation's first turns, from the root (depth 0) on. conv_id: its smallest member
    (conversations that begin so); parent_conv_id: that of the node before (null for the root); n_convs: members;
    n_children; n_leaves: nodes without children in its subtree, itself included; saved_tokens: over its subtree, the
    sum of (n_convs - 1) * chars of a node's last turn. Without conversations there is no node.
    """
    placed = cut(_blocks(turns, block, stretch))
    parts = ["parent", "block", "digests", "chars", "before", *SUMS]
    groups = placed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner"),
                                        *[F.first(p).alias(p) for p in parts])
    steps = cut(_opened(groups, block))
    ended = placed.groupBy("conv_id").agg(F.max_by("path", "block").alias("end"), F.max(F.col("before") + F.col("all_chars")).alias("total"))
    convs = turns.select("conv_id").distinct().join(ended, "conv_id", "left").select(
        "conv_id", F.coalesce("end", _root()).alias("node"), F.coalesce("total", F.lit(0)).alias("total"))

    none = F.lit(None)
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("owner")).where("n > 0").select(
        _root().alias("node"), none.cast("string").alias("up"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("before"), "n", "owner")
    nodes = _by_node(steps, n=F.sum("n"), owner=F.min("owner")).unionByName(root)
    children = nodes.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, "node", "left").fillna(0, ["n_children"]))

    owned = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min_by("before", "depth").alias("shared"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    members = convs.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaves", F.lit(0)).alias("leaves"))
    sums = placed.select("conv_id", "path").join(members, "conv_id").groupBy("path").agg(
        F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves"))
    whole = members.agg(F.sum("shared").alias("shared"), F.sum("leaves").alias("leaves")).select(_root().alias("node"), "shared", "leaves")
    below = _by_node(steps.join(sums, "path"), shared=F.sum("shared"), leaves=F.sum("leaves"))
    below = below.select("node", "shared", "leaves").unionByName(whole)

    of_owner = owned.select(F.col("conv_id").alias("owner"), F.col("shared").alias("own"))
    above = nodes.select(F.col("node").alias("up"), F.col("owner").alias("parent_conv_id"))
    saved = F.col("shared") - F.col("own") - (F.col("n") - 1) * F.col("before")
    out = nodes.join(below, "node").join(of_owner, "owner").join(above, "up", "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), "node")
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    ends = convs.groupBy("node", F.floor(F.col("conv_id") / width).alias("range")).agg(F.array_join(ids, ",").alias("ids"))
    return Trie(out, ends)


def ends_digest(ends: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the comma-joined ids that end at a node, read range by range and never joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if held is not None:
                        done.append((node, held.hexdigest()))
                    node, held = name, hashlib.sha256(ids.encode())
                else:
                    held.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in (0, 1)], names=["node", "ends_sha256"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (node, held.hexdigest())], names=["node", "ends_sha256"])

    rows = ends.repartition("node").sortWithinPartitions("node", "range").select("node", "ids")
    return rows.mapInArrow(run, "node string, ends_sha256 string")
