"""Jaccard self-join on word n-grams by prefix filters under several global token orders.

1. Token orders. Document frequencies of all shingles are counted over all documents; every order puts rarer shingles
   (by power of two) first and breaks ties by a hash of its own. Two sets that reach the threshold share a shingle
   among the first n - ceil(threshold n) + 1 of both, under every order. Most documents hold only unique shingles
   there and leave.
2. Equal sets are one node from here on.
3. Candidates share a prefix shingle under the first order and are kept if they do under every other order; only then
   are their sets compared. Components are wanted, so pairs inside one known component are never made: first each node
   is tried with the hub it shares most prefix shingles with, then with all its hubs (the first node of a prefix
   shingle and length class), and at last all remaining candidates of different components are.
4. Components of the links by label spreading with pointer jumping.

Documents are shuffled once. Shingles travel to their frequency count as 16-bit steps of sorted codes. Shingles of
different text are told apart by 64-bit hashes; the codes of the count may collide, which costs pruning, not results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factbase.llm.blocks import bucket_count, dealt, in_order, pack, unpack
from factbase.llm.storage import cut
from factbase.llm.words import Words, lean, lean_stream, mix, rolled

CODE = 26                # bits of a shingle beside its group: a bucket's share of shingles fills them to a hundredth
FEW = 200_000            # pairs whose ends may be broadcast (3 MB)
COUNTED = "target int, source int, once binary, more binary, counts binary"
NODE = "rid long, id long, n long, fa long, fb long, tokens binary, classes binary"


def _sets(bucket: pa.Table, k: int) -> tuple[list[np.ndarray], Words]:
    """The sorted shingle hashes of each text of a bucket."""
    words = Words(bucket.column("text"), lower=True)
    hashes = words.hashes()
    grams, whole = words.grams(hashes, k)
    first = words.first
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    grams[first[short]] = rolled(hashes, first[short], first[short + 1])
    whole[first[short]] = True
    out = [np.unique(grams[a:b][whole[a:b]]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return out, words


def _codes(tokens: np.ndarray, groups: int) -> np.ndarray:
    g = np.uint64(groups)
    return ((tokens % g) << np.uint64(CODE) | (tokens // g) & np.uint64((1 << CODE) - 1)).astype(np.int64)


def _parts(codes: np.ndarray) -> Iterator[tuple[int, slice]]:
    target = codes >> CODE
    heads = np.flatnonzero(np.diff(target, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(codes)]):
        yield int(target[a]), slice(a, b)


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _count(k: int, groups: int):
    def run(bucket: pa.Table) -> pa.Table:
        sets, _ = _sets(bucket, k)
        codes, n = np.unique(_codes(np.concatenate([*sets, np.zeros(0, np.uint64)]), groups), return_counts=True)
        source, low = bucket.column("bucket")[0].as_py(), (1 << CODE) - 1
        rows = []
        for target, s in _parts(codes):
            c, many = codes[s] & low, n[s] > 1
            rows.append((target, source, pack(c[~many]), pack(c[many]), np.minimum(n[s][many], 255).astype(np.uint8).tobytes()))
        return _rows(rows, COUNTED)
    return run


def _classes(group: pa.Table) -> pa.Table:
    """Of each source the codes in two or more documents, with the power of two of their frequency."""
    once = [unpack(x) for x in group.column("once").to_pylist()]
    more = [unpack(x) for x in group.column("more").to_pylist()]
    counts = [np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()]
    codes = np.concatenate([x for pair in zip(once, more) for x in pair])
    weights = np.concatenate([x for o, c in zip(once, counts) for x in (np.ones(len(o), np.int64), c)])
    _, which = np.unique(codes, return_inverse=True)
    total = np.bincount(which, weights=weights).astype(np.int64)[which]
    level = np.minimum(np.log2(np.maximum(total, 1)).astype(np.uint8), 60)
    rows, at, target = [], 0, group.column("target")[0].as_py()
    for source, o, m in zip(group.column("source").to_pylist(), once, more):
        c, v = codes[at: at + len(o) + len(m)], level[at: at + len(o) + len(m)]
        at += len(c)
        c, v = c[v > 0], v[v > 0]
        if len(c):
            order = np.argsort(c)
            rows.append((target, source, pack(c[order]), None, v[order].tobytes()))
    return _rows(rows, COUNTED)


def _nodes(k: int, groups: int, percent: int):
    def run(bucket: pa.Table, known: pa.Table) -> pa.Table:
        """All documents of a bucket; those that may have a partner with their set and the classes of its shingles."""
        if not bucket.num_rows:
            return _rows([], NODE)
        source, bucket = bucket.column("bucket")[0].as_py(), in_order(bucket)
        sets, _ = _sets(bucket, k)
        codes = np.concatenate([np.zeros(0, np.int64), *[(t << CODE) | unpack(c) for t, c in
                                zip(known.column("target").to_pylist(), known.column("once").to_pylist())]])
        level = np.frombuffer(b"".join(known.column("counts").to_pylist()), np.uint8)
        order = np.argsort(codes)
        codes, level = codes[order], level[order]
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        mine = _codes(tokens, groups)
        classes = np.zeros(len(tokens), np.uint8)
        if len(codes):
            at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
            classes = np.where(codes[at] == mine, level[at], 0).astype(np.uint8)
        prints = [mix(tokens ^ np.uint64(x)) for x in (0x1234567, 0x89ABCDE)]
        rows, a = [], 0
        for i, (key, s) in enumerate(zip(bucket.column("id").to_pylist(), sets)):
            n, c = len(s), classes[a: a + len(s)]
            prefix = n - -(-n * percent // 100) + 1
            stays = n > 0 and int((c == 0).sum()) < prefix
            fa, fb = (int(p[a: a + n].sum().astype(np.int64)) for p in prints) if n else (0, 0)
            rows.append((source << 32 | i, key, n, fa, fb, s.tobytes() if stays else None, c.tobytes() if stays else None))
            a += n
        return _rows(rows, NODE)
    return run


def _prefixes(percent: int, orders: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefix shingles of each node under each order that occur in other documents."""
        for batch in batches:
            out = [(np.zeros(0, np.int8), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4)]
            for rid, raw, kinds in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                tokens, classes = np.frombuffer(raw, "<u8"), np.frombuffer(kinds, np.uint8)
                n = len(tokens)
                size, alone = n - -(-n * percent // 100) + 1, int((classes == 0).sum())
                for k in range(orders):
                    first = np.lexsort((mix(tokens ^ np.uint64(k + 1)), classes))[alone:size]
                    m = len(first)
                    out.append((np.full(m, k, np.int8), tokens[first], np.full(m, rid), np.full(m, n), np.arange(alone, size),
                                np.full(m, alone)))
            k, token, *numbers = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int8()), pa.array(token.astype(np.int64)), *map(pa.array, numbers)],
                                             names=["k", "token", "rid", "n", "at", "alone"])
    return run


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = batch.columns
            hit = []
            for x, y in zip(left, right):
                s, t = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                hit.append(100 * common >= percent * (len(s) + len(t) - common))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])
    return run


def _may_link(percent: int, one: str = "", other: str = "2"):
    """Sizes that allow the threshold, and places of a shared shingle from which on enough of both sets is left."""
    n, m, at, to = (F.col(c) for c in (f"n{one}", f"n{other}", f"at{one}", f"at{other}"))
    common = F.ceil((n + m) * percent / (100 + percent))  # shingles that a pair must share
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (at <= n - common) & (to <= m - common)


def _links(pairs: DataFrame, tokens: DataFrame, prefixes: DataFrame, orders: int, percent: int) -> DataFrame:
    """The pairs (a, b) that share a prefix shingle under all orders and reach the threshold."""
    for k in range(1, orders):
        mine = prefixes.where(F.col("k") == k)
        left = mine.select("token", F.col("rid").alias("a"), "n", "at")
        right = mine.select("token", F.col("rid").alias("b"), F.col("n").alias("n2"), F.col("at").alias("at2"))
        pairs = pairs.join(left, "a").join(right, ["b", "token"]).where(_may_link(percent)).select("a", "b").distinct()
    pairs = cut(pairs)
    few = pairs.count() <= FEW
    hint = F.broadcast if few else (lambda df: df)  # few pairs need not shuffle all sets
    left = tokens.join(hint(pairs), tokens["rid"] == pairs["a"]).select("a", "b", F.col("tokens").alias("left"))
    ends = hint(pairs.select(F.col("b").alias("rid")).distinct())
    right = tokens.join(ends, "rid", "left_semi").select(F.col("rid").alias("b"), F.col("tokens").alias("right"))
    return cut(left.join(right, "b").select("a", "b", "left", "right").mapInArrow(lean_stream(_compare(percent)), "a long, b long"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """rid, label (the smallest rid that links reach) of all nodes."""
    edges = cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("rid"), F.col("b").alias("to")),
                                               F.struct(F.col("b").alias("rid"), F.col("a").alias("to")))).alias("e"))
                .select("e.*").distinct())
    linked = edges.groupBy("rid").agg(F.min("to").alias("label")).select("rid", F.least("rid", "label").alias("label"))
    while True:
        near = (edges.join(linked.withColumnRenamed("rid", "to"), "to").groupBy("rid").agg(F.min("label").alias("near")))
        step = linked.join(near, "rid").select("rid", F.least("label", "near").alias("next"), "label")
        jump = step.select(F.col("rid").alias("next"), F.col("next").alias("far"))
        step = cut(step.join(jump, "next").select("rid", F.least("next", "far").alias("next"), "label"))
        done = step.where("next != label").isEmpty()
        linked = step.select("rid", F.col("next").alias("label"))
        if done:
            break
    return nodes.join(linked, "rid", "left").select("rid", F.coalesce("label", "rid").alias("label"))


def _grouped(docs: DataFrame, k: int, percent: int, orders: int, id_col: str, text: str) -> DataFrame:
    """id, rid, n_shingles, component_id, group_size, is_first of every row."""
    n = bucket_count(docs, text)
    buckets = dealt(docs, n, [], id_col, text)
    by_bucket = buckets.groupBy("bucket")
    counted = by_bucket.applyInArrow(lean(_count(k, n)), COUNTED)
    known = counted.groupBy("target").applyInArrow(lean(_classes), COUNTED)
    nodes = cut(by_bucket.cogroup(known.groupBy("source")).applyInArrow(lean(_nodes(k, n, percent)), NODE))

    stay = nodes.where("tokens is not null")
    equal = ["fa", "fb", "n"]
    reps = stay.groupBy(*equal).agg(F.min("rid").alias("rep"))
    members = nodes.select("rid", "id", *equal).join(reps, equal, "left").select(
        "rid", "id", "n", F.coalesce("rep", "rid").alias("rep"))
    members = cut(members)
    tokens = stay.select("rid", "tokens")
    prefixes = stay.select("rid", "tokens", "classes").mapInArrow(
        lean_stream(_prefixes(percent, orders)), "k byte, token long, rid long, n long, at long, alone long")
    prefixes = cut(prefixes.join(members.where("rid = rep").select("rid"), "rid", "left_semi"))

    # a: a node, b: the hub of a prefix shingle and length class, the set with the fewest shingles of its own
    first = prefixes.where("k = 0").withColumn("size", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)))
    hubs = (first.groupBy("token", "size").agg(F.min(F.struct("alone", "rid", "n", "at")).alias("hub"), F.count("*").alias("many"))
            .where("many > 1").select("token", "size", F.col("hub.rid").alias("b"), F.col("hub.n").alias("n2"), F.col("hub.at").alias("at2")))
    stars = cut(first.withColumnRenamed("rid", "a").join(hubs, ["token", "size"]).where("a != b").where(_may_link(percent))
                .groupBy("a", "b").agg(F.count("*").alias("shared")))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b"))
    links = _links(best, tokens, prefixes, orders, percent)
    ends = prefixes.where("k = 0").select("rid").distinct()
    labels = cut(components(ends, links))

    def apart(pairs: DataFrame) -> DataFrame:
        one = pairs.join(labels.select(F.col("rid").alias("a"), F.col("label").alias("la")), "a")
        return one.join(labels.select(F.col("rid").alias("b"), F.col("label").alias("lb")), "b").where("la != lb").select("a", "b")

    rest = apart(stars.select("a", "b")).join(best, ["a", "b"], "left_anti")
    more = _links(rest, tokens, prefixes, orders, percent)
    links = cut(links.union(more))
    labels = cut(components(ends, links))
    placed = first.select("token", "rid", "n", "at").join(labels, "rid")
    mixed = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
    placed = placed.join(mixed, "token")
    other = placed.select("token", *[F.col(c).alias(f"{c}2") for c in ("rid", "n", "at", "label")])
    pairs = (placed.join(other, "token").where("label < label2").where(_may_link(percent))
             .select(F.col("rid").alias("a"), F.col("rid2").alias("b")).distinct())
    tried = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    last = _links(pairs.join(tried, ["a", "b"], "left_anti"), tokens, prefixes, orders, percent)
    if not last.isEmpty():
        labels = cut(components(ends, links.union(last)))

    named = members.join(labels.withColumnRenamed("rid", "rep"), "rep", "left").select(
        "rid", "id", "n", F.coalesce("label", "rep").alias("label"))
    groups = named.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("group_size"),
                                        F.min_by("rid", F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))).alias("head"))
    return named.join(groups, "label").select("id", "rid", F.col("n").alias("n_shingles"), "component_id", "group_size",
                                              (F.col("rid") == F.col("head")).alias("is_first"))


def similar_groups(docs: DataFrame, k: int = 5, percent: int = 80, orders: int = 3, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id (smallest id of its component), group_size, is_first of every row.

    Rows link when 100 x common >= percent x all of their distinct shingles of k words (A-Z lower-cased, words are runs
    of bytes other than ASCII white space); a text of fewer words is one shingle, one without words or null has none
    and is alone. Rows with equal ids stay rows and link like others. Null ids never name a component: one without any
    id is named null. is_first marks one row of each component: of its smallest id, or any one row where ids repeat.
    """
    return _grouped(docs, k, percent, orders, id_col, text).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", "group_size", "is_first")


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80, orders: int = 3, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns."""
    heads = _grouped(docs, k, percent, orders, id_col, text).where("is_first").select(
        F.shiftright("rid", 32).cast("int").alias("source"), F.col("rid").bitwiseAND((1 << 32) - 1).alias("at"))
    buckets = dealt(docs, bucket_count(docs, text), docs.columns, id_col, text)
    names = docs.columns

    def run(bucket: pa.Table, first: pa.Table) -> pa.Table:
        bucket = in_order(bucket).take(first.column("at").combine_chunks().sort())
        return bucket.select([f"k{i}" for i in range(len(names))]).rename_columns(names)

    return buckets.groupBy("bucket").cogroup(heads.groupBy("source")).applyInArrow(lean(run), docs.schema)
