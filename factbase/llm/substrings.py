"""Removal of word sequences that occur earlier, by partitioned suffix trees.

The suffixes of all texts (from each word on) are split into groups that fit into memory, and each group builds the
tree of its suffixes down to WINDOW words: suffixes sorted by their words, common prefixes of neighbours, and the
internal nodes of that depth. Such a node is a repeat, its leaves are the places.

1. Census. A suffix is filed under the ANCHOR-word gram with the smallest hash among those inside its first `window`
   words, so equal windows share their gram and neighbouring suffixes mostly file under the same one: about a seventh
   of all positions is counted, exactly. A gram that occurs once leads to no internal node; its suffixes go no further.
2. Keys of variable length. The others are sent to the group of their gram; those under a gram with more than SPLIT
   occurrences are filed under a longer key, their first `window` words, so a frequent gram is spread over all groups.
   Each bucket of documents sends the earliest leaf of a node only, and settles its later ones itself.
3. Trees. Neighbouring suffixes travel as one stretch of word hashes. A group orders its suffixes by doubling (ranks of
   runs of 1, 2, 4, .. words), reads the common prefix of each two neighbours off the same ranks, and takes the nodes of
   depth `window`: runs of leaves whose neighbours share so many words. Every leaf but the earliest is marked. Marked
   neighbours join to maximal repeats.

Documents are shuffled once (the same exchange serves all three reads). Words are known by 64-bit hashes in the trees;
inside a bucket, grams and windows by 64-bit fingerprints each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factbase.llm.blocks import bucket_count, dealt, ids_of, in_order, pack, strings, unpack
from factbase.llm.words import Words, lean, pieces, runs

ANCHOR = 8
SPLIT = 100_000
CODE = 24                 # bits of a gram that the census keeps beside its group
_PLACE = 27               # bits for a word's place in its bucket
_HEAD = np.dtype([("id", "<i8"), ("at", "<u4"), ("n", "<u2")])  # a stretch: n suffixes that begin at word `at` and after
_MOST = 255               # a count above it takes several entries of its code


def _anchors(words: Words, hashes: np.ndarray, window: int, anchor: int):
    """Windows (first word), the place of each one's anchor gram, and the gram from each word on."""
    grams, whole = words.grams(hashes, anchor)
    n = len(grams)
    if n >> _PLACE:
        raise ValueError("a bucket holds too many words")
    room = np.repeat(words.first[1:], words.counts) - np.arange(n) >= window
    low = np.uint64((1 << _PLACE) - 1)
    least = np.where(whole, (grams & ~low) | np.arange(n, dtype=np.uint64), ~np.uint64(0))
    width, want = 1, window - anchor + 1
    while width < want:
        step = min(width, want - width)
        shifted = np.full(n, ~np.uint64(0))
        if step < n:
            shifted[: n - step] = least[step:]
        least = np.minimum(least, shifted)
        width += step
    starts = np.flatnonzero(room)
    return starts, (least[starts] & low).astype(np.int64), grams


def _codes(grams: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    return (grams % np.uint64(groups)).astype(np.int64), (grams // np.uint64(groups) & np.uint64((1 << CODE) - 1)).astype(np.int64)


def _split(target: np.ndarray):
    """(target, rows) of each target in sorted target numbers."""
    heads = np.flatnonzero(np.diff(target, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(target)]):
        yield int(target[a]), slice(a, b)


def _table(schema: str, *columns) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


COUNTED = "target int, source int, codes binary, counts binary"
SENT = "target int, source int, heads binary, stretches binary, marks binary"


def _census(window: int, anchor: int, groups: int):
    def run(bucket: pa.Table) -> pa.Table:
        words = Words(in_order(bucket).column("text"))
        _, place, grams = _anchors(words, words.hashes(), window, anchor)
        group, code = _codes(grams[np.unique(place)], groups)
        both, count = np.unique(group << CODE | code, return_counts=True)
        entries = -(-count // _MOST)
        last = np.cumsum(entries) - 1
        parts = np.full(int(entries.sum()), _MOST, np.uint8)
        parts[last] = count - (entries - 1) * _MOST
        both, count = np.repeat(both, entries), parts
        group, code = both >> CODE, both & ((1 << CODE) - 1)
        rows = [(g, pack(code[s]), count[s].tobytes()) for g, s in _split(group)]
        source = bucket.column("bucket")[0].as_py()
        return _table(COUNTED, [r[0] for r in rows], [source] * len(rows), [r[1] for r in rows], [r[2] for r in rows])
    return run


def _frequent(split: int):
    def run(group: pa.Table) -> pa.Table:
        """Of each source its codes that occur more than once, with 1 where they are very frequent."""
        codes = [unpack(x) for x in group.column("codes").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint8) for x in group.column("counts").to_pylist()]).astype(np.int64)
        _, which = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(which, weights=counts).astype(np.int64)[which]
        ends = np.cumsum([len(c) for c in codes])
        rows = []
        for source, c, b in zip(group.column("source").to_pylist(), codes, ends.tolist()):
            mine = total[b - len(c): b]
            keep = mine > 1
            if keep.any():
                rows.append((source, pack(c[keep]), (mine[keep] > split).astype(np.uint8).tobytes()))
        target = group.column("target")[0].as_py()
        return _table(COUNTED, [target] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
    return run


def _leaves(window: int, anchor: int, groups: int):
    def run(bucket: pa.Table, known: pa.Table) -> pa.Table:
        """The earliest suffix of each window whose gram is repeated goes to its group; later ones are marked."""
        if not bucket.num_rows or not known.num_rows:
            return _table(SENT, [], [], [], [], [])
        bucket = in_order(bucket)
        source, ids = bucket.column("bucket")[0].as_py(), ids_of(bucket)
        words = Words(bucket.column("text"))
        hashes = words.hashes()
        starts, place, grams = _anchors(words, hashes, window, anchor)
        repeated = np.concatenate([(t << CODE) | unpack(c) for t, c in
                                   zip(known.column("target").to_pylist(), known.column("codes").to_pylist())])
        hot = np.concatenate([np.frombuffer(x, np.uint8) for x in known.column("counts").to_pylist()])
        order = np.argsort(repeated)
        repeated, hot = repeated[order], hot[order]
        group, code = _codes(grams[place], groups)
        full = group << CODE | code
        found = np.minimum(np.searchsorted(repeated, full), len(repeated) - 1)
        some = np.flatnonzero(repeated[found] == full)
        starts, place, group, hot = starts[some], place[some], group[some], hot[found[some]] > 0
        marks_, print_ = starts[:0], words.grams(hashes, window)[0][starts]
        gram = grams[place]
        order = np.argsort(print_, kind="stable")  # the earliest first in each run
        later = np.zeros(len(order), bool)
        later[1:] = (print_[order][1:] == print_[order][:-1]) & (gram[order][1:] == gram[order][:-1])
        marks_ = np.sort(starts[order[later]])
        first = np.ones(len(order), bool)
        first[order[later]] = False
        starts, place, gram, print_, group, hot = (x[first] for x in (starts, place, gram, print_, group, hot))
        group = np.where(hot, (print_ % np.uint64(groups)).astype(np.int64), group)
        fresh = np.ones(len(starts), bool)  # a stretch for each anchor, or for each window under a frequent gram
        fresh[1:] = (np.diff(place) != 0) | (np.diff(starts) != 1) | hot[1:]
        heads = np.flatnonzero(fresh)
        order = np.argsort(group[heads], kind="stable")
        size = np.diff(np.append(heads, len(starts)))[order]
        heads = heads[order]
        head = np.zeros(len(heads), _HEAD)
        head["at"], head["n"] = starts[heads], size
        head["id"] = ids[np.searchsorted(words.first, starts[heads], "right") - 1]
        long = size + window - 1
        rows = []
        for g, s in _split(group[heads]):
            stretch = hashes[runs(starts[heads[s]], long[s])]
            rows.append((g, head[s].tobytes(), stretch.astype("<u8").tobytes(), None))
        rows.append((source % groups, None, None, pack(marks_)))
        return _table(SENT, [r[0] for r in rows], [source] * len(rows), *[[r[i] for r in rows] for i in (1, 2, 3)])
    return run


def suffix_order(text: np.ndarray, suffixes: np.ndarray, window: int, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes of `text` (places that have `window` words from there on) by their first `window` words,
    then by `ties`, and of each two neighbours in that order the length of the common prefix, `window` at most.

    Ranks of runs of 1, 2, 4, .. words come from the ranks of their halves; a run that crosses the end of a stretch has
    a rank too, but no suffix looks at it.
    """
    rank = np.unique(text, return_inverse=True)[1].astype(np.int32)
    ranks, width = [(1, rank)], 1
    while 2 * width <= window:
        half = np.zeros(len(rank), np.int64)
        half[: len(rank) - width] = rank[width:]
        rank = np.unique((rank.astype(np.int64) << 32) | half, return_inverse=True)[1].astype(np.int32)
        width *= 2
        ranks.append((width, rank))
    order = np.lexsort((*reversed(ties), rank[suffixes + window - width], rank[suffixes]))
    left, right = suffixes[order[:-1]], suffixes[order[1:]]
    common = np.zeros(len(left), np.int64)
    for width, rank in reversed(ranks):
        room = np.minimum(common, window - width)  # without room for the whole run nothing is added
        common += width * ((room == common) & (rank[left + room] == rank[right + room]))
    return order, common


def _nodes(window: int):
    def run(group: pa.Table) -> pa.Table:
        """Marks of each source: all leaves of a node of depth `window` but the earliest."""
        rows = [(x["source"], x["marks"]) for x in group.select(["source", "marks"]).to_pylist() if x["marks"]]
        trees = group.filter(pa.compute.is_valid(group.column("heads")))
        if trees.num_rows:
            heads = [np.frombuffer(x, _HEAD) for x in trees.column("heads").to_pylist()]
            source = np.repeat(np.array(trees.column("source").to_pylist(), np.int64), [int(h["n"].sum()) for h in heads])
            head = np.concatenate(heads)
            text = np.concatenate([np.frombuffer(x, "<u8") for x in trees.column("stretches").to_pylist()])
            n = head["n"].astype(np.int64)
            long = n + window - 1
            at, ids = runs(head["at"].astype(np.int64), n), np.repeat(head["id"], n)
            order, common = suffix_order(text, runs(np.cumsum(long) - long, n), window, ids, source, at)
            later = order[1:][common == window]  # in a node the earliest leaf is the first one
            later = later[np.lexsort((at[later], source[later]))]
            rows += [(s, pack(at[later[x]])) for s, x in _split(source[later])]
        return _table("source int, marks binary", [r[0] for r in rows], [r[1] for r in rows])
    return run


def _kept(window: int, as_is: bool, names: list[str], kinds: list):
    def run(bucket: pa.Table, marked: pa.Table) -> pa.Table:
        bucket = in_order(bucket)
        words = Words(bucket.column("text"))
        n = len(words.start)
        edge = np.zeros(n + 1, np.int64)
        for raw in marked.column("marks").to_pylist():
            at = unpack(raw)
            edge[at] += 1
            edge[at + window] -= 1
        gone = np.cumsum(edge)[:n] > 0
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
        # the kept words, each followed by a space; the last space of a text is left out
        parts, sizes = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for a, b in pieces(bucket.column("text"), 1 << 19):
            low, high = words.first[a], words.first[b]
            kept = low + np.flatnonzero(~gone[low:high])
            size = words.end[kept] - words.start[kept] + 1
            place = runs(words.start[kept], size)
            last = np.cumsum(size) - 1
            data = words.data[np.minimum(place, len(words.data) - 1)] if len(place) else parts[0]
            data[last] = 32
            first = np.searchsorted(kept, words.first[a: b + 1])
            ends = np.concatenate([[0], last + 1])[first]
            full = np.diff(first) > 0
            parts.append(np.delete(data, ends[1:][full] - 1))
            sizes.append(np.diff(ends) - full)
        text = strings(np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]))
        if as_is:
            text = pa.compute.if_else(pa.array(removed == 0), bucket.column("text").combine_chunks().cast(pa.string()), text)
        edges = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        inside = words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < n)]
        both = np.unique(inside[gone[inside] & gone[inside - 1]]) if n else inside  # a run ends with its text
        starts, stops = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([stops, both]))
        owner = np.searchsorted(words.first, starts, "right") - 1
        span = pa.StructArray.from_arrays([pa.array(starts - words.first[owner], pa.int64()),
                                           pa.array(stops - words.first[owner], pa.int64())], names=["start", "end"])
        places = pa.array(np.searchsorted(owner, np.arange(len(words.counts) + 1)), pa.int32())
        return pa.table([*[bucket.column(f"k{i}").cast(k) for i, k in enumerate(kinds)], pa.array(words.counts, pa.int64()),
                         pa.array(removed, pa.int64()), text, pa.ListArray.from_arrays(places, span)],
                        names=[*names, "n_words", "n_removed", "kept", "spans"])
    return run


def remove_repeats(docs: DataFrame, window: int = 20, keep: list[str] | None = None, id_col: str = "doc_id",
                   text: str = "text", anchor: int = ANCHOR, split: int = SPLIT, as_is: bool = False) -> DataFrame:
    """`keep` columns (id_col) of each row, n_words, n_removed, kept (text), spans (removed words, start to end).

    A word is removed when a window of `window` words covers it whose word sequence also starts earlier: in a row of
    smaller id or earlier in the same row. Rows of one id and null ids (after all others) have a fixed order of their
    own, so of wholly equal rows one keeps its words. Words are runs of other bytes than ASCII white space; kept words
    are joined by one space (`as_is`: texts that lose nothing stay as they are). A null text has no words and gives an
    empty text; texts with fewer words than a window lose nothing. Ids must be whole numbers.
    """
    keep = [id_col] if keep is None else keep
    if not anchor <= window <= anchor + 255:
        raise ValueError("anchor <= window <= anchor + 255")
    from pyspark.sql.pandas.types import to_arrow_type
    n = bucket_count(docs, text)
    buckets = dealt(docs, n, keep, id_col, text)
    by_bucket = buckets.groupBy("bucket")
    counted = by_bucket.applyInArrow(lean(_census(window, anchor, n)), COUNTED)
    known = counted.groupBy("target").applyInArrow(lean(_frequent(split)), COUNTED)
    sent = by_bucket.cogroup(known.groupBy("source")).applyInArrow(lean(_leaves(window, anchor, n)), SENT)
    marked = sent.groupBy("target").applyInArrow(lean(_nodes(window)), "source int, marks binary")
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept", T.StringType()), T.StructField("spans", span)])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    return by_bucket.cogroup(marked.groupBy("source")).applyInArrow(lean(_kept(window, as_is, keep, kinds)), schema)
