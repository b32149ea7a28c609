"""Benchmark decontamination by spaced seeds.

A mask covers SPAN words and ignores some of them; the hash of the others finds places where a training text and a
benchmark item agree in spite of substituted words. Hits are verified along their diagonal: the best stretch of
aligned words, with one point for an equal word and PENALTY off for another one, must hold enough equal words.

No accepted stretch lacks a seed: the best stretch never falls below zero points on its way, so its k-th unequal word
stands behind at least PENALTY x k equal ones, and `cover` gives masks that between them avoid every such set of
unequal words at the stretch's start.

The benchmark is turned into seed tables of at most BLOCK_WORDS words each (16 bytes for each word and mask), which are
broadcast; a larger benchmark is several tables, one after the other. Documents are read without a shuffle, STEP bytes
at a time.
"""

from __future__ import annotations

from collections import defaultdict
import pickle
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factbase.llm.words import Words, lean_stream, mix, pieces, rolled, runs

SPAN, WEIGHT = 11, 6  # words under a mask, and how many of them are compared
PENALTY = 2
BLOCK_WORDS = 1_000_000
STEP = 2 << 20
FILTER_BITS = 24
HITS = 1 << 21          # hits, or words on their diagonals, that are looked at together
_WEIGHTS = mix(np.arange(1001, 1001 + SPAN, dtype=np.uint64)) | np.uint64(1)
MATCH = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in (
    "item_id", "n_matched", "n_aligned", "doc_start", "doc_end", "item_start")]))


def cover(span: int, weight: int) -> tuple[str, ...]:
    """Masks of `weight` ones such that one of them ignores every unequal word in the first `span` words of any stretch."""
    sets: list[frozenset] = []

    def grow(held: tuple[int, ...]) -> None:
        low = max((PENALTY + 1) * len(held) + PENALTY, held[-1] + 1 if held else 0)
        for i in range(low, span):
            grow((*held, i))
        if low >= span:
            sets.append(frozenset(held))

    grow(())
    always = tuple(range(min(PENALTY, span)))  # a stretch begins with equal words
    left = set(range(len(sets)))
    avoids = [(ones, {k for k in left if not sets[k].intersection(ones)})
              for ones in (always + c for c in combinations(range(len(always), span), weight - len(always)))]
    out = []
    while left:
        ones, most = max(avoids, key=lambda x: len(x[1] & left))
        if not most & left:
            raise ValueError("no masks of this weight")
        left -= most
        out.append("".join("01"[i in ones] for i in range(span)))
    return tuple(out)


MASKS = cover(SPAN, WEIGHT)


def _masks(at_least: int) -> tuple[str, ...]:
    """Stretches may be as short as `at_least` words."""
    if at_least >= SPAN:
        return MASKS
    span = max(1, at_least)
    return cover(span, span - (span + 1) // (PENALTY + 1))


def _seeds(words: Words, hashes: np.ndarray, masks: tuple[str, ...], short: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) for each mask, then for each length of items that are shorter than a mask."""
    n, span = len(hashes), len(masks[0])
    room = np.repeat(words.first[1:], words.counts) - np.arange(n)
    at = np.flatnonzero(room >= span)
    for k, mask in enumerate(masks):
        code = np.zeros(max(0, n - span + 1), np.uint64)
        for j in (j for j, c in enumerate(mask) if c == "1"):
            code += hashes[j: j + len(code)] * _WEIGHTS[j]
        yield at, mix(code[at] + np.uint64(k))
    for size in short:
        at = np.flatnonzero(room >= size)
        yield at, rolled(hashes, at, at + size) + np.uint64(size)


class SeedTable:
    """Seeds of benchmark items: sorted hashes with item and place, a bit filter before them, words of the items."""

    def __init__(self, ids: list[int], texts: list[str], at_least: int = 12):
        words = Words(pa.array(texts, pa.string()), plain=True)
        self.ids, self.first, self.hashes = np.array(ids, np.int64), words.first, words.hashes()
        sizes = words.counts
        self.masks = _masks(at_least)
        self.short = sorted(set(sizes[(sizes > 0) & (sizes < len(self.masks[0]))].tolist()))
        places, codes = [], []
        for i, (at, code) in enumerate(_seeds(words, self.hashes, self.masks, self.short)):
            if i >= len(self.masks):  # whole short items only
                whole = np.isin(at, words.first[:-1][sizes == self.short[i - len(self.masks)]])
                at, code = at[whole], code[whole]
            places.append(at)
            codes.append(code)
        place, code = np.concatenate(places), np.concatenate(codes)
        order = np.argsort(code, kind="stable")
        self.code, self.place = code[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def hits(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a word's place in the texts and one in the items with equal seeds, about HITS at a time."""
        for at, code in _seeds(words, hashes, self.masks, self.short):
            some = np.flatnonzero(self.filter[(code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
            at, code = at[some], code[some]
            low, high = np.searchsorted(self.code, code), np.searchsorted(self.code, code, "right")
            for a, b in _parts(high - low):
                n = (high - low)[a:b]
                yield np.repeat(at[a:b], n), self.place[runs(low[a:b], n)]


def _parts(sizes: np.ndarray, most: int = HITS) -> Iterator[tuple[int, int]]:
    """Runs of entries whose sizes add up to about `most`; one larger entry stands alone. None where all are 0."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes) and ends[-1] > (done := ends[at - 1] if at else 0):
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield at, to
        at = to


def _stretch(equal: np.ndarray) -> tuple[int, int]:
    """The stretch with the most points, the first of equals: start, end."""
    points = np.concatenate([[0], np.cumsum(np.where(equal, 1, -PENALTY))])
    low = np.minimum.accumulate(points)
    end = int(np.argmax(points - low))
    return int(np.argmin(points[: end + 1])), end


def _diagonals(table: SeedTable, words: Words, hashes: np.ndarray, at_least: int) -> set[tuple[int, int, int]]:
    """(text, item, shift) of all hits whose diagonals hold enough equal words for a match."""
    out: set[tuple[int, int, int]] = set()
    sizes = np.diff(table.first)
    for mine, theirs in table.hits(words, hashes):
        doc = np.searchsorted(words.first, mine, "right") - 1
        item = np.searchsorted(table.first, theirs, "right") - 1
        shift = (mine - words.first[doc]) - (theirs - table.first[item])
        order = np.lexsort((shift, item, doc))
        doc, item, shift = doc[order], item[order], shift[order]
        new = np.ones(len(doc), bool)
        new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(shift) != 0)
        doc, item, shift = doc[new], item[new], shift[new]
        low = np.maximum(0, -shift)  # places in the item
        n = np.minimum(sizes[item], words.counts[doc] - shift) - low
        a, x = words.first[doc] + shift + low, table.first[item] + low
        for i, j in _parts(n):
            equal = hashes[runs(a[i:j], n[i:j])] == table.hashes[runs(x[i:j], n[i:j])]
            total = np.add.reduceat(equal, np.cumsum(n[i:j]) - n[i:j], dtype=np.int64)
            good = i + np.flatnonzero(total >= np.minimum(at_least, sizes[item[i:j]]))
            out.update(zip(doc[good].tolist(), item[good].tolist(), shift[good].tolist()))
    return out


def _verified(table: SeedTable, words: Words, hashes: np.ndarray, at_least: int) -> list[list[tuple]]:
    out: list[dict] = [defaultdict(tuple) for _ in words.counts]
    for d, i, s in _diagonals(table, words, hashes, at_least):
        a, b = words.first[d: d + 2]
        x, y = table.first[i: i + 2]
        low, high = max(0, -s), min(y - x, b - a - s)
        equal = hashes[a + s + low: a + s + high] == table.hashes[x + low: x + high]
        start, end = _stretch(equal)
        n = int(equal[start:end].sum())
        if n >= min(at_least, y - x):
            found = (n, -(end - start), -(s + low + start), -int(low + start))
            key = int(table.ids[i])
            out[d][key] = max(out[d][key], found)
    return [[(key, n, -size, -at, -at - size, -place) for key, (n, size, at, place) in sorted(found.items())] for found in out]


def find_overlaps(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", at_least: int = 12,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """`keep` columns (doc_id) of each row and matches: the benchmark items that it overlaps.

    Words are compared in lower case (A-Z) and without ASCII punctuation. A match has the item's id, its equal words,
    the words of its stretch, the stretch in the text (doc_start to doc_end, counted in such words) and its start in
    the item; of several stretches of one item the one with most equal words counts, then the longest, then the first.
    It takes `at_least` equal words, or the whole item where that is shorter. Null or empty texts and items match
    nothing, nor do items with a null id; items of one id are one item. Repeated rows stay rows.
    """
    keep = ["doc_id"] if keep is None else keep
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    total = items.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = -(-total // block_words)
    rest = [c for c in keep if c != text]  # the text goes through the tasks once
    names = [f"k{i}" for i in range(len(rest))]
    out = docs.select(*[F.col(c).alias(n) for c, n in zip(rest, names)], F.col(text).alias("text"),
                      F.array().cast(MATCH).alias("matches"))
    schema = out.schema
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().orderBy("i", "t").collect()
        # as bytes: a broadcast object would name its class, which executors without the package do not know
        seeds = cloudpickle.dumps(SeedTable([r["i"] for r in rows], [r["t"] for r in rows], at_least))
        held = docs.sparkSession.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            table = pickle.loads(held.value)
            for batch in batches:
                for a, b in pieces(batch.column(len(names)), STEP):
                    part = batch.slice(a, b - a)
                    words = Words(part.column(len(names)), plain=True)
                    found = _verified(table, words, words.hashes(), at_least)
                    had = part.column(len(names) + 1)
                    if any(found) or sum(map(len, had)):
                        fields = MATCH.elementType.names
                        kind = pa.list_(pa.struct([(f, pa.int64()) for f in fields]))
                        had = pa.array([(x or []) + [dict(zip(fields, m)) for m in y] for x, y in zip(had.to_pylist(), found)], kind)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], had], names=[*names, "text", "matches"])

        out = out.mapInArrow(lean_stream(run), schema)
    at = {**dict(zip(rest, names)), text: "text"}
    return out.select(*[F.col(at[c]).alias(c) for c in keep], "matches")
