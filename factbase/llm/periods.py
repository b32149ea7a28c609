"""Periodic runs of words by recursive frequency splitting, and texts without their repetitions.

A word of a run that holds its period at least REPEATS times occurs REPEATS times in it. So a word that occurs less
often inside the segment looked at splits the segment, and what is left on both sides is counted anew by itself, until
no word is too rare; segments shorter than a run vanish. Surviving segments are scanned lag by lag: for each lag q,
neighbouring blocks of q words, at multiples of q, are compared by exact names of their windows of 2 ** j words. Blocks that are
equal and have no shorter period of their own lie in a run of period q, and the words around them are compared at
distance q to find its ends. All lags together take m log m comparisons for a segment of m words.

The work is narrow: no shuffle, and a task holds about STEP bytes of text (or one longer text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factbase.llm.blocks import strings
from factbase.llm.words import _SPACE, Words, lean_stream, pieces, runs

STEP = 4 << 20
REPEATS, SHORTEST = 3, 24  # a run holds its period this often, and has this many words
PAIRS = 1 << 20            # pairs of blocks compared at a time


def word_numbers(words: Words) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)])
    said = strings(words.data[~_SPACE[words.data]], ends, pa.binary())
    return said.dictionary_encode().indices.to_numpy(zero_copy_only=False)


def segments(numbers: np.ndarray, first: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Stretches (start, end) in which every word occurs at least `repeats` times; none crosses a text's border."""
    if not len(numbers):
        return []
    often = np.bincount(numbers) >= repeats
    at = np.flatnonzero(often[numbers])
    owner = (np.repeat(np.arange(len(first) - 1), np.diff(first)))[at]
    while len(at):
        begins = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(owner) > 0)])
        owner = np.cumsum(begins) - 1
        long = np.bincount(owner) >= shortest
        at, owner = at[long[owner]], owner[long[owner]]
        key = owner * (int(numbers.max()) + 1) + numbers[at]
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = count[which] >= repeats
        if stays.all():
            break
        at, owner = at[stays], owner[stays]
    if not len(at):
        return []
    starts = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
    ends = np.concatenate([starts[1:], [len(at)]]) - 1
    return list(zip(at[starts].tolist(), (at[ends] + 1).tolist()))


def _primes(most: int) -> list[np.ndarray]:
    """Arrays of which each holds, for every number up to `most`, one more prime divisor, or 0."""
    rest, out = np.arange(most + 1), []
    least = np.zeros(most + 1, np.int64)
    for p in range(2, int(most ** 0.5) + 1):
        if not least[p]:
            part = least[p * p:: p]
            part[part == 0] = p
    prime = (least == 0) & (rest > 1)
    least[prime] = rest[prime]
    while (rest > 1).any():
        p = np.where(rest > 1, least[rest], 0)
        out.append(p)
        for _ in range(int(most).bit_length()):
            hit = (p > 1) & (rest % np.maximum(p, 1) == 0)
            if not hit.any():
                break
            rest = np.where(hit, rest // np.maximum(p, 1), rest)
    return out


def _same(names: np.ndarray, width: int, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether size words from a and from b on are equal; width <= size <= 2 * width, names of windows of width words."""
    return (names[a] == names[b]) & (names[a + size - width] == names[b + size - width])


def lag_scan(x: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of one segment: at least `shortest` words and `repeats` periods."""
    m = len(x)
    most, found = m // repeats, []
    if m < shortest or most < 1:
        return found
    divisors = _primes(most)
    names = np.unique(x, return_inverse=True)[1].astype(np.int64)
    below, width = names, 1
    while width <= most and int(names.max()) + 1 < len(names):  # windows of this width that are all different end the scan
        top = min(2 * width - 1, most)
        q = width
        while q <= top:
            to = min(top, q + max(0, PAIRS * q // m - 1))
            lags = np.arange(q, to + 1)
            number = m // lags - 1
            lag = np.repeat(lags, number)
            a = runs(np.zeros(len(lags), np.int64), number) * lag
            hit = _same(names, width, a, a + lag, lag)
            a, lag = a[hit], lag[hit]
            for divisor in divisors:
                p = np.maximum(divisor[lag], 1)
                part = lag // p
                size = lag - part
                wide = size >= width
                other = p > 1
                lower = other & ~wide
                shorter = np.zeros(len(a), bool)
                wide &= other
                shorter[wide] = _same(names, width, a[wide], a[wide] + part[wide], size[wide])
                shorter[lower] = _same(below, width // 2, a[lower], a[lower] + part[lower], size[lower])
                a, lag = a[~shorter], lag[~shorter]
            found += _ends(x, a, lag, repeats, shortest)
            q = to + 1
        wider = names[:-width] * (int(names.max()) + 1) + names[width:]
        below, names, width = names, np.unique(wider, return_inverse=True)[1].astype(np.int64), 2 * width
    return found


def _ends(x: np.ndarray, a: np.ndarray, lag: np.ndarray, repeats: int, shortest: int) -> list[tuple[int, int, int]]:
    """Runs around pairs of equal blocks (a, a + lag), given by lag and then place."""
    if not len(a):
        return []
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(lag) > 0) | (np.diff(a) != lag[1:])]))
    pairs = np.diff(np.concatenate([begins, [len(a)]]))
    q = lag[begins]
    # so many neighbouring pairs lie in any run that is long enough, wherever it starts
    enough = pairs >= np.maximum((np.maximum(shortest, repeats * q) + 1) // q - 2, 1)
    out = []
    for low, n, q in zip(a[begins][enough].tolist(), pairs[enough].tolist(), q[enough].tolist()):
        start, end = max(0, low - q), min(len(x), low + (n + 2) * q)
        same = x[start: end - q] == x[start + q: end]
        differs = np.flatnonzero(~same)
        i = int(np.searchsorted(differs, low - start))
        first = start if i == 0 else start + int(differs[i - 1]) + 1
        last = end if i == len(differs) else start + int(differs[i]) + q
        if last - first >= max(shortest, repeats * q):
            out.append((first, last - first, q))
    return out


def _best(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; of equal ones the first, then the one of smallest period."""
    best = None
    for start, length, period in found:
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def _joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    at = np.flatnonzero(kept)
    first = np.searchsorted(at, words.first)
    last = np.zeros(len(at), bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    data, edge = words.data.copy(), np.zeros(len(words.data) + 1, np.int8)
    edge[words.start[at]] += 1
    edge[words.end[at]] -= 1
    taken = np.cumsum(edge[:-1], dtype=np.int8) > 0
    space = words.end[at[~last]]
    data[space], taken[space] = 32, True
    ends = np.concatenate([[0], np.cumsum(taken)])[words.offsets]
    return strings(data[taken], ends)


def _collapsed(column: pa.Array, repeats: int, shortest: int) -> tuple[np.ndarray, list, list, pa.Array]:
    words = Words(column)
    numbers = word_numbers(words)
    every: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    edge = np.zeros(len(numbers) + 1, np.int32)
    for a, b in segments(numbers, words.first, repeats, shortest):
        doc = int(np.searchsorted(words.first, a, "right")) - 1
        for start, length, period in lag_scan(numbers[a:b], repeats, shortest):
            every[doc].append((a + start - int(words.first[doc]), length, period))
            edge[a + start + period] += 1
            edge[a + start + length] -= 1
    for found in every:
        found.sort(key=lambda r: (r[0], r[2]))
    text = _joined(words, np.cumsum(edge[:-1]) == 0)
    return words.counts, every, [_best(found) for found in every], text


def collapse_runs(docs: DataFrame, keep: list[str] | None = None, text: str = "text", repeats: int = REPEATS,
                  shortest: int = SHORTEST, step: int = STEP) -> DataFrame:
    """`keep` columns (doc_id) of each row, n_words, runs (start, length, period), best (one of them), collapsed (text).

    A run is a stretch of words with smallest period q (words q apart are equal), of at least `shortest` words and
    `repeats` (3 or more) times q, that no neighbouring word extends. runs come by start, then period; best has the
    greatest length / period, of equal ones the first start, then the smallest period, and is null without runs. A
    word is dropped if any run holds it after that run's first q words; `collapsed` is what is kept, joined by one
    space. Words are runs of other bytes than ASCII white space. A null or empty text has no words, no runs and an
    empty collapsed text. Every row gives one row, repeated ones too; nulls in `keep` stay, and columns beside `keep`
    and `text` are not looked at. A text is looked at whole, whatever its length.
    """
    if repeats < 3 or shortest < 1:
        raise ValueError("repeats must be 3 or more")
    keep = ["doc_id"] if keep is None else keep
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)),
                           T.StructField("best", run), T.StructField("collapsed", T.StringType())])
    kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def spans(found: list) -> pa.Array:
        rows = np.array([r or (0, 0, 0) for r in found], np.int64).reshape(-1, 3)
        none = np.array([r is None for r in found], bool)
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(kind), mask=pa.array(none))

    def collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(batch.num_columns - 1), step):
                part = batch.slice(a, b - a)
                n, every, best, kept = _collapsed(part.column(part.num_columns - 1), repeats, shortest)
                ends = np.concatenate([[0], np.cumsum([len(found) for found in every])])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans([r for found in every for r in found]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), lists, spans(best), kept],
                                                 names=[f.name for f in schema.fields])

    return source.mapInArrow(lean_stream(collapsed), schema)
