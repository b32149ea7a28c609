"""Words of many texts at once: an Arrow string column becomes flat numpy arrays of word places and word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (multiply and shift rounds)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=U64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()
_PLAIN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_powers: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64, kept for the next batch of the same worker."""
    base = _INVERSE if inverse else _BASE
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(1 << 16, 1 << int(n + 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        _powers[base] = np.multiply.accumulate(have)
    return _powers[base][: n + 1]


def rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of values[start:end], the same wherever the run stands."""
    n = len(values)
    sums = np.zeros(n + 1, U64)
    np.cumsum(values * powers(n)[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n, True)[starts])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 places where texts begin; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """start, end: bytes of each word; doc: number of its text; first: n + 1 places where the words of a text begin."""

    def __init__(self, column: pa.Array, lower: bool = False, plain: bool = False):
        """lower: A-Z as a-z. plain: also every ASCII character but letters and digits as a space."""
        self.data, self.offsets = utf8(column)
        if lower or plain:
            self.data = (_PLAIN if plain else _LOWER)[self.data]
        self._find()

    def _find(self) -> None:
        data, offsets = self.data, self.offsets
        n = len(data)
        word = np.zeros(n + 1, bool)
        np.logical_not(_SPACE[data], out=word[:n])
        begins = word[:n].copy()
        begins[1:] &= ~word[: n - 1] if n else begins[1:]
        at = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[at] |= word[at]
        stops = word[:n] & ~word[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stops[last] |= word[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, step: int = 1 << 19) -> np.ndarray:
        """64-bit hash of each word, about `step` bytes at a time."""
        out = np.zeros(len(self.start), U64)
        at = 0
        while at < len(out):
            low = self.start[at]
            to = max(at + 1, int(np.searchsorted(self.end, low + step, "right")))
            out[at:to] = rolled(_BYTE[self.data[low: self.end[to - 1]]], self.start[at:to] - low, self.end[at:to] - low)
            at = to
        return out

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether these lie in one text."""
        n = len(hashes)
        room = np.repeat(self.first[1:], self.counts) - np.arange(n) >= k
        starts = np.flatnonzero(room)
        out = np.zeros(n, U64)
        out[starts] = rolled(hashes, starts, starts + k)
        return out, room


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the runs start .. start + length - 1, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pieces(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Rows of a column in runs of about `most` bytes; one longer text stands alone and whole."""
    sizes = np.diff(utf8(column)[1])
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Return freed memory to the machine: a Python worker is used for many tasks and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of one or two Arrow tables that gives its memory back when it ends."""
    def one(a):
        try:
            return run(a)
        finally:
            give_back()

    def two(a, b):
        try:
            return run(a, b)
        finally:
            give_back()

    return one if run.__code__.co_argcount == 1 else two


def lean_stream(run: Callable) -> Callable:
    """The same for a function of a stream of batches."""
    def stream(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return stream
