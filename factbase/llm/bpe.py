"""BPE encoding and decoding that encodes every content-defined chunk once.

A text is cut at places that its content alone decides, so equal passages of different texts give equal chunks:

* passages end after a word where the rolling hash of the last REACH words is divisible by `every`. A task encodes and
  decodes a passage once, keeps it, and puts later texts together from it;
* a new passage is made of smaller chunks that are kept in the same way: its words, and inside an unbroken run of more
  than LONG bytes the stretches that end where the rolling hash of the last SPAN bytes is divisible by SPACING.

White space always ends a token of these vocabularies, so joins there agree. Every other join is tried: both
neighbours are encoded together, and where the result differs from the two apart, they are merged and tried against
their new neighbours, until all joins agree.

The work is narrow: no shuffle, and a task holds STEP bytes of text (or one longer text), KEPT chunks and KEPT_BYTES of
passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factbase.llm.words import _BYTE, Words, give_back, lean_stream, pieces, rolled, runs

STEP = 1 << 20        # bytes of text that are cut at a time
KEPT = 300_000          # chunks that a task remembers; it starts anew beyond
KEPT_BYTES = 8 << 20  # text of the passages that a task remembers; it starts anew beyond
EVERY, REACH = 32, 4
LONG, SPAN, SPACING = 256, 16, 64
GROUP = 4_000         # chunks per call of the tokenizer
HASHED = 1 << 18      # bytes that are hashed and compared at a time (one longer chunk is taken whole)


def _parts(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[slice, int, int]]:
    """Chunks in order of start, about HASHED bytes at a time, and the bytes from the first to the end of the last."""
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(start, start[at] + HASHED)))
        yield slice(at, to), int(start[at]), int(end[at:to].max())
        at = to


Flat = tuple[np.ndarray, np.ndarray]  # values of all chunks in a row, and how many each has


class Chunks:
    """Chunks met so far, sorted by hash, with their bytes, token ids and decoded text as flat arrays."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.made = 0  # bytes that were encoded
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)       # of a sorted key in the flat arrays
        self.flat = [(np.zeros(0, np.uint8), np.zeros(1, np.int64)), (np.zeros(0, np.uint32), np.zeros(1, np.int64)),
                     (np.zeros(0, np.uint8), np.zeros(1, np.int64))]

    def coded(self, texts: list[bytes]) -> tuple[Flat, Flat]:
        """Token ids and decoded bytes of new chunks."""
        ids, said, sizes = [], [], []
        for at in range(0, len(texts), GROUP):
            part = [t.decode("utf-8") for t in texts[at: at + GROUP]]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            # without a decoder, tokens are joined by spaces: each chunk ends in the space before the next one
            text = [(s + " ").encode("utf-8") if x else b"" for x, s in
                    zip(got, self.tokenizer.decode_batch(got, skip_special_tokens=False))]
            sizes.append(np.array([[len(x) for x in got], [len(x) for x in text]], np.int64))
            ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1][0].sum())))
            said.append(np.frombuffer(b"".join(text), np.uint8))
        n_ids, n_said = np.concatenate(sizes, axis=1)
        return (np.concatenate(ids), n_ids), (np.concatenate(said), n_said)

    def add(self, keys: np.ndarray, texts: list[bytes]) -> None:
        """Encode and decode new chunks."""
        self.made += sum(map(len, texts))
        raw = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        known = len(self.keys)
        for i, (more, sizes) in enumerate([raw, *self.coded(texts)]):
            values, offsets = self.flat[i]
            self.flat[i] = np.concatenate([values, more]), np.concatenate([offsets, offsets[-1] + np.cumsum(sizes)])
        keys, place = np.concatenate([self.keys, keys]), np.concatenate([self.place, known + np.arange(len(keys))])
        order = np.argsort(keys)
        self.keys, self.place = keys[order], place[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is new."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.place[at], -1)

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of the chunks data[start:end], new ones encoded first."""
        keys = np.zeros(len(start), np.uint64)
        for part, low, high in _parts(start, end):
            keys[part] = rolled(_BYTE[data[low:high]], start[part] - low, end[part] - low)
        unique, first, which = np.unique(keys, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.find(unique) < 0)
        if len(new):
            raw = memoryview(np.ascontiguousarray(data))
            self.add(unique[new], [bytes(raw[a:b]) for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())])
        at = self.find(unique)[which]
        held, offsets = self.flat[0]
        same = np.array_equal(np.diff(offsets)[at], end - start) and all(
            np.array_equal(held[runs(offsets[at[part]], end[part] - start[part])],
                           data[runs(start[part], end[part] - start[part])]) for part, _, _ in _parts(start, end))
        if not same:  # two chunks of one hash
            raise ValueError("two different chunks have the same 64-bit hash")
        return at


class Passages(Chunks):
    """Passages met so far; new ones are put together from smaller chunks."""

    def __init__(self, small: Chunks):
        self.small = small
        super().__init__(small.tokenizer)

    def coded(self, texts: list[bytes]) -> tuple[Flat, Flat]:
        if len(self.small.keys) > KEPT:  # only here: places stay valid while texts are put together
            self.small.clear()
        words = Words(pa.array(texts, pa.large_binary()))
        start, end, glued = _small_cuts(words)
        start, end = _repair(self.small, words.data, start, end, glued)
        at = self.small.places(words.data, start, end)
        return tuple((values, np.diff(ends)) for values, ends in _joined(self.small, at, np.searchsorted(start, words.offsets)))


def _joined(chunks: Chunks, at: np.ndarray, first: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and decoded bytes of chunks in a row, and where those of each text begin (first: its first chunk)."""
    out = []
    for values, offsets in chunks.flat[1:]:
        sizes = np.diff(offsets)[at]
        out.append((values[runs(offsets[at], sizes)], np.concatenate([[0], np.cumsum(sizes)])[first]))
    return out


def _cuts(words: Words, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each passage."""
    n = len(words.start)
    if not n:
        return words.start, words.end
    grams, whole = words.grams(words.hashes(), REACH)
    cut = np.zeros(n, bool)
    cut[REACH - 1:] = (whole & (grams % np.uint64(every) == 0))[: max(0, n - REACH + 1)]
    cut[words.first[1:][words.counts > 0] - 1] = True
    stops = np.flatnonzero(cut)
    return words.start[np.concatenate([[0], stops[:-1] + 1])], words.end[stops]


def _small_cuts(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each chunk of passages, and whether it is joined to the next one without white space."""
    start, end, data = words.start, words.end, words.data
    inner = [np.zeros(0, np.int64)]
    for i in np.flatnonzero(end - start > LONG).tolist():
        a, b = int(start[i]), int(end[i])
        at = np.arange(a + SPAN, b - SPAN)
        here = rolled(_BYTE[data[a:b]], at - SPAN - a, at - a) % np.uint64(SPACING) == 0
        here &= (data[at] & 0xC0) != 0x80  # not inside a character
        keep, last = [], a
        for x in at[here].tolist():
            if x - last >= SPAN:
                keep.append(x)
                last = x
        inner.append(np.array(keep, np.int64))
    inner = np.concatenate(inner)
    s, e = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
    return s, e, np.isin(e, inner)


def _repair(chunks: Chunks, data: np.ndarray, start: np.ndarray, end: np.ndarray, glued: np.ndarray):
    """Merge neighbours whose join does not agree with their encoding together, until all joins agree."""
    untried = glued
    while len(joins := np.flatnonzero(untried)):
        apart, together = chunks.places(data, start, end), chunks.places(data, start[joins], end[joins + 1])
        ids, offsets = chunks.flat[1]
        get = lambda p: ids[offsets[p]: offsets[p + 1]]
        bad = np.array([not np.array_equal(np.concatenate([get(apart[j]), get(apart[j + 1])]), get(t))
                        for j, t in zip(joins.tolist(), together.tolist())])
        merged = joins[bad]
        new = np.zeros(len(start), bool)
        new[merged] = True
        new = np.delete(new, merged + 1)
        start, end, glued = np.delete(start, merged + 1), np.delete(end, merged), np.delete(glued, merged)
        untried = glued & (new | np.append(new[1:], False))
    return start, end


def _coded(column: pa.Array, passages: Passages, every: int) -> tuple[np.ndarray, list[bytes], list[str]]:
    if len(passages.flat[0][0]) > KEPT_BYTES:  # only here: places stay valid while a column is worked on
        passages.clear()
    words = Words(column)
    start, end = _cuts(words, every)
    at = passages.places(words.data, start, end)
    (ids, a), (said, b) = _joined(passages, at, np.searchsorted(start, words.offsets))
    raw, text = ids.astype("<u4").tobytes(), said.tobytes()
    packed = [raw[4 * x: 4 * y] for x, y in zip(a[:-1].tolist(), a[1:].tolist())]
    decoded = [text[x: max(x, y - 1)].decode("utf-8") for x, y in zip(b[:-1].tolist(), b[1:].tolist())]
    return np.diff(a), packed, decoded


def encode_decode(docs: DataFrame, tokenizer_file: str, keep: list[str] | None = None, text: str = "text",
                  every: int = EVERY) -> DataFrame:
    """`keep` columns (doc_id) of each row, n_tokens (long), ids (binary: unsigned 32-bit, little-endian), decoded.

    ids equal the tokenizer's for the whole text with add_special_tokens=False; decoded equals its
    decode(ids, skip_special_tokens=False). A null text counts as an empty one: no ids, empty decoded text. Repeated
    rows stay rows; columns beside `keep` and `text` are not looked at. The tokenizer must have no decoder of its own
    and drop white space between words, like word_bpe_49k; others are refused. `tokenizer_file` is read by the driver
    and sent to the tasks (its size is that of a vocabulary).
    """
    import json
    keep = ["doc_id"] if keep is None else keep
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = json.load(f)
    split = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if spec.get("decoder") or split[0].get("type") != "Split" or split[0].get("behavior") != "Removed":
        raise ValueError("a tokenizer without decoder is needed that removes white space")
    spec["truncation"] = spec["padding"] = None
    held = docs.sparkSession.sparkContext.broadcast(json.dumps(spec))
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        passages = Passages(Chunks(Tokenizer.from_str(held.value)))
        for batch in batches:
            for a, b in pieces(batch.column(batch.num_columns - 1), STEP):
                part = batch.slice(a, b - a)
                n, ids, decoded = _coded(part.column(part.num_columns - 1), passages, every)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                    names=[f.name for f in schema.fields])
                give_back()  # else what one step frees adds to the next step's needs

    return source.mapInArrow(lean_stream(run), schema)
