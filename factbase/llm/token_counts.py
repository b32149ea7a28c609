"""Token counts of whole texts: tasks encode batches of equal bytes and hand back lengths only.

A task gathers texts until they make up STEP bytes and encodes them in one call, so a batch costs about the same
whether it holds many short texts or a few long ones. Longer texts are cut into parts of about STEP bytes at places
where no token can reach across, and their counts are added up; a text without such a place stays whole. The work is
narrow: no shuffle, and neither texts nor ids leave the task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factbase.llm.words import lean_stream, utf8

STEP = 1 << 20  # bytes of text for each call of the tokenizer


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte tables: ASCII white space, ASCII letters, other visible ASCII characters."""
    space, letter = np.zeros(256, bool), np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    letter[[*range(65, 91), *range(97, 123)]] = True
    mark = np.zeros(256, bool)
    mark[33:127] = True
    return space, letter, mark & ~letter


_SPACE, _LETTER, _MARK = _classes()
# First bytes of the UTF-8 characters that hold all white space outside ASCII.
_WIDE_SPACE = np.zeros(256, bool)
_WIDE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _leads(data: np.ndarray) -> np.ndarray:
    """For each byte the first byte of its character."""
    at = np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)
    return data[np.maximum.accumulate(at)]


def word_ends(data: np.ndarray) -> np.ndarray:
    """Places between a visible character and ASCII white space."""
    lead = _leads(data)
    visible = _LETTER[lead] | _MARK[lead] | ((lead >= 0x80) & ~_WIDE_SPACE[lead])
    return np.flatnonzero(visible[:-1] & _SPACE[data[1:]]) + 1


def letter_ends(data: np.ndarray) -> np.ndarray:
    """Places between an ASCII letter or a common ideograph (U+5000 to U+8FFF) and an ASCII character that is no letter."""
    lead = _leads(data)
    letter = _LETTER[lead] | ((lead >= 0xE5) & (lead <= 0xE8))
    return np.flatnonzero(letter[:-1] & (_SPACE | _MARK)[data[1:]]) + 1


def parts(data: np.ndarray, places: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Runs between some of the places, each the shortest of at least `step` bytes."""
    out, begin = [], 0
    while len(data) - begin > step:
        i = int(np.searchsorted(places, begin + step))
        if i == len(places):
            break
        out.append((begin, int(places[i])))
        begin = int(places[i])
    return [*out, (begin, len(data))]


class JsonTokenizer:
    """A tokenizer file of the tokenizers library. Texts are cut if it splits bytes by words and nothing comes before."""

    def __init__(self, spec: str):
        import json
        from tokenizers import Tokenizer
        said = json.loads(spec)
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        first, added = said.get("pre_tokenizer") or {}, said.get("added_tokens") or []
        self.cuts = (said.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True)
                     and not first.get("add_prefix_space")
                     and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        names = [re.escape(t["content"].encode("utf-8")) for t in added if t["content"]]
        self.added = re.compile(b"|".join(names)) if names else None

    def places(self, data: np.ndarray) -> np.ndarray:
        """Ends of words and of letters, but none inside an added token."""
        if not self.cuts:
            return np.zeros(0, np.int64)
        found = np.union1d(word_ends(data), letter_ends(data))
        for hit in self.added.finditer(data.tobytes()) if self.added else ():
            found = found[(found <= hit.start()) | (found >= hit.end())]
        return found

    def split(self, data: np.ndarray, step: int) -> list[str]:
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in parts(data, self.places(data), step)]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokenizer:
    """A model file of the sentencepiece library. Texts are cut before a single space, which the next part gets anew,
    if no piece has a space after another character and the parts normalise to the same as the whole."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuts = not any("▁" in name.lstrip("▁") for name in names)

    def split(self, data: np.ndarray, step: int) -> list[str]:
        raw = data.tobytes()
        whole = raw.decode("utf-8", "replace")
        if not self.cuts:
            return [whole]
        found = word_ends(data)
        found = found[(data[found] == 32) & (found + 1 < len(data))]
        found = found[(_LETTER | _MARK)[data[found + 1]]]
        cut = [raw[a + (a > 0): b].decode("utf-8", "replace") for a, b in parts(data, found, step)]
        same = "".join(self.model.normalize(c) for c in cut) == self.model.normalize(whole)
        return cut if same else [whole]

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]


def _counter(kind: str, content: bytes) -> Callable[[pa.Array, int], np.ndarray]:
    coder = PieceTokenizer(content) if kind == "model" else JsonTokenizer(content.decode("utf-8"))

    def count(column: pa.Array, step: int) -> np.ndarray:
        data, offsets = utf8(column)
        out = np.zeros(len(column), np.int64)
        texts, owners, held = [], [], 0

        def flush() -> None:
            if texts:
                np.add.at(out, owners, coder.lengths(texts))

        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            if a == b:
                continue
            whole = b - a <= step
            for part in [data[a:b].tobytes().decode("utf-8", "replace")] if whole else coder.split(data[a:b], step):
                texts.append(part)
                owners.append(i)
                held += min(b - a, step) if whole else len(part)
                if held >= step:
                    flush()
                    texts, owners, held = [], [], 0
        flush()
        return out

    return count


def count_tokens(docs: DataFrame, tokenizer_file: str, keep: list[str] | None = None, text: str = "text",
                 step: int = STEP) -> DataFrame:
    """`keep` columns (doc_id) of each row, n_bytes (long, UTF-8) and n_tokens (long).

    n_tokens is the number of ids that the library of the file gives for the whole text: tokenizers for .json,
    sentencepiece for .model. No begin, end or other special token is added, strings of special tokens inside a text
    are handled as the library does by default, truncation and padding of the file are not used. A null text counts as
    an empty one (0 bytes, 0 tokens), bytes that are not UTF-8 as replacement characters. Every row gives one row,
    repeated ones too; nulls in `keep` stay; columns beside `keep` and `text` are not looked at. The file is read by
    the driver and sent to the tasks (its size is that of a vocabulary).
    """
    keep = ["doc_id"] if keep is None else keep
    with open(tokenizer_file, "rb") as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = tokenizer_file.rsplit(".", 1)[-1]
    source = docs.select(*[F.col(c) for c in keep], F.col(text).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = _counter(kind, held.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = np.diff(utf8(column)[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(count(column, step), pa.int64())],
                                             names=[f.name for f in schema.fields])

    return source.mapInArrow(lean_stream(run), schema)
