"""Packed messages and word hashes."""

import numpy as np
import pyarrow as pa
import pytest

from factbase.llm.blocks import pack, unpack
from factbase.llm.words import Words, pieces


@pytest.mark.parametrize("top", [1, 10, 70_000, 1 << 24, (1 << 32) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 500])
def test_pack_round_trip(top, n):
    values = np.unique(np.random.default_rng(n).integers(0, top, n, endpoint=True))
    raw = pack(values)
    assert unpack(raw).tolist() == values.tolist() and len(raw) <= 1 + 4 * len(values)


def test_words_and_hashes():
    texts = ["a bc\td", None, "", "  ", "bc a", "é\x85x y", "a", "x" * 3_000_000 + " bc"]
    words = Words(pa.array(texts, pa.string()))
    raw = words.data.tobytes()
    got = [raw[s:e].decode() for s, e in zip(words.start, words.end)]
    assert got == [w for t in texts for w in (t or "").split(" ") for w in w.split("\t") if w]
    assert words.counts.tolist() == [3, 0, 0, 0, 2, 2, 1, 2]
    hashes = words.hashes(step=7)
    assert len(set(hashes.tolist())) == len(set(got))
    assert all((hashes[i] == hashes[j]) == (got[i] == got[j]) for i in range(len(got)) for j in range(len(got)))
    assert (hashes == words.hashes()).all()
    parts = list(pieces(pa.array(texts, pa.string()), 10))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(texts)))
