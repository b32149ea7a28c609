"""Removal of repeated windows against a plain loop."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from factbase.llm.blocks import unpack
from factbase.llm.queries import op3_substrings, table
from factbase.llm.substrings import _census, _frequent, remove_repeats, suffix_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id, text) in order."""
    seen, out = set(), []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        kept = [w for w, g in zip(words, gone) if not g]
        spans, s = [], 0
        while s < len(gone):
            e = s
            while e < len(gone) and gone[e]:
                e += 1
            if e > s:
                spans.append((s, e))
            s = max(e, s + 1)
        out.append((i, len(words), sum(gone), " ".join(kept), spans))
    return out


def texts(seed, words=4, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(words)]
    shared = [" ".join(rng.choices(vocabulary + list("abcdefgh"), k=rng.randrange(15, 60))) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary + [f"u{i}x{j}" for j in range(6)], k=rng.randrange(30)))
                 for _ in range(rng.randrange(6))]
        out.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    return out


@pytest.mark.parametrize("seed,window,anchor,split", [(1, 20, 8, 100_000), (2, 20, 8, 1), (3, 6, 3, 2), (4, 4, 4, 100_000), (5, 1, 1, 3)])
def test_against_loop(spark, seed, window, anchor, split):
    rows = texts(seed) + [(100, None), (101, ""), (102, "x"), (103, "the of " * 3000), (104, "the of " * 3000), (105, "\x85 \xa0 " * 30)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    got = remove_repeats(docs, window, anchor=anchor, split=split).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept, [(s.start, s.end) for s in r.spans]) for r in got) == brute(rows, window)


@pytest.mark.parametrize("window", [1, 2, 5, 7, 8, 20])
def test_suffixes_are_sorted_and_share_prefixes(window):
    rng = random.Random(window)
    text = np.array([rng.choice([3, 9, 2 ** 63 + 5]) for _ in range(400)] + [7] * 60, np.uint64)
    places = np.array([i for i in range(len(text) - window + 1) if rng.random() < 0.8])
    ties = np.array([rng.randrange(3) for _ in places])
    order, common = suffix_order(text, places, window, ties, places)
    whole = [(tuple(text[p: p + window].tolist()), t, p) for p, t in zip(places.tolist(), ties.tolist())]
    assert [whole[i] for i in order] == sorted(whole)
    for a, b, c in zip(order[:-1], order[1:], common):
        x, y = whole[a][0], whole[b][0]
        assert c == next((i for i in range(window) if x[i] != y[i]), window)


def test_counts_of_grams_are_exact():
    text = " ".join(["a b c d"] * 400 + [f"x{i}" for i in range(40)])
    bucket = pa.table({"bucket": pa.array([0], pa.int32()), "id": [1], "text": [text]})
    counted = _census(4, 4, 3)(bucket)
    total = sum(np.frombuffer(x, np.uint8).astype(int).sum() for x in counted.column("counts").to_pylist())
    assert total == 400 * 4 + 40 - 3
    for split, hot in [(399, 1), (400, 0)]:  # a b c d begins 400 times, its rotations 399 times
        seen = {}
        for target in set(counted.column("target").to_pylist()):
            known = _frequent(split)(counted.filter(pa.compute.equal(counted.column("target"), target)))
            for codes, flags in zip(known.column("codes").to_pylist(), known.column("counts").to_pylist()):
                seen.update({(target, c): f for c, f in zip(unpack(codes).tolist(), np.frombuffer(flags, np.uint8).tolist())})
        assert len(seen) == 4 and sum(seen.values()) == hot


def test_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text), (None, text), (5, text), (5, text), (5, "b " + text)], "doc_id long, text string")
    got = remove_repeats(docs, keep=["doc_id", "text"], as_is=True).collect()
    assert len(got) == 5 and sum(r.n_removed == 0 for r in got) == 1
    assert all(r.n_removed for r in got if r.doc_id is None)
    assert [r.kept for r in got if not r.n_removed][0] in (text, "b " + text)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in table(spark, folder, "documents").collect())
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept, _ in brute(rows, 20)]
    assert sum(w[2] for w in want) > 0
    assert sorted(map(tuple, op3_substrings(spark, folder).collect())) == want
