import hashlib
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from factbase.llm.periods import _best, _collapsed, collapse_runs, lag_scan, segments
from factbase.llm.queries import planted_repeats


def plain_runs(ws, repeats=3, shortest=24):
    """Every stretch of equal words at each distance that is long enough, with its smallest period."""
    found = {}
    for q in range(1, len(ws) // repeats + 1):
        i = 0
        while i < len(ws) - q:
            j = i
            while j < len(ws) - q and ws[j] == ws[j + q]:
                j += 1
            if j + q - i >= max(shortest, repeats * q) and j > i:
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_text(ws, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def plain_best(found):
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None


block = st.lists(st.sampled_from("abc"), min_size=1, max_size=7)
periodic = st.lists(st.tuples(block, st.integers(1, 9)).map(lambda t: t[0] * t[1]), max_size=5).map(lambda x: [w for p in x for w in p])
nested = st.tuples(periodic, st.integers(1, 5)).map(lambda t: t[0] * t[1])


@given(st.one_of(periodic, nested, st.lists(st.sampled_from("ab"), max_size=120)), st.sampled_from([(3, 24), (3, 6), (4, 10)]))
@settings(max_examples=600, deadline=None)
def test_all_runs_are_found(ws, rule):
    numbers = np.array([ord(w) for w in ws], np.int64)
    assert sorted(lag_scan(numbers, *rule)) == plain_runs(ws, *rule)
    n, found, best, text = _collapsed(pa.array([" ".join(ws)]), *rule)
    want = plain_runs(ws, *rule)
    assert sorted(found[0]) == want and text.to_pylist() == [plain_text(ws, want)]
    assert best[0] == plain_best(want)


def test_rare_words_split_until_stable():
    numbers = np.array([1, 2] * 12 + [9] + [1, 3] * 12 + [8] + [4] * 23, np.int64)
    assert segments(numbers, np.array([0, len(numbers)])) == [(0, 24), (25, 49)]
    # 5 is frequent in the whole, but not in the stretch that is left when 9 and 8 have split it
    numbers = np.array([5, 5, 9] + [1, 2] * 11 + [5, 8] + [1, 2] * 3, np.int64)
    assert segments(numbers, np.array([0, len(numbers)])) == []


def test_runs_end_with_their_text():
    n, found, best, text = _collapsed(pa.array(["a b " * 6, "a b " * 6, None, "", "c " * 24]), 3, 24)
    assert found == [[], [], [], [], [(0, 24, 1)]] and text.to_pylist() == ["a b " * 5 + "a b", "a b " * 5 + "a b", "", "", "c"]


def test_greatest_exponent_is_exact():
    big = 3 * 10 ** 17
    assert _best([(0, big, 10 ** 17), (5, big + 1, 10 ** 17)]) == (5, big + 1, 10 ** 17)
    assert _best([(3, 30, 10), (9, 60, 20), (9, 27, 9)]) == (3, 30, 10)


def test_long_segments_take_little_time():
    start = time.time()
    assert lag_scan(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]
    wave = np.random.default_rng(1).integers(0, 3, 70_000)
    assert (0, 210_000, 70_000) in lag_scan(np.tile(wave, 3))
    assert time.time() - start < 60


def test_query_plants_and_finds(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 31}" for j in range(i % 97))) for i in range(400)]
    rows += [(None, "a " * 30), (400, None), (401, ""), (402, "  \t\n "), (7, "x y z " * 9), (7, "x y z " * 9)]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, runs int, best string")
    got = collapse_runs(planted_repeats(docs)).collect()
    want, import_crc = [], __import__("zlib").crc32
    for i, t in rows:
        ws = regex.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = import_crc(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and ws:
            g, n = h // 10, len(ws)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[a + (k - a) % p] if k >= a else w for k, w in enumerate(ws)]
        found = plain_runs(ws)
        want.append((i, len(ws), found, plain_best(found), plain_text(ws, found)))
    said = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], tuple(r.best) if r.best else None, r.collapsed) for r in got]
    assert sorted(said, key=repr) == sorted(want, key=repr)
    assert sum(bool(w[2]) for w in want) > 20
    assert collapse_runs(docs.limit(0)).count() == 0


def test_digests(spark):
    from factbase.llm.queries import op12_runs
    got = op12_runs(spark, "/root/testdata/sf0.001").collect()
    none = hashlib.sha256(b"").hexdigest()
    assert all((r.n_runs == 0) == (r.runs_sha256 == none) == (r.start is None) for r in got) and any(r.n_runs for r in got)


def test_two_repeats_are_refused(spark):
    with pytest.raises(ValueError):
        collapse_runs(spark.createDataFrame([], "doc_id long, text string"), repeats=2)
