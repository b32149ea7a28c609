"""Benchmark overlaps: planted passages with and without substitutions, against a plain search on all diagonals."""

import random
import re
from collections import defaultdict

from factbase.llm.decontaminate import MASKS, PENALTY, SPAN, find_overlaps
from factbase.llm.queries import op2_decontaminate, table


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, at_least=12):
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v, best = words(item), None
            for s in range(-len(v) + 1, len(w)):
                low, high = max(0, -s), min(len(v), len(w) - s)
                equal = [w[s + j] == v[j] for j in range(low, high)]
                seeded = any(all(equal[p + j] for j, c in enumerate(m) if c == "1") for m in MASKS for p in range(len(equal) - SPAN + 1))
                seeded |= len(v) < SPAN and len(equal) == len(v) and all(equal)
                if not seeded:
                    continue
                points, top = [0], (0, 0, 0)
                for e in equal:
                    points.append(points[-1] + (1 if e else -PENALTY))
                for end in range(len(points)):
                    low_at = min(range(end + 1), key=lambda j: (points[j], j))
                    if points[end] - points[low_at] > top[0]:
                        top = (points[end] - points[low_at], low_at, end)
                n = sum(equal[top[1]:top[2]])
                if n >= min(at_least, len(v)):
                    found = (n, top[1] - top[2], -(s + low + top[1]), -(low + top[1]))
                    best = max(best or found, found)
            if best:
                n, size, at, place = best
                out.add((d, i, n, -size, -at, -at - size, -place))
    return out


def test_planted(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 11, 12, 20, 45])))) for i in range(25)]
    docs, exact = [], set()
    for d in range(120):
        parts = rng.choices(vocabulary, k=rng.randrange(60))
        i, item = rng.choice(items)
        kind, w = d % 5, item.split()
        if kind == 1:
            w = [x.upper() + rng.choice([",", ".", "!"]) for x in w]
        elif kind == 2:  # substitutions
            for _ in range(len(w) // 10):
                w[rng.randrange(len(w))] = "changed"
        elif kind == 3:  # a part of it
            w = w[: len(w) // 2]
        elif kind == 4:
            w = []
        if kind in (0, 1):
            exact.add((d, i))
        at = rng.randrange(len(parts) + 1)
        docs.append((d, " ".join(parts[:at] + w + parts[at:])))
    docs += [(500, None), (501, ""), (502, "w1 " * 20_000)]
    bad = [(None, items[0][1]), (77, None), (78, ""), (79, "?!")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, matches int").repartition(2)
    bench = spark.createDataFrame(items + bad, "item_id long, text string")
    want = brute(docs, items)
    assert exact <= {w[:2] for w in want}
    for block_words in (1_000_000, 200):  # one table and several
        got = find_overlaps(frame, bench, block_words=block_words).collect()
        assert len(got) == len(docs)
        assert {(r.doc_id, *m) for r in got for m in r.matches} == want
    assert all(not r.matches for r in find_overlaps(frame, bench.limit(0)).collect())
    assert find_overlaps(frame.limit(0), bench).count() == 0


def every_diagonal(docs, items, at_least=12):
    """(text, item, equal words) of all matches, whatever the seeds."""
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v, most = words(item), 0
            for s in range(-len(v) + 1, len(w)):
                low, points, floor, top, n = max(0, -s), 0, (0, 0), 0, 0
                equal = 0
                for j in range(low, min(len(v), len(w) - s)):
                    same = w[s + j] == v[j]
                    points, equal = points + (1 if same else -PENALTY), equal + same
                    if points - floor[0] > top:
                        top, n = points - floor[0], equal - floor[1]
                    if points < floor[0]:
                        floor = (points, equal)
                most = max(most, n)
            if most >= min(at_least, len(v)) and v:
                out.add((d, i, most))
    return out


def test_every_accepted_stretch_has_a_seed(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([5, 11, 12, 13, 16, 18, 24, 33, 45, 59])]
    plants = []
    for i, item in items:
        v = item.split()
        plants += [(i, [x if j % gap != at else "other" for j, x in enumerate(v)]) for gap in (3, 4, 5, 6, 7) for at in range(gap)]
        plants += [(i, ["other" if rng.random() < share else x for x in v]) for share in (0.1, 0.2, 0.3) for _ in range(6)]
        plants += [(i, ["other" if j in (4, 10) else x for j, x in enumerate(v)])]
    docs = [(d, " ".join(rng.choices(vocabulary, k=rng.randrange(9)) + w + rng.choices(vocabulary, k=rng.randrange(9))))
            for d, (_, w) in enumerate(plants)]
    want = every_diagonal(docs, items)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, m.item_id, m.n_matched) for r in find_overlaps(frame, bench).collect() for m in r.matches}
    assert {w[:2] for w in want} == {g[:2] for g in got} and len(want) > 150
    assert got == want
    few = {(r.doc_id, m.item_id) for r in find_overlaps(frame, bench, at_least=6).collect() for m in r.matches}
    assert few == {w[:2] for w in every_diagonal(docs, items, 6)}


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(words(r.text)) for r in table(spark, folder, "documents").collect()}
    items = {r.item_id: words(r.text) for r in table(spark, folder, "benchmark").collect()}
    want = {(d, i) for i, v in items.items() for d, t in docs.items() if f" {' '.join(v)} " in f" {t} "}
    got = defaultdict(int)
    for r in op2_decontaminate(spark, folder).collect():
        got[r.doc_id, r.item_id] = r.n_matched
    assert want and want <= set(got)
    for (d, i), n in got.items():  # no clean document: at least a whole stretch of twelve equal words
        assert n >= min(12, len(items[i]))
