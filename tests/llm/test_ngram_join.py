"""Components of the n-gram Jaccard join against all pairs."""

import random
import re

import pytest

from factbase.llm.ngram_join import keep_first, similar_groups
from factbase.llm.queries import op7_ngram_join, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, percent=80):
    """[(id, text)] -> component of each row as the smallest id."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        root = find(i)
        low.setdefault(root, None)
        if key is not None and (low[root] is None or key < low[root]):
            low[root] = key
    return [(key, len(sets[i]), low[find(i)]) for i, (key, _) in enumerate(rows)]


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "xyz"]
    texts = []
    passage = rng.choices(words, k=40)
    for _ in range(n):
        kind = rng.random()
        if kind < 0.25 or not texts:
            t = rng.choices(words, k=rng.randrange(1, 80))
        elif kind < 0.35:
            t = passage + rng.choices(words, k=rng.randrange(1, 30))  # shares most words with its like
        elif kind < 0.5:
            t = list(rng.choice(texts))
        else:  # chains of small edits
            t = list(rng.choice(texts[-8:]))
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = t + rng.choices(words, k=rng.randrange(3))
        texts.append(t)
    return [(i, " ".join(w.upper() if rng.random() < 0.3 else w for w in t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed) + [(900, None), (901, ""), (902, "one two"), (903, "ONE  two"), (904, "one two three"), (None, "one two"),
                           (None, None), (905, "É é a b c d"), (906, "é é a b c d"), (907, "the of " * 4000), (908, "the of " * 4001)]
    random.Random(seed).shuffle(rows)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_shingles int").repartition(3)
    got = similar_groups(docs).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = [r.doc_id for r in keep_first(docs).collect()]
    want = [r for r in brute(rows) if r[0] is None or r[0] == r[2]]
    assert sorted(k for k in kept if k is not None) == sorted(r[0] for r in want if r[0] is not None)
    assert kept.count(None) == 1  # the null text; "one two" has a row with an id


def test_many_copies_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i % 50, base if i % 2 else base + f" tail{i}") for i in range(400)] + [(7, "alone in the whole wide world")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar_groups(docs).collect()
    assert len(got) == 403
    assert {r.component_id for r in got if r.n_shingles > 50} == {0} and sum(r.is_first for r in got) == 2
    assert keep_first(docs).count() == 2
    assert similar_groups(docs.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    want = sorted(brute(rows))
    assert any(r[0] != r[2] for r in want)
    assert sorted(map(tuple, op7_ngram_join(spark, folder).collect())) == want
