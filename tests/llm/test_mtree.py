"""Exact top-k against all products."""

import math
import random

import numpy as np
import pytest

from factbase.llm import mtree
from factbase.llm.mtree import top_k
from factbase.llm.queries import op6_top_k, table


def brute(rows, every, k, scale=256):
    ok = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for here, (q, a) in enumerate(ok):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for at, (i, b) in enumerate(ok) if at != here)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.fixture
def small(monkeypatch):
    for name, value in (("PIVOTS", 5), ("BANDS", 4), ("TREE_ROWS", 20), ("QUERY_ROWS", 7), ("LEAF", 6), ("FANOUT", 3)):
        monkeypatch.setattr(mtree, name, value)


@pytest.mark.parametrize("seed,dims", [(1, 3), (2, 24)])
def test_against_all_products(spark, small, seed, dims):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) * (1 + i % 3) for _ in range(dims)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 620)]  # one point many times
    rows += [(1000, None), (1001, [None] * dims), (1010, [float("nan")] * dims), (1020, [float("inf")] + [0.0] * (dims - 1)),
             (None, [0.5] * dims), (1030, [0.25] * (dims - 1)), (1040, []), (1051, [0.0] * dims)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    from pyspark.sql import functions as F
    got = top_k(frame, F.col("vec_id") % 10 == 0, k=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 4)


def test_repeated_rows(spark, small):
    """Rows that share an id, or are wholly equal, ask and answer as rows of their own; a third of all rows is one row."""
    rng = random.Random(5)
    rows = [(i % 150, [rng.randrange(-40, 40) / 256 for _ in range(3)]) for i in range(300)] + [(50, [0.1, 0.2, 0.3])] * 150
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    from pyspark.sql import functions as F
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, top_k(frame, F.col("vec_id") % 50 == 0, k=4).collect())) == brute(rows, 50, 4)
    twice = spark.createDataFrame(rows[:100] + rows[:100], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, top_k(twice, F.col("vec_id") % 50 == 0).collect())) == brute(rows[:100] * 2, 50, 5)
    many = spark.createDataFrame([(1, 10_000), (2, 4096), (3, 1)], "a int, n long")
    assert {r.a: r["count"] for r in mtree._repeated(many, "n").groupBy("a").count().collect()} == {1: 10_000, 2: 4096, 3: 1}


def test_few_rows(spark):
    from pyspark.sql import functions as F
    frame = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.1, 0.2]), (50, [0.1, 0.2])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(frame, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 9728), (0, 2, 50, 9728)]
    assert top_k(frame.limit(0), F.col("vec_id") == 0).count() == 0
    assert top_k(frame.limit(1), F.col("vec_id") == 0).count() == 0


def test_pruning():
    """Stored distances spare most computations where points form clusters."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(c, 0.5, (200, 4)) for c in rng.normal(0, 60, (20, 4))])
    points = np.floor(points).astype(np.int64)
    top = float((points * points).sum(1).max())
    raised = mtree._raised(points, top)
    import pyarrow as pa
    pages = [dict(zip(("page", "leaf", "ids", "vectors", "radius", "parent"), (p[0], p[1], np.ascontiguousarray(p[2], np.int64).tobytes(),
             *[np.ascontiguousarray(x, float).tobytes() for x in p[3:]]))) for p in mtree._pages(np.stack([np.arange(4000), np.ones(4000, int)], 1), raised, raised[0])]
    tree = mtree.Tree(pa.Table.from_pylist(pages), 5)
    q = points[11]
    best, seen = tree.search(q, -1, 5, top, None, float(np.linalg.norm(np.append(q, 0.0) - raised[0])))
    scores = points @ q
    assert sorted((-s, -i) for s, i in best) == sorted(zip((-scores).tolist(), range(4000)))[:5]
    assert seen < 2000


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, "/root/testdata/sf0.01", "embeddings").collect()]
    assert sorted(map(tuple, op6_top_k(spark, "/root/testdata/sf0.01").collect())) == brute(rows, 50, 5)
