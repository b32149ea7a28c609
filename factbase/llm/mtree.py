"""Exact top-k inner products with M-trees and best-first search.

Inner products become distances by one more coordinate: with M the largest squared norm, x gets sqrt(M - |x|^2) and a
query 0, so d(q, x)^2 = |q|^2 + M - 2 q.x, and the nearest vectors have the largest products.

Vectors go to the nearest of at most PIVOTS sampled pivots; a pivot's cell is cut into at most BANDS bands by distance
to the pivot, and a band is split evenly into trees of about TREE_ROWS vectors, however many share it. A tree is written
as pages: an inner page holds routing objects with covering radius and the distance to the page's own routing object, a
leaf page vectors with that distance. A query visits one tree of its own cell first; the k-th score found bounds all
further visits. Bands whose distances to the pivot are beyond that bound are not visited; within a tree, pages are read
best first, and stored parent distances rule out entries by the triangle inequality before their distance is computed.

Queries name the trees they visit. A tree travels once for each QUERY_ROWS of its visits, and not at all without one, so
what is shuffled grows with vectors and visits. Equal rows are collapsed with their number before anything is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factbase.llm.storage import cut

PIVOTS = 256
BANDS = 64
TREE_ROWS = 8192
QUERY_ROWS = 512
LEAF, FANOUT = 512, 16
SLACK = 1e-6            # for rounding: of distances, as a share of the largest one
PAGE = "tree long, page int, leaf boolean, ids binary, vectors binary, radius binary, parent binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _raised(x: np.ndarray, top: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], axis=1)


def _far(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    d = points - one
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _collapsed(ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (id, vector) with the sum of their copies."""
    rows, place = np.unique(np.column_stack([ids, vectors]), axis=0, return_inverse=True)
    return rows[:, 0], rows[:, 1:], np.bincount(place.ravel(), copies).astype(np.int64)


def _pages(ids: np.ndarray, points: np.ndarray, routing: np.ndarray) -> Iterator[tuple]:
    """(page, leaf, ids or page numbers, vectors, radius, parent) of one tree; page 0 is the root. ids: pairs of id and copies."""
    todo, last = [(0, np.arange(len(ids)), routing)], 0
    while todo:
        page, rows, centre = todo.pop()
        if len(rows) <= LEAF:
            yield page, True, ids[rows], points[rows], np.zeros(len(rows)), _far(points[rows], centre)
            continue
        mine = points[rows]
        near, owner, chosen = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), []
        for i in range(min(FANOUT, -(-len(rows) // LEAF))):  # the next routing object is the farthest from those so far
            chosen.append(int(np.argmax(near)))
            d = _far(mine, mine[chosen[-1]])
            owner[d < near] = i
            near = np.minimum(near, d)
        if np.bincount(owner).max() == len(rows):  # one point many times
            owner = np.arange(len(rows)) * len(chosen) // len(rows)
            near = _far(mine, mine[chosen[0]])
        kids = np.unique(owner)
        centres = mine[[chosen[k] for k in kids]]
        radius = np.array([_far(mine[owner == k], c).max() for k, c in zip(kids, centres)])
        numbers = np.arange(last + 1, last + 1 + len(kids))
        last += len(kids)
        todo += [(int(n), rows[owner == k], c) for n, k, c in zip(numbers, kids, centres)]
        yield page, False, numbers, centres, radius, _far(centres, centre)


class Tree:
    def __init__(self, pages: pa.Table, width: int):
        read = lambda raw: np.frombuffer(raw, np.float64)
        self.pages = {}
        for p in pages.to_pylist():
            vectors = read(p["vectors"]).reshape(-1, width)
            if p["leaf"]:
                vectors = np.ascontiguousarray(vectors[:, :-1])  # without the raised coordinate
            ids = np.frombuffer(p["ids"], np.int64)
            self.pages[p["page"]] = p["leaf"], ids.reshape(-1, 2) if p["leaf"] else ids, vectors, read(p["radius"]), read(p["parent"])

    def search(self, query: np.ndarray, own: int, k: int, top: float, least: int | None, from_root: float) -> tuple[list, int]:
        """The k best (score, -id) of the tree that reach `least`, without one row (own, query) itself; from_root: distance
        to the root's routing object."""
        size = float((query * query).sum()) + top
        slack = SLACK * (1 + np.sqrt(size))
        reach = lambda score: np.sqrt(max(size - 2.0 * score, 0.0)) + slack
        bound = np.inf if least is None else reach(least)
        exact = query.astype(np.float64)
        raised = np.append(exact, 0.0)
        best: list[tuple[int, int]] = []
        queue, seen = [(0.0, 0, from_root)], 0
        while queue and queue[0][0] <= bound:
            _, page, above = heapq.heappop(queue)
            leaf, ids, vectors, radius, parent = self.pages[page]
            some = np.flatnonzero(np.abs(above - parent) - radius <= bound + slack)
            seen += len(some)
            if leaf:
                # products of whole numbers below 2^53 are exact; all of a page at once where most of it is left
                if 2 * len(some) > len(ids):
                    scores = (vectors @ exact)[some]
                else:
                    scores = vectors[some] @ exact
                floor = best[0][0] if len(best) == k else -np.inf if least is None else least
                ahead = np.flatnonzero(scores >= floor)
                rows = some[ahead]
                left = ids[rows, 1].copy()
                mine = np.flatnonzero(ids[rows, 0] == own)
                left[mine[(vectors[rows[mine]] == exact).all(axis=1)]] -= 1  # the row that asks
                for s, i, n in zip(scores[ahead].astype(np.int64).tolist(), ids[rows, 0].tolist(), left.tolist()):
                    for _ in range(min(n, k)):
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    bound = min(bound, reach(best[0][0]))
            else:
                far = _far(vectors[some], raised)
                low = far - radius[some]
                for i in np.flatnonzero(low <= bound + slack).tolist():
                    heapq.heappush(queue, (float(max(low[i], 0.0)), int(ids[some[i]]), float(far[i])))
        return best, seen


def _search(k: int, top: float, width: int):
    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        if pages.num_rows and queries.num_rows:
            tree = Tree(pages, width + 1)
            vectors = _matrix(queries.column("vector"), width)
            for v, q in zip(vectors, queries.drop_columns(["vector"]).to_pylist()):
                best = tree.search(v, q["query_id"], k, top, q["least"], q["far"])[0]
                out += [(q["ask"], q["query_id"], q["asked"], -i, s) for s, i in best]
        names = ["ask", "query_id", "asked", "vec_id", "score"]
        return pa.table([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=names)
    return run


def _cuts(n: int, percentiles: list[float]) -> list[float]:
    """Borders of a cell's bands: as many bands as it has trees, at most one more than there are percentiles."""
    bands = min(len(percentiles) + 1, -(-n // TREE_ROWS))
    return sorted({percentiles[len(percentiles) * i // bands] for i in range(1, bands)})


def _repeated(rows: DataFrame, n: str, step: int = 4096) -> DataFrame:
    """Each row n times, by way of short sequences."""
    rows = rows.withColumn("_s", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {step})")))
    return rows.withColumn("_s", F.explode(F.expr(f"sequence(1L, least({step}L, {n} - _s * {step}))"))).drop("_s", n)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query row with all other rows.

    Components become floor(scale * x) first. Rows without id, and vectors that are null or hold a null or non-finite
    component, take no part; a vector that is shorter than another counts as filled up with zeros. Equal scores go to
    the smaller id. Fewer than k other rows give fewer ranks. Every row is a row of its own: one that asks is left out of its
    own answer, another row with the same id, or a wholly equal one, is a candidate, and each of them asks for itself,
    so a repeated query id has ranks 1 to k once for each row. Products must stay below 2^53.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    parts = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: finite(x.cast("double"))))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), parts.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, asked, width, top = rows.agg(F.count("*"), F.count_if("asks"), F.max(F.size("vector")), F.max(norm)).first()
    if not n or not asked:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.orderBy(F.xxhash64("id", "vector", F.lit("pivot")), "id").limit(min(PIVOTS, -(-n // TREE_ROWS))).select("vector").toArrow()
    pivots = _raised(_matrix(sample.column(0), width), top)
    whole = pa.list_(pa.int64())

    def lists(matrix: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(matrix.ravel()), width).cast(whole) if width else pa.array([[]] * len(matrix), whole)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, found, copies = _collapsed(batch.column(0).to_numpy(), _matrix(batch.column(1), width), np.ones(batch.num_rows))
                raised = _raised(found, top)
                far = np.stack([_far(raised, p) for p in pivots], 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists(found), pa.array(copies), pa.array(far.argmin(1).astype(np.int32)),
                                                  pa.array(far.min(1))], names=["id", "vector", "copies", "cell", "far"])

    placed = rows.select("id", "vector").mapInArrow(nearest, "id long, vector array<long>, copies long, cell int, far double")
    # one row for each pivot, then one for each band: at most PIVOTS * BANDS
    shares = [i / BANDS for i in range(1, BANDS)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("far", shares).alias("at")).collect()
    borders = vectors.sparkSession.createDataFrame([(r["cell"], _cuts(r["n"], r["at"])) for r in cells], "cell int, cuts array<double>")
    banded = placed.join(F.broadcast(borders), "cell").withColumn(
        "band", (F.col("cell") * BANDS + F.size(F.filter("cuts", lambda c: c < F.col("far")))).cast("long"))
    bands = sorted(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect())
    number, rows_of, low, high = (np.array([r[i] for r in bands]) for i in range(4))
    trees = -(-rows_of // TREE_ROWS)
    first_tree = np.cumsum(trees) - trees

    def build(tree: pa.Table) -> pa.Table:
        ids, found, copies = _collapsed(tree.column("id").to_numpy(), _matrix(tree.column("vector"), width), tree.column("copies").to_numpy())
        at = tree.column("tree")[0].as_py()
        routing = pivots[number[np.searchsorted(first_tree, at, "right") - 1] // BANDS]
        pages = list(_pages(np.column_stack([ids, copies]), _raised(found, top), routing))
        columns = [[at] * len(pages), *[[p[i] for p in pages] for i in (0, 1)],
                   *[[np.ascontiguousarray(p[i], t).tobytes() for p in pages] for i, t in ((2, np.int64), (3, float), (4, float), (5, float))]]
        kinds = [pa.int64(), pa.int32(), pa.bool_()] + [pa.binary()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=[f.split()[0] for f in PAGE.split(", ")])

    directory = vectors.sparkSession.createDataFrame(
        [tuple(map(int, r)) for r in zip(number, first_tree, trees)], "band long, first_tree long, trees long")
    place = F.col("first_tree") + F.pmod(F.xxhash64("id", "vector"), F.col("trees"))
    index = cut(banded.join(F.broadcast(directory), "band").select(place.alias("tree"), "id", "vector", "copies")
                .groupBy("tree").applyInArrow(build, PAGE))
    sent_columns = "tree long, ask long, query_id long, asked long, vector array<long>, least long, far double"

    def visits(first: bool):
        """One tree of a query's own cell, or all others that the bound does not rule out."""
        def trees_of(ask: int, v: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
            far = _far(pivots, v)[number // BANDS]
            gap = np.maximum(np.maximum(low - far, far - high), 0)
            inside = np.flatnonzero(far == far.min())
            home = int(inside[np.argmin(gap[inside])])
            own = first_tree[home] + ask % trees[home]
            if first:
                return np.array([own]), far[[home]]
            size = (v * v).sum() + top
            reach = np.inf if least is None else np.sqrt(max(size - 2.0 * least, 0)) + SLACK * (1 + np.sqrt(size))
            near = np.flatnonzero(gap <= reach)
            many = trees[near]
            found = np.repeat(first_tree[near] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            keep = found != own
            return found[keep], np.repeat(far[near], many)[keep]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in sent_columns.split(", ")]
            for whole_batch in batches:
                for start in range(0, whole_batch.num_rows, 32):  # a query may visit every tree
                    batch = whole_batch.slice(start, 32)
                    found = _matrix(batch.column("vector"), width)
                    raised = np.concatenate([found.astype(float), np.zeros((len(found), 1))], axis=1)
                    out = [trees_of(a, v, least) for a, v, least in zip(
                        batch.column("ask").to_pylist(), raised, batch.column("least").to_pylist())]
                    take = pa.array(np.repeat(np.arange(len(out)), [len(t) for t, _ in out]))
                    held = [batch.column(c).take(take) for c in ("ask", "query_id", "asked", "vector", "least")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([t for t, _ in out])), *held,
                                                      pa.array(np.concatenate([f for _, f in out]))], names=names)
        return run

    def found(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.mapInArrow(visits(first), sent_columns)
        load = cut(sent.groupBy("tree").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("blocks")))  # one row for each visited tree
        pages = index.join(load, "tree").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        sent = sent.join(load, "tree").withColumn("block", F.pmod(F.xxhash64("ask"), F.col("blocks")))
        return pages.groupBy("tree", "block").cogroup(sent.groupBy("tree", "block")).applyInArrow(
            _search(k, top, width), "ask long, query_id long, asked long, vec_id long, score long")

    queries = rows.where("asks").groupBy("id", "vector").agg(F.count("*").alias("asked"))
    queries = cut(queries.select(F.monotonically_increasing_id().alias("ask"), F.col("id").alias("query_id"), "asked", "vector"))
    one = cut(found(queries.withColumn("least", F.lit(None).cast("long")), True))
    bounds = one.groupBy("ask").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(
        "ask", F.when(F.col("n") >= k, F.col("low")).alias("least"))
    two = found(queries.join(bounds, "ask", "left").select("ask", "query_id", "asked", "vector", "least"), False)
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    ranked = one.union(two).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return _repeated(ranked, "asked").select("query_id", "rank", "vec_id", "score")
