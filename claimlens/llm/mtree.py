"""Exact top-k by inner product: best-first search in M-trees.

Vectors are dealt to the nearest of a bounded number of pivots, drawn from a
sample, and from there by a hash of their id into blocks, so a vector that many
rows share overloads none.  Each block is bulk-loaded into an M-tree: pages of
entries, each with its routing vector, the radius that covers all below it, and
its Euclidean distance to the parent's routing vector.  For a query q and an
entry with routing vector c, no vector below has a product over

    q.c + |q| * radius,                              or, without computing q.c,
    q.parent + |q| * (distance to parent + radius)   by the triangle inequality.

Nodes are taken from a heap by the first bound; entries whose second bound lies
under the k-th best score so far are passed over without any computation.

Queries are asked twice.  First each goes to the trees of the pivot with the
highest bound; its k-th best score there is a floor.  Then it goes to the trees
of those other pivots only whose bound (the pivot's product and radius) reaches
the floor, and every search starts with it.  A window keeps the k best of both.
"""

from __future__ import annotations

import pickle
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

PAGE, FANOUT = 128, 32
TREE_ROWS, QUERY_ROWS = 16_384, 1_024
#: Pivots are drawn from so many rows, those with the smallest hashes; at most PIVOTS of them, at least ROWS_A_PIVOT rows to one.
SAMPLE, PIVOTS, ROWS_A_PIVOT = 4_096, 512, 8_192
#: Relative and absolute slack of bounds, which are floating point; scores are integers.
SLACK = 1e-9


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


class Tree:
    """An M-tree over integer vectors.

    nodes[i]: (leaf, ids or child numbers, vectors, radii, distances to the
    node's routing vector); the root is the last node, its routing vector ``top``.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.nodes: list[tuple] = []
        self.ids, self.vectors = ids, vectors
        self.points = vectors.astype(np.float64)
        order = np.lexsort((ids,))
        self.top, self.radius, _ = self._load(order)
        del self.ids, self.vectors, self.points

    def _router(self, rows: np.ndarray) -> np.ndarray:
        x = self.points[rows]
        return self.vectors[rows[int(np.argmin(_distances(x, x.mean(0))))]]

    def _load(self, rows: np.ndarray) -> tuple[np.ndarray, float, int]:
        """Build the subtree of the rows: its routing vector, radius and node number."""
        router = self._router(rows)
        apart = _distances(self.points[rows], router.astype(np.float64))
        radius = float(apart.max())
        if len(rows) <= PAGE:
            self.nodes.append((True, self.ids[rows], self.vectors[rows], None, apart))
            return router, radius, len(self.nodes) - 1
        m = min(FANOUT, -(-len(rows) // PAGE))
        pivots = self.points[rows[np.linspace(0, len(rows) - 1, m).astype(int)]]
        square = np.einsum("ij,ij->i", pivots, pivots)
        nearest = np.argmin(square[None, :] - 2 * self.points[rows] @ pivots.T, axis=1)
        if np.bincount(nearest, minlength=m).max() > 0.9 * len(rows):
            nearest = np.arange(len(rows)) * m // len(rows)  # mostly equal vectors: any even cut will do
        children = [self._load(rows[nearest == k]) for k in range(m) if (nearest == k).any()]
        routers = np.stack([c[0] for c in children])
        self.nodes.append(
            (False, [c[2] for c in children], routers, np.array([c[1] for c in children]), _distances(routers.astype(np.float64), router.astype(np.float64)))
        )
        return router, radius, len(self.nodes) - 1

    def search(self, q: np.ndarray, own: int, k: int, floor: int | None = None) -> list[tuple[int, int]]:
        """Up to k (score, id) with id other than own, best first, ties to the smaller id; scores under the floor may be left out."""
        norm = float(np.sqrt((q.astype(np.float64) ** 2).sum()))
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        at_top = int(self.top @ q)
        heap = [(-(at_top + norm * self.radius), len(self.nodes) - 1, at_top)]
        while heap:
            bound, number, product = heappop(heap)
            least = best[0][0] if len(best) == k else None
            least = floor if least is None or floor is not None and floor > least else least
            if least is not None and -bound + SLACK * (abs(bound) + norm) + SLACK < least:
                break
            leaf, below, vectors, radii, apart = self.nodes[number]
            reach = product + norm * (apart if leaf else apart + radii)
            reach += SLACK * (np.abs(reach) + norm) + SLACK
            some = np.arange(len(apart)) if least is None else np.flatnonzero(reach >= least)
            if not len(some):
                continue
            scores = (vectors[some] if len(some) < len(apart) else vectors) @ q
            if leaf:
                if least is not None:
                    good = scores >= least
                    some, scores = some[good], scores[good]
                for s, i in zip(scores.tolist(), below[some].tolist(), strict=True):
                    if i == own:
                        continue
                    if len(best) < k:
                        heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heappushpop(best, (s, -i))
            else:
                for s, j, r in zip(scores.tolist(), some.tolist(), radii[some].tolist(), strict=True):
                    heappush(heap, (-(s + norm * r), below[j], s))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def _arrays(batches, width: int):
    """Rows (numbers..., vector) as groups of the same numbers but the first and the same dimension: (numbers, ids, vectors)."""
    held: dict[tuple, tuple[list, list]] = {}
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        lists = batch.column(width)
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        begin = np.cumsum(sizes) - sizes
        for g in set(zip(*(c.tolist() for c in columns[1:]), sizes.tolist(), strict=True)):
            rows = np.flatnonzero(np.logical_and.reduce([c == v for c, v in zip([*columns[1:], sizes], g, strict=True)]))
            own = held.setdefault(g, ([], []))
            own[0].append(columns[0][rows])
            own[1].append(flat[begin[rows][:, None] + np.arange(g[-1])])
    for g, (ids, vectors) in held.items():
        yield g, np.concatenate(ids), np.concatenate(vectors)


def _nearest(pivots: dict[int, np.ndarray]):
    """Rows (id, v) with the number of the nearest pivot of their dimension (-1: it has none) and the distance to it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            pivot, far = np.full(len(sizes), -1), np.zeros(len(sizes))
            for d in set(sizes.tolist()):
                if d in pivots:
                    rows = np.flatnonzero(sizes == d)
                    x, c = flat[begin[rows][:, None] + np.arange(d)].astype(np.float64), pivots[d].astype(np.float64)
                    square = np.einsum("ij,ij->i", c, c)
                    pivot[rows] = np.argmin(square[None, :] - 2 * x @ c.T, axis=1)
                    far[rows] = _distances(x, c[pivot[rows]])
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes.astype(np.int64)), pa.array(pivot), pa.array(far)], ["id", "v", "d", "pivot", "far"])

    return run


def _trees(batches):
    """Over rows (id, pivot, part, v): a tree of each block."""
    for (pivot, part, d), ids, vectors in _arrays(batches, 3):
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (pivot, part, d)] + [pa.array([pickle.dumps(Tree(ids, vectors))])], ["pivot", "part", "d", "tree"])


def _bounds(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Of each vector and pivot the highest product that a vector of that pivot can have."""
    x = x.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    out = x @ pivots.astype(np.float64).T + norm * radii[None, :]
    return out + SLACK * (np.abs(out) + norm) + SLACK


def _asked(pivots: dict[int, np.ndarray], radii: dict[int, np.ndarray], first: bool):
    """Over queries (id, pack, floor, v), packed: the pivots to search, a row each.  floor: null for none."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            floors = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))
            for (pack, d), ids, vectors in _arrays([batch.select([0, 1, 3])], 2):
                floor = [floors[i] for i in ids.tolist()]
                if d not in pivots:
                    yield from _pack(-1, d, ids, vectors, floor, first)
                    continue
                bound = _bounds(vectors, pivots[d], radii[d])
                bound[:, radii[d] < 0] = -np.inf  # no vector has this pivot
                best = np.argmax(bound, axis=1)
                least = np.array([-np.inf if f is None else f for f in floor])
                for p in range(len(pivots[d])):
                    some = best == p if first else (best != p) & (bound[:, p] >= least) & (radii[d][p] >= 0)
                    if some.any():
                        yield from _pack(p, d, ids[some], vectors[some], [f for f, s in zip(floor, some.tolist(), strict=True) if s], True)

    return run


def _pack(pivot: int, d: int, ids, vectors, floor, wanted: bool):
    if wanted:
        yield pa.RecordBatch.from_arrays([pa.array([pivot], pa.int64()), pa.array([d], pa.int64()), pa.array([pickle.dumps((ids, vectors, floor))])], ["pivot", "d", "queries"])


def _search(k: int):
    def run(batches):
        held, tree = None, None
        for batch in batches:
            for *block, raw, queries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != block:
                    held, tree = block, pickle.loads(raw)
                ids, vectors, floor = pickle.loads(queries)
                found = [(i, v, s) for i, q, f in zip(ids.tolist(), vectors, floor, strict=True) for s, v in tree.search(q, i, k, f)]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], pa.int64()) for j in range(3)], ["query_id", "vec_id", "score"])

    return run


def _draw(rows: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension, spread over a sample of bounded size: each next one is far from those before."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(SAMPLE).collect()
    by: dict[int, list] = {}
    for r in sample:
        if len(r.v):
            by.setdefault(len(r.v), []).append(r.v)
    out = {}
    for d, own in by.items():
        x = np.unique(np.array(own, np.int64), axis=0)
        points = x.astype(np.float64)
        most = max(1, min(PIVOTS, len(x), -(-total // ROWS_A_PIVOT)))
        chosen, far = [0], _distances(points, points[0])
        while len(chosen) < most:
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, _distances(points, points[chosen[-1]]))
        out[d] = x[chosen]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest products of the vectors floor(scale * x).

    Both frames have a long key and an array of numbers.  Rows without key or
    vector, and vectors holding null or non-finite components, take no part;
    vectors only meet vectors of their own length.  Rows that share the
    query's key are no candidates for it; a query that repeats is asked once
    (with its smallest vector); other repeated rows all are candidates.  Ties
    go to the smaller key.  Other columns are ignored.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.col("_v")
        clean = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("_v")).filter(
            F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
        )
        return clean.select("id", F.transform(x, lambda c: F.floor(c * scale)).alias("v"))

    rows = whole(vectors)
    total = rows.count()
    pivots = _draw(rows, total)
    dealt = stage_table(rows.mapInArrow(_nearest(pivots), "id long, v array<long>, d long, pivot long, far double"), "mtree-rows")
    stats = dealt.groupBy("d", "pivot").agg(F.max("far").alias("far"), F.count("*").alias("n")).filter("pivot >= 0").collect()  # one for each pivot
    radii = {d: np.full(len(c), -1.0) for d, c in pivots.items()}
    for r in stats:
        radii[r.d][r.pivot] = r.far
    parts = F.greatest(F.ceil(F.col("n") / TREE_ROWS), F.lit(1))
    sizes = dealt.groupBy("d", "pivot").agg(F.count("*").alias("n")).select(F.col("d").alias("_d"), F.col("pivot").alias("_p"), parts.alias("parts"))
    counted = dealt.join(sizes, (F.col("d") == F.col("_d")) & (F.col("pivot") == F.col("_p")))
    block = counted.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")))
    tasks = max(1, -(-total // TREE_ROWS))
    trees = stage_table(block.select("id", "pivot", "part", "v", "d").repartition(tasks, "d", "pivot", "part").drop("d").mapInArrow(_trees, "pivot long, part long, d long, tree binary"), "mtree-trees")

    asked = whole(queries).groupBy("id").agg(F.min("v").alias("v"))
    packs = max(1, -(-queries.count() // QUERY_ROWS))
    placed = asked.mapInArrow(_nearest(pivots), "id long, v array<long>, d long, pivot long, far double")  # near queries share a pack
    asked = stage_table(placed.select("id", F.pmod(F.xxhash64("pivot", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(-(-packs // 8)))), F.lit(packs)).alias("pack"), "v"), "mtree-queries")

    def met(rows: DataFrame, first: bool) -> DataFrame:
        packed = rows.select("id", "pack", "floor", "v").repartition(packs, "pack").mapInArrow(_asked(pivots, radii, first), "pivot long, d long, queries binary")
        pairs = trees.join(packed.hint("shuffle_hash"), ["pivot", "d"]).select("pivot", "part", "d", "tree", "queries")
        return stage_table(pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long"), "mtree-found")

    near = met(asked.withColumn("floor", F.lit(None).cast("long")), True)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    floors = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    others = met(asked.join(floors, "id", "left"), False)
    found = near.unionByName(others).withColumn("rank", F.row_number().over(order))
    return found.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
