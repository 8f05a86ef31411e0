"""Many pivots, blocks and packs, a hot vector, and floors that leave trees out."""

import numpy as np
from claimlens.llm import mtree


def _brute(rows, k=10):
    ids = np.array([i for i, _ in rows])
    v = np.floor(np.array([x for _, x in rows]).astype(np.float32).astype(np.float64) * 1024).astype(np.int64)
    out = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = v @ v[q]
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if j != q)[:k]
        out += [(int(ids[q]), r, int(i), int(-t)) for r, (t, i) in enumerate(order, 1)]
    return sorted(out)


def test_pivots_blocks_and_floors(spark, monkeypatch):
    monkeypatch.setattr(mtree, "ROWS_A_PIVOT", 60)
    monkeypatch.setattr(mtree, "TREE_ROWS", 50)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 4)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 5)) * 4
    x = centres[rng.integers(0, 12, 1200)] + rng.normal(size=(1200, 5)) * 0.1
    x[400:800] = x[0]  # a third of all rows are one vector
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = mtree.top_k(frame, frame.filter("vec_id % 100 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == _brute(rows)


def test_floor_keeps_the_best():
    rng = np.random.default_rng(9)
    v = rng.integers(-50, 50, (700, 6))
    tree = mtree.Tree(np.arange(700), v)
    for q in v[:20]:
        whole = tree.search(q, -1, 10)
        floor = whole[4][0]
        assert [x for x in tree.search(q, -1, 10, floor) if x[0] >= floor] == [x for x in whole if x[0] >= floor]
        assert [x for x in tree.search(q, -1, 10, whole[0][0] + 1) if x[0] > whole[0][0]] == []


def test_pivots_leave_out_what_no_query_needs():
    near, far = np.array([[100, 0]]), np.array([[-100, 0]])
    pivots, radii = {2: np.concatenate([near, far])}, {2: np.array([5.0, 5.0])}
    bound = mtree._bounds(np.array([[10, 0]]), pivots[2], radii[2])
    assert bound[0, 0] > 1000 >= bound[0, 0] - 51 and bound[0, 1] < 0
