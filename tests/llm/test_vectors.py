"""op2 and op5 on vectors large enough that trees prune and graphs are walked."""

import numpy as np
import pytest

pytest.importorskip("wardscribe.llm.queries")

from wardscribe.llm.covertree import CoverTree, dual_tree, top_k  # noqa: E402
from wardscribe.llm.hnsw import Graph, near_duplicates  # noqa: E402


def clusters(rng, n, k, noise, width=32):
    c = rng.normal(size=(k, width))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c[rng.integers(0, k, n)] + rng.normal(size=(n, width)) * noise


def frame(spark, x, labels):
    return spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x.astype(np.float32), labels))], "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("k", [1, 20, 300])
def test_dual_tree_descends_and_prunes(k):
    rng = np.random.default_rng(3)
    x = np.floor(64 * clusters(rng, 3000, 60, 0.02))
    ids = rng.permutation(3000)
    queries = CoverTree(x[::7], 8)
    assert len(queries.center) > 40
    a, b, s, scored = dual_tree(queries, ids[::7], CoverTree(x, 16), ids, k)
    got = {}
    for q, i, v in zip(a, b, s):
        got.setdefault(int(q), []).append((-int(v), int(i)))
    for row, q in zip(range(0, 3000, 7), ids[::7]):
        want = sorted((-int(x[row] @ x[j]), int(ids[j])) for j in range(3000) if j != row)[:k]
        assert sorted(got[int(q)]) == want
    if k <= 20:
        assert scored < 0.5 * len(ids[::7]) * 3000


def test_top_k_prunes_shards(spark):
    """Cells and kth scores leave under half of all pairs to be scored, and the result is exact."""
    rng = np.random.default_rng(4)
    x = clusters(rng, 2000, 50, 0.02)
    scored = spark.sparkContext.accumulator(0)
    got = top_k(frame(spark, x, np.zeros(2000)), lambda c: c % 10 == 0, shard=150, scored=scored).collect()
    v = np.floor(64 * x.astype(np.float32).astype(float))
    want = set()
    for q in range(0, 2000, 10):
        for rank, (s, j) in enumerate(sorted((-int(t), j) for j, t in enumerate(v @ v[q]) if j != q)[:20]):
            want.add((q, rank + 1, j, -s))
    assert {tuple(r) for r in got} == want
    assert 0 < scored.value < 0.5 * 200 * 2000


@pytest.mark.parametrize(("n", "k", "noise"), [(1500, 150, 0.02), (1200, 6, 0.02), (1000, 1000, 0.0)])
def test_graph_recall(n, k, noise):
    rng = np.random.default_rng(n)
    x = clusters(rng, n, k, noise)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = u @ u.T >= 0.98
    np.fill_diagonal(true, False)
    g, got = Graph(x, np.ones(n, int)), np.zeros((n, n), bool)
    r, m = g.linked(x, 0.98, 0)
    got[r, m] = True
    np.fill_diagonal(got, False)
    assert not (got & ~true).any() and got.sum() >= 0.99 * true.sum()


def test_near_duplicates_over_cells(spark):
    """A label of several shards dealt by space, one of one shard: nearly all links, exact components."""
    rng = np.random.default_rng(6)
    x = clusters(rng, 2600, 300, 0.02)
    y = np.arange(2600) % 4 == 0
    audited = [spark.sparkContext.accumulator(0) for _ in range(2)]
    got = {r.vec_id: r for r in near_duplicates(frame(spark, x, y), shard=1000, audited=audited).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    true = (u @ u.T >= 0.98) & (y[:, None] == y[None, :])
    np.fill_diagonal(true, False)
    found = sum(r.n_links for r in got.values())
    assert 0.99 * true.sum() <= found <= true.sum()
    label = np.arange(2600)
    while True:
        new = np.array([label[m].min() if m.any() else label[i] for i, m in enumerate(true | np.eye(2600, dtype=bool))])
        if (new == label).all():
            break
        label = new
    assert sum(got[i].component_id != label[i] for i in range(2600)) <= 0.01 * 2600
    assert audited[1].value > 0 and audited[0].value >= 0.99 * audited[1].value
