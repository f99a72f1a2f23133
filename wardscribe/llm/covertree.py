"""Exact top-k inner products by dual-tree search over cover trees.

Candidates are dealt by space: each goes to the nearest of CELLS centres (taken
from a sample of the rows), and cells over SHARD rows are dealt further by a
hash. A shard gets a cover tree, each block of queries one as well. The search
descends both trees together: a query node holds the candidate nodes that may
matter to any of its queries, opens those that are wider than itself, drops
those whose bound q.c * r.c + |q.c| * r.rad + |r.c| * q.rad + q.rad * r.rad is
under the worst kth score of the query group - found so far, or promised by a
candidate node with more than k points - and hands the rest to its children.

Queries first visit the shards of their own cell. Then each knows a kth score,
and visits another cell only if the bound of the cell's centre and measured
radius reaches it. Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut
from .shards import finite, fit, matrix, search

SHARD, FAN, OPEN = 8192, 32, 4
#: Points of a leaf, candidates and queries: least and most; a 64th and a 16th of the points in between.
LEAF, GROUP = (16, 64), (8, 32)
#: Most cells that the driver holds centres of, and rows that they are chosen from.
CELLS, CELL_SAMPLE = 1024, 8192
NO_FLOOR = -(2**62)


class CoverTree:
    """Each node covers its points from a centre point; children's centres are more than half the node's radius apart, at most FAN of them, and radii are measured."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x, self.center, self.radius, self.children, self.points = x, [], [], [], []
        self.leaf = leaf
        stack = [(np.arange(len(x)), -1)]
        while stack:
            idx, parent = stack.pop()
            at = len(self.center)
            if parent >= 0:
                self.children[parent].append(at)
            c = x[idx[0]]
            d = np.sqrt(((x[idx] - c) ** 2).sum(1))
            self.center.append(c)
            self.radius.append(float(d.max()))
            self.children.append([])
            self.points.append(idx)
            if len(idx) <= leaf or self.radius[-1] == 0:
                continue
            half, owner, best, k = self.radius[-1] / 2, np.zeros(len(idx), np.int64), d.copy(), 1
            while k < FAN and best.max() > half:
                far = x[idx[int(best.argmax())]]
                dist = np.sqrt(((x[idx] - far) ** 2).sum(1))
                near = dist < best
                owner[near], best = k, np.minimum(best, dist)
                k += 1
            for j in range(k):
                mine = idx[owner == j]
                if len(mine):
                    first = mine[int(best[owner == j].argmin())]
                    stack.append((np.concatenate(([first], mine[mine != first])), at))
            self.points[at] = None
        self.center, self.radius = np.array(self.center), np.array(self.radius) * (1 + 1e-12)
        self.norm = np.sqrt((self.center**2).sum(1))
        self.kids = [np.array(c, np.int64) for c in self.children]
        self.size = np.zeros(len(self.center), np.int64)
        for at in range(len(self.size) - 1, -1, -1):  # children come after their parent
            self.size[at] = len(self.points[at]) if self.points[at] is not None else self.size[self.kids[at]].sum()
        self.is_leaf = np.array([p is not None for p in self.points])


class _Best:
    """The k best (score, id) of each query, above a given score each."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, n = k, len(floor)
        self.floor = floor.copy()  # what a query's kth score is known to reach
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Takes in new columns with rising ids: the best k of a row by score, then place, are merged with what it has."""
        use = np.flatnonzero((score >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]).any(0))
        score, ids = score[:, use], ids[use]
        if len(use) > self.k:
            place = np.arange(len(use))
            key = np.where(score > -np.inf, score, -(2.0**52)).astype(np.int64) * 1024 - place
            top = np.sort(np.argpartition(-key, self.k - 1, axis=1)[:, : self.k], axis=1)
            score, new = np.take_along_axis(score, top, 1), ids[top]
        else:
            new = np.broadcast_to(ids, score.shape)
        s, i = np.concatenate((self.score[rows], score), 1), np.concatenate((self.id[rows], new), 1)
        order = np.lexsort((i, -s), axis=-1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def dual_tree(queries: CoverTree, qids: np.ndarray, tree: CoverTree, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query ids, ids, scores) of each query's best k in the tree, without the query's own id, and the number of pairs scored; floor: scores under which a query wants nothing."""
    best, scored = _Best(np.full(len(qids), -np.inf) if floor is None else floor, k), 0
    own = int(np.unique(ids, return_counts=True)[1].max()) if len(ids) else 1
    below = list(queries.points)
    for node in range(len(below) - 1, -1, -1):  # children come after their parent
        if below[node] is None:
            below[node] = np.concatenate([below[c] for c in queries.children[node]])

    def bound(node: int, r: np.ndarray, sign: int = 1) -> np.ndarray:
        qc, qr, qn = queries.center[node], queries.radius[node], queries.norm[node]
        slack = qn * tree.radius[r] + tree.norm[r] * qr + qr * tree.radius[r] + 1e-6 * (1 + qn * tree.norm[r])
        return tree.center[r] @ qc + sign * slack

    stack = [(0, np.array([0]))]
    while stack:
        node, front = stack.pop()
        rows, leaf = below[node], queries.is_leaf[node]
        bounds = bound(node, front)
        while not leaf:  # open what is wider than the query node
            wide = (tree.radius[front] > queries.radius[node]) & ~tree.is_leaf[front]
            if not wide.any():
                break
            kids = np.concatenate([tree.kids[r] for r in front[wide]])
            front, bounds = np.concatenate((front[~wide], kids)), np.concatenate((bounds[~wide], bound(node, kids)))
            least = bound(node, front, -1)[tree.size[front] >= k + own]  # k points besides the query's own
            if len(least):
                best.floor[rows] = np.maximum(best.floor[rows], np.floor(least.max()))
            keep = bounds >= best.worst(rows)
            front, bounds = front[keep], bounds[keep]
        if not leaf:
            keep = bounds >= best.worst(rows)
            stack += [(c, front[keep]) for c in queries.children[node]]
            continue
        q, open_ = queries.x[rows], OPEN
        while len(front):
            keep = bounds >= best.worst(rows)
            front, bounds = front[keep], bounds[keep]
            order = np.argsort(-bounds)
            now, front, bounds, open_ = front[order[:open_]], front[order[open_:]], bounds[order[open_:]], 2 * open_  # the more, the less there is to prune
            leaves = now[tree.is_leaf[now]]
            if len(leaves):
                every = np.concatenate([tree.points[r] for r in leaves])
                every = every[np.argsort(ids[every], kind="stable")]
                scored += len(rows) * len(every)
                for pts in (every[lo : lo + 1024] for lo in range(0, len(every), 1024)):
                    score = q @ tree.x[pts].T
                    score[qids[rows][:, None] == ids[pts][None, :]] = -np.inf
                    best.add(rows, score, ids[pts])
            inner = now[~tree.is_leaf[now]]
            if len(inner):
                kids = np.concatenate([tree.kids[r] for r in inner])
                front, bounds = np.concatenate((front, kids)), np.concatenate((bounds, bound(node, kids)))
    real = best.score > -np.inf
    if floor is not None:
        real &= best.score >= floor[:, None]
    return np.broadcast_to(qids[:, None], real.shape)[real], best.id[real], best.score[real], scored


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and its distance."""
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    for lo in range(0, len(x), 4096):
        part = x[lo : lo + 4096]
        at[lo : lo + 4096] = ((centers**2).sum(1) - 2 * part @ centers.T).argmin(1)
        d[lo : lo + 4096] = np.sqrt(((part - centers[at[lo : lo + 4096]]) ** 2).sum(1))
    return at, d


def _centers(v: DataFrame, n: int) -> np.ndarray:
    """n centres far from each other, of at most CELL_SAMPLE rows chosen by a hash of the id; any n rows give exact results."""
    rows = v.orderBy(F.xxhash64("id", F.lit(4)), "id").limit(CELL_SAMPLE if n > 1 else 1).select("vec").collect()
    width = max((len(r[0]) for r in rows), default=0)
    x = np.array([list(r[0]) + [0.0] * (width - len(r[0])) for r in rows]).reshape(len(rows), width)
    if n <= 1 or len(x) <= n:
        return x[: max(n, 1)]
    chosen = [0]
    d = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, shard: int = SHARD, cells: int = CELLS, scored=None) -> DataFrame:
    """Each query's k highest integer inner products over all rows but those of its own vec_id.

    vectors: vec_id long, embedding array<float or double>; other columns are
    ignored. Components become floor(scale * x). Returns query_id, rank, vec_id,
    score; ties go to the smaller vec_id, all rows if fewer than k. scored: an
    accumulator that gets the number of pairs scored.

    Rows whose vec_id or embedding is null, or whose embedding holds null or
    non-finite components, take no part; shorter vectors count as filled with
    zeros. Scores are exact below 2**52. Repeated rows are candidates each. An
    empty table gives an empty one.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & finite(F.col("vec")))
    v = v.withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))
    n = v.count()
    centers = _centers(v, min(cells, -(-n // shard)))

    def deal(batches):
        for b in batches:
            x = matrix(b["vec"])
            width = max(x.shape[1], centers.shape[1])
            at, d = _nearest(np.pad(x, ((0, 0), (0, width - x.shape[1]))), np.pad(centers, ((0, 0), (0, width - centers.shape[1]))))
            yield pa.RecordBatch.from_arrays([b["id"], b["vec"], pa.array(at), pa.array(d)], ["id", "vec", "cell", "far"])

    dealt = cut(v.mapInArrow(deal, "id long, vec array<double>, cell long, far double"))
    found = {r.cell: (r.far, r.n) for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}  # a row for each cell
    names = np.array(sorted(found), np.int64)
    radius = np.array([found[c][0] for c in names]) * (1 + 1e-9)
    pieces = np.array([-(-found[c][1] // shard) for c in names], np.int64)
    mids = centers[names] if len(names) else centers
    table = F.array(*[F.lit(int(found[c][1] + shard - 1) // shard) if c in found else F.lit(1) for c in range(len(centers))]) if len(centers) else F.array(F.lit(1))
    piece = F.element_at(table, (F.col("cell") + 1).cast("int"))
    n_query = max(1, -(-dealt.where(is_query(F.col("id"))).count() // (8 * shard)))
    members = dealt.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(2)), piece)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1)).cast("array<long>")))
    members = members.select(F.col("cell").alias("part"), "shard", "block", F.lit(0).alias("kind"), "id", F.lit(0).cast("long").alias("extra"), "vec")
    none = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    def index(m, block):
        ids, _, x = m
        return (ids, CoverTree(x, int(np.clip(len(x) // 64, *LEAF)))), none

    def ask(state, m):
        ids, tree = state
        qids, floor, x = m
        a, b, s, pairs = dual_tree(CoverTree(fit(x, tree.x.shape[1]), int(np.clip(len(x) // 16, *GROUP))), qids, tree, ids, k, floor.astype(float))
        if scored is not None:
            scored.add(pairs)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s.astype(np.int64), pa.int64())})

    def visits(own: bool):
        """A row for each shard that a query visits: those of its own cell, or of the other cells that its kth score (extra) leaves open."""

        def run(batches):
            for b in batches:
                x, cell, floor = matrix(b["vec"]), b["cell"].to_numpy(), b["extra"].to_numpy()
                width = max(x.shape[1], mids.shape[1])
                x, c = (np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in (x, mids))
                for lo in range(0, len(x), 1024):
                    q = x[lo : lo + 1024]
                    mine = cell[lo : lo + 1024, None] == names[None, :]
                    if not own:
                        norm = np.sqrt((q**2).sum(1))
                        mine = ~mine & (q @ c.T + norm[:, None] * radius + 1e-6 * (1 + norm[:, None] * np.sqrt((c**2).sum(1))) >= floor[lo : lo + 1024, None])
                    row, at = np.nonzero(mine)
                    times = pieces[at]
                    rows = pa.array(lo + np.repeat(row, times))
                    shard_ = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[at], times)), pa.array(shard_), b["id"].take(rows), b["extra"].take(rows), b["vec"].take(rows)], ["part", "shard", "id", "extra", "vec"])

        return run

    def searched(q: DataFrame, own: bool) -> DataFrame:
        asked = q.select("id", "cell", "extra", "vec").mapInArrow(visits(own), "part long, shard long, id long, extra long, vec array<double>")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_query))).withColumn("kind", F.lit(1))
        return search(members.unionByName(asked), index, ask, "query_id long, vec_id long, score long")

    q = dealt.where(is_query(F.col("id")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    first = cut(searched(q.withColumn("extra", F.lit(NO_FLOOR)), True).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank"))
    kth = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(NO_FLOOR)).alias("extra"))
    more = q.join(kth, q.id == kth.query_id, "left").withColumn("extra", F.coalesce("extra", F.lit(NO_FLOOR)))
    every = first.unionByName(searched(more, False))
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
