"""Embedding near-dedup on hierarchical navigable small-world graphs.

Equal vectors of a label collapse first. Labels over SHARD vectors are dealt by
space: each vector goes to the nearest of the label's cells, and cells over
SHARD vectors are dealt further by a hash. A task builds a layered graph over
its shard by insertion: blocks of new nodes search the graph so far and are
linked with diverse neighbours, which link back. A ring over each layer keeps
it connected. A vector queries every shard that the triangle inequality does
not rule out, many at once: a beam through the layers, then a flood from what
is linked over neighbours that are nearly linked.

Audits widen beam and flood until they pass: probes, members moved to just over
the least cosine, must find the member that they came from, also where no data
link; and a sample of each block is compared with brute force, counted over all
blocks of a shard. Found pairs are verified by cosine in double precision. A
shard's links become its local components, so a query sends one edge for each
component that it touches, never one for each pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut
from .shards import finite, fit, matrix, search

SHARD, BEAM, AUDIT, RECALL, BLOCK = 4096, 32, 32, 0.99, 256
#: A node of a layer has LINKS neighbours at most, each layer every FAN-th node of the one below.
LINKS, FAN, STEP = 16, 16, 4
#: Most cells of all labels and of one label whose centres the driver holds; labels beyond are dealt by a hash.
CELLS, CELLS_A_LABEL = 4096, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.float32)


class Graph:
    """Layers of nodes, each with neighbours in its layer; a layer's nodes come first in the layer below."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, least: float = 0.98):
        self.raw, self.weight, self.norm = x, weight, np.sqrt((x**2).sum(1))
        n = len(x)
        self.order = np.random.default_rng(n).permutation(n)
        self.unit = _unit(x)[self.order]  # a node's number is its place in the order
        sizes = [n]
        while sizes[-1] > FAN:
            sizes.append(-(-sizes[-1] // FAN))
        self.sizes, self.near = sizes, [None] * len(sizes)
        self.beam, self.margin, self.found, self.true = BEAM, 0.01, 0, 0
        for layer in range(len(sizes) - 1, -1, -1):
            self._build(layer)
        self._probe(least)

    def _build(self, layer: int) -> None:
        n = self.sizes[layer]
        self.near[layer] = near = np.full((n, LINKS + 1), -1)
        near[:, LINKS] = (np.arange(n) + 1) % n
        done = min(FAN, n)
        self._link(near, np.arange(done), np.broadcast_to(np.arange(done), (done, done)))
        while done < n:
            new = np.arange(done, min(n, done + min(done, BLOCK)))
            x = self.unit[new]
            start = self._descend(x, layer) if done >= (self.sizes[layer + 1] if layer + 1 < len(self.sizes) else n + 1) else np.zeros((len(new), 1), np.int64)
            ids, _ = self._beam(x, near, start, BEAM, done)
            peers = np.broadcast_to(new, (len(new), len(new)))
            if len(new) > LINKS:
                peers = new[np.argpartition(-(x @ x.T), LINKS, axis=1)[:, : LINKS + 1]]
            self._link(near, new, np.concatenate((ids, peers), 1))
            done += len(new)

    def _link(self, near: np.ndarray, nodes: np.ndarray, options: np.ndarray) -> None:
        """Gives nodes diverse neighbours among their options (-1: none), and these the nodes as options."""
        near[nodes, :LINKS] = self._diverse(nodes, options)
        a, b = np.repeat(nodes, LINKS), near[nodes, :LINKS].ravel()
        a, b = a[b >= 0], b[b >= 0]
        order = np.lexsort((-np.einsum("kd,kd->k", self.unit[a], self.unit[b]), b))
        a, b = a[order], b[order]
        owners, first, count = np.unique(b, return_index=True, return_counts=True)
        place = np.arange(len(b)) - np.repeat(first, count)
        ok = place < LINKS
        back = np.full((len(owners), LINKS), -1)
        back[np.repeat(np.arange(len(owners)), count)[ok], place[ok]] = a[ok]
        for lo in range(0, len(owners), 1024):
            some = owners[lo : lo + 1024]
            near[some, :LINKS] = self._diverse(some, np.concatenate((near[some, :LINKS], back[lo : lo + 1024]), 1))

    def _diverse(self, nodes: np.ndarray, options: np.ndarray) -> np.ndarray:
        """Up to LINKS options of each node: nearest first those nearer to the node than to any one taken, then the nearest of the rest."""
        options = np.sort(options, axis=1)
        bad = (options < 0) | (options == nodes[:, None])
        bad[:, 1:] |= options[:, 1:] == options[:, :-1]
        sim = np.einsum("qd,qkd->qk", self.unit[nodes], self.unit[np.maximum(options, 0)])
        sim[bad] = -np.inf
        top = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * LINKS]
        options, sim = np.take_along_axis(options, top, 1), np.take_along_axis(sim, top, 1)
        v = self.unit[np.maximum(options, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        taken = np.zeros(options.shape, bool)
        for k in range(options.shape[1]):
            nearest = np.where(taken[:, :k], between[:, k, :k], -np.inf).max(1, initial=-np.inf)
            taken[:, k] = np.isfinite(sim[:, k]) & (nearest < sim[:, k]) & (taken[:, :k].sum(1) < LINKS)
        rank = np.argsort(np.where(taken, 0, np.where(np.isfinite(sim), 1, 2)), axis=1, kind="stable")[:, :LINKS]
        out = np.where(np.isfinite(np.take_along_axis(sim, rank, 1)), np.take_along_axis(options, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, LINKS - out.shape[1])), constant_values=-1)

    def _descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """Starts in a layer: what the layers above find."""
        start = np.zeros((len(q), 1), np.int64)
        for up in range(len(self.sizes) - 1, layer, -1):
            start, _ = self._beam(q, self.near[up], start, 4, self.sizes[up])
            start = start[:, :2] if (start[:, :2] >= 0).all() else start[:, :1]
        return start

    def _beam(self, q: np.ndarray, near: np.ndarray, start: np.ndarray, beam: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` of the first n nodes for each query (-1: fewer), and what was seen."""
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n), bool)
        np.put_along_axis(seen, start, True, 1)
        ids, sim = start, np.einsum("qd,qkd->qk", q, self.unit[start])
        done = np.zeros(ids.shape, bool)
        while True:
            todo = np.where(done, -np.inf, sim)
            pick = np.argsort(-todo, axis=1)[:, :STEP]
            live = np.take_along_axis(todo, pick, 1) > -np.inf
            if not live.any():
                return np.where(np.isfinite(sim), ids, -1), seen
            np.put_along_axis(done, pick, True, 1)
            new = near[np.take_along_axis(ids, pick, 1)].reshape(len(q), -1)
            new = np.sort(np.where(np.repeat(live, near.shape[1], 1), new, -1), axis=1)
            ok = (new >= 0) & (new < n)
            ok &= ~seen[rows, np.where(ok, new, 0)]
            ok[:, 1:] &= new[:, 1:] != new[:, :-1]
            at = np.nonzero(ok)
            seen[at[0], new[at]] = True
            s = np.full(new.shape, -np.inf, np.float32)
            s[at] = np.einsum("kd,kd->k", q[at[0]], self.unit[new[at]])
            ids, sim = np.concatenate((ids, np.maximum(new, 0)), 1), np.concatenate((sim, s), 1)
            done = np.concatenate((done, ~ok), 1)
            top = np.argsort(-sim, axis=1, kind="stable")[:, :beam]
            ids, sim, done = (np.take_along_axis(v, top, 1) for v in (ids, sim, done))

    def _search(self, q: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(queries, nodes) whose cosine is `least` or more in single precision: a beam, then a flood over what is within the margin."""
        n, near = len(self.unit), self.near[0]
        _, seen = self._beam(q, near, self._descend(q, 0), min(self.beam, n), n)
        row, node = np.nonzero(seen)  # also what the beam dropped
        sim = np.einsum("kd,kd->k", q[row], self.unit[node])
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            ok = sim >= least - 1e-5
            out.append((row[ok], node[ok]))
            go = sim >= least - self.margin
            row, node = np.repeat(row[go], near.shape[1]), near[node[go]].ravel()
            ok = node >= 0
            row, node = row[ok], node[ok]
            ok = ~seen[row, node]
            pair = np.unique(row[ok] * n + node[ok])
            row, node = pair // n, pair % n
            seen[row, node] = True
            wide = np.unique(node)
            if len(row) * 8 > len(q) * len(wide):  # most pairs of these are wanted: one product
                sim = (q @ self.unit[wide].T)[row, np.searchsorted(wide, node)]
            else:
                sim = np.einsum("kd,kd->k", q[row], self.unit[node])
        return tuple(np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out))

    def _widen(self) -> bool:
        """A wider beam and flood; false if the flood takes in all nodes already (the ring connects them)."""
        if self.margin > 2:
            return False
        self.beam, self.margin = self.beam + self.beam // 4, self.margin * 2
        return True

    def _probe(self, least: float) -> None:
        """Widens until probes at just over the least cosine find the members that they were made from."""
        rng, n = np.random.default_rng(7), len(self.unit)
        at = rng.choice(n, min(2 * AUDIT, n), replace=False)
        x = self.unit[at].astype(float)
        away = rng.normal(size=x.shape)
        away -= (away * x).sum(1, keepdims=True) * x
        size = np.sqrt((away**2).sum(1, keepdims=True))
        to = min(1.0, least + 0.1 * (1 - least))
        q = np.where(size > 1e-9, to * x + np.sqrt(1 - to**2) * away / np.maximum(size, 1e-9), x).astype(np.float32)
        while True:
            row, node = self._search(q, least)
            if len(np.unique(row[node == at[row]])) >= RECALL * len(at) or not self._widen():
                return

    def linked(self, q: np.ndarray, least: float, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(queries, members) of found pairs with a cosine of `least` or more, in double precision; own: the first query is this member, the others follow."""
        norm, width = np.sqrt((q**2).sum(1)), self.raw.shape[1]
        unit, q = fit(_unit(q), width), fit(q, width)
        sample = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))
        truth = (q[sample] @ self.raw.T) / (norm[sample, None] * self.norm[None, :]) >= least
        if own is not None:
            truth[np.arange(len(sample)), own + sample] = False
        while True:
            pairs = [self._search(unit[lo : lo + BLOCK], least) for lo in range(0, len(q), BLOCK)]
            row = np.concatenate([r + k * BLOCK for k, (r, _) in enumerate(pairs)])
            member = self.order[np.concatenate([m for _, m in pairs])]
            ok = np.zeros(len(row), bool)
            for lo in range(0, len(row), 65536):
                r, m = row[lo : lo + 65536], member[lo : lo + 65536]
                ok[lo : lo + 65536] = np.einsum("kd,kd->k", q[r], self.raw[m]) / (norm[r] * self.norm[m]) >= least
            row, member = row[ok], member[ok]
            place = np.full(len(q), -1)
            place[sample] = np.arange(len(sample))
            mine = place[row] >= 0
            hit = truth[place[row[mine]], member[mine]].sum()
            if self.found + hit >= RECALL * (self.true + truth.sum()) or not self._widen():
                self.found, self.true = self.found + int(hit), self.true + int(truth.sum())
                return row, member


def _local(mask: np.ndarray) -> np.ndarray:
    """Component of each node (its smallest position) of a symmetric link mask."""
    mask |= mask.T
    np.fill_diagonal(mask, True)
    label = np.arange(len(mask))
    while True:
        new = np.array([label[m].min() for m in mask])
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _label_cells(x: DataFrame, shard: int) -> dict[int, np.ndarray]:
    """Centres of the cells of labels over one shard, largest labels first, at most CELLS in all: members far from each other, of some eight a cell."""
    big = x.where("shards > 1").groupBy("part").agg(F.max("n").alias("n"), F.max("shards").alias("shards")).orderBy(F.col("n").desc(), "part").limit(CELLS).collect()
    spec, total = {}, 0
    for r in big:
        want = min(r.shards, CELLS_A_LABEL)
        if total + want <= CELLS:
            spec[r.part], total = want, total + want
    if not spec:
        return {}
    table = x.sparkSession.createDataFrame([(k, float(v)) for k, v in spec.items()], "part long, want double")
    few = x.join(F.broadcast(table), "part").where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) <= 1_000_000 * 8 * F.col("want") / F.col("n")).orderBy("part", "id")
    by: dict[int, list] = {}
    for r in few.select("part", "vec").collect():  # some 8 * CELLS vectors
        by.setdefault(r.part, []).append(r.vec)
    out = {}
    for part, vecs in by.items():
        width = max(map(len, vecs))
        m = _unit(np.array([list(v) + [0.0] * (width - len(v)) for v in vecs])).astype(float)
        chosen, far = [0], np.arccos(np.clip(m @ m[0], -1, 1))
        while len(chosen) < min(spec[part], len(m)) and far.max() > 1e-6:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.arccos(np.clip(m @ m[chosen[-1]], -1, 1)))
        out[part] = m[chosen]
    return out


def _angles(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    x = _unit(x).astype(float)
    width = max(x.shape[1], c.shape[1])
    x, c = (np.pad(y, ((0, 0), (0, width - y.shape[1]))) for y in (x, c))
    return np.arccos(np.clip(x @ c.T, -1, 1))


def _by_part(b, centers: dict):
    """The places of a batch's rows by part, where the part has centres."""
    part = b["part"].to_numpy()
    for k in np.unique(part):
        if k in centers:
            yield int(k), np.flatnonzero(part == k)


def _deal(centers: dict):
    """Adds cell and far: the nearest centre of the label and the angle to it; -1 without centres."""

    def run(batches):
        for b in batches:
            x, cell, far = matrix(b["vec"]), np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for k, at in _by_part(b, centers):
                a = _angles(x[at], centers[k])
                cell[at], far[at] = a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return run


def _visit(centers: dict, cells: dict, least: float):
    """The shard of each vector and the others of its label that may hold a link of it.

    With t the angle of the least cosine, a vector linked with q lies in cell c
    only if angle(q, c) <= t + the cell's radius, and, as c is its nearest
    centre, angle(q, c) <= 2 * t + the angle from q to its own nearest centre.
    """
    t = float(np.arccos(least)) + 1e-3

    def run(batches):
        for b in batches:
            x, ids = matrix(b["vec"]), b["id"].to_numpy()
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            shards = b["shards"].to_numpy()
            own = (mixed % shards.astype(np.uint64)).astype(np.int64)
            visits = [[s for s in range(n) if s != o] if n > 1 else [] for n, o in zip(shards.tolist(), own.tolist())]
            for k, at in _by_part(b, centers):
                names, radius, pieces = (np.array(c) for c in zip(*cells[k]))
                first = np.cumsum(pieces) - pieces
                angle = _angles(x[at], centers[k][names])
                near = (angle <= t + radius) & (angle <= 2 * t + angle.min(1, keepdims=True))
                home = np.searchsorted(names, b["cell"].to_numpy()[at])
                for i, row in enumerate(at):
                    own[row] = first[home[i]] + int(mixed[row]) % int(pieces[home[i]])
                    visits[row] = [int(first[c]) + p for c in np.flatnonzero(near[i]) for p in range(pieces[c]) if first[c] + p != own[row]]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("part", "blocks", "id", "extra", "vec")), pa.array(own), pa.array(visits, pa.list_(pa.int64()))], ["part", "blocks", "id", "extra", "vec", "own", "visits"])

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, audited=None) -> DataFrame:
    """Links and components of vectors with equal labels and a cosine of `least` or more.

    vectors: vec_id long, embedding array, label; other columns are ignored.
    Returns a row for each row: vec_id, n_links, component_id, kept. audited: two
    accumulators that get the links found and true of all audits.

    Vectors that are null, zero or hold null or non-finite components, and rows
    with a null label or vec_id, link with nothing; a null vec_id has a null
    component_id and kept. Repeated rows are linked to each other. An empty
    table gives an empty one.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label"))
    some = F.exists("vec", lambda x: x != 0)
    ok = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec"))).where(some)
    u = cut(ok.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("extra")))
    size = u.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("part"))
    size = size.withColumn("shards", F.ceil(F.col("n") / shard)).withColumn("blocks", F.ceil(F.col("n") / (16 * shard)))
    x = u.join(size, "label").select("part", "n", "shards", "blocks", "id", "extra", "vec")
    centers = _label_cells(x, shard)
    x = cut(x.mapInArrow(_deal(centers), "part long, n long, shards long, blocks long, id long, extra long, vec array<double>, cell long, far double"))
    known = x.where("cell >= 0").groupBy("part", "cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect() if centers else []  # at most CELLS rows
    cells = {k: sorted((r.cell, r.far, -(-r.n // shard)) for r in known if r.part == k) for k in centers}
    x = x.mapInArrow(_visit(centers, cells, least), "part long, blocks long, id long, extra long, vec array<double>, own long, visits array<long>")
    x = x.withColumn("blk", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")))
    members = x.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).selectExpr("part", "own as shard", "block", "0 as kind", "id", "extra", "vec")
    asked = x.select("part", F.explode("visits").alias("shard"), F.col("blk").alias("block"), F.lit(1).alias("kind"), "id", "extra", "vec")

    def rows(ids, links, peers) -> pa.Table:
        return pa.table({"id": pa.array(ids, pa.int64()), "links": pa.array(links, pa.int64()), "peer": pa.array(peers, pa.int64())})

    def index(m, block):
        ids, extra, x_ = m
        g = Graph(x_, extra, least)
        mask = np.zeros((len(x_), len(x_)), bool)
        for lo in range(0, len(x_), 2048):
            q, member = g.linked(x_[lo : lo + 2048], least, lo)
            mask[q + lo, member] = True
        tell(g, block == 0)
        label = _local(mask)
        np.fill_diagonal(mask, False)
        return (g, label, ids), rows(*((ids, mask @ extra, ids[label]) if block == 0 else ((), (), ())))

    def tell(g: Graph, first: bool = True) -> None:
        if audited is not None and first:
            audited[0].add(g.found)
            audited[1].add(g.true)
        g.found = g.true = 0

    def ask(state, m):
        g, label, ids = state
        qids, _, q = m
        row, member = g.linked(q, least)
        tell(g)
        count = np.bincount(row, g.weight[member], minlength=len(q)).astype(np.int64)
        pair = np.unique(row * len(ids) + label[member])
        row, root = pair // len(ids), pair % len(ids)
        first = np.ones(len(row), bool)
        first[1:] = row[1:] != row[:-1]
        return rows(qids[row], np.where(first, count[row], 0), ids[root])

    found = cut(search(members.unionByName(asked), index, ask, "id long, links long, peer long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found, "id", "peer")
    named = u.join(links, "id", "left").join(comp, F.col("id") == F.col("node"), "left")
    named = named.select("label", "vec", (F.col("extra") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    good = F.col("vec_id").isNotNull()
    out = v.join(named, ["label", "vec"], "left").withColumn("component_id", F.when(good, F.coalesce("component", "vec_id")))
    return out.select("vec_id", F.when(good, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
