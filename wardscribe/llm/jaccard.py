"""Exact n-gram Jaccard join, reduced to components, with a token-group matrix.

1. Documents with equal shingle sets collapse by a 128-bit set fingerprint.
2. Each set sends the tokens of its prefix (its smallest hashes: n minus the
   overlap it needs, plus a tenth), once for each chunk of documents, and hears
   which of them another chunk has. Two linked sets share at least that tenth
   inside both prefixes, so a set with fewer shared prefix tokens links with
   nothing and goes.
3. The survivors are partitioned into groups of similar sets: min-hash bands
   name a leader, the exact Jaccard value confirms it, components are groups.
4. Prefixes are taken again with rare tokens first. The matrix has a row for
   each prefix token of each group and size class: the sizes and the first place
   of the members that have it. A set opens a group at a token where these leave
   room for a link; the row keeps the token, so no other token of the set or the
   group is joined to it.
5. A set is compared exactly with those members of an opened group that have
   that token and pass the size and position bounds. Pairs inside a group are
   never formed: their links are known.

All rows are in proportion to the tokens, whatever the number of chunks: a
token or a copy that a third of all documents hold is one row a chunk. Tokens
are ordered by the power of two of their bucket's count in a sketch of SKETCH
counts, so the order costs a fixed size; any order gives the same links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .session import cut
from .substrings import chunks, shared_rows
from .textkit import U, Words, mix, pack48, slices, tidy, unpack48

CHUNK_DOCS, CHUNK_BYTES, BANDS, ROWS, SKETCH, CLASS = 2000, 8_000_000, 4, 3, 2**18, 1.02


class _Sets:
    """Shingle sets of a text column: row i holds tokens[at[i]:at[i + 1]], ascending."""

    def __init__(self, col, size: int):
        w = Words(col, lower=True)
        self.rows = len(w.offs) - 1
        at = w.windows(size)
        h, doc = w.roll(at, size, 5), w.doc[at]
        n = np.diff(w.first)
        for k in range(1, size):  # too short for one shingle: the whole sequence
            short = np.flatnonzero(n == k)
            if len(short):
                h = np.concatenate((h, w.roll(w.first[short], k, 5)))
                doc = np.concatenate((doc, short))
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        self.tokens, self.doc = h[new], doc[new]
        self.at = np.searchsorted(self.doc, np.arange(self.rows + 1))
        self.n = np.diff(self.at)

    def prints(self) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            out = []
            for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                run = np.concatenate((np.zeros(1, U), np.cumsum(mix(self.tokens * U(k)), dtype=U)))
                out.append((run[self.at[1:]] - run[self.at[:-1]]).view(np.int64))
        return out[0], out[1]

    def bands(self, row: int) -> list[int]:
        t, out = self.tokens[self.at[row] : self.at[row + 1]], []
        with np.errstate(over="ignore"):
            low = [int(mix(t ^ U(0xA24BAED4963EE407 * (k + 1) % 2**64)).min()) for k in range(BANDS * ROWS)]
        for b in range(BANDS):
            x = U(b)
            for v in low[b * ROWS : (b + 1) * ROWS]:
                x = mix(np.array([x ^ U(v)]))[0]
            out.append(int(np.int64(x)) if x < 2**63 else int(x) - 2**64)
        return out


def _needs(n, percent: int):
    """The least overlap of a set of n with any set that it links with."""
    return (n * percent + 99) // 100


def _prefix(n, percent: int):
    return np.minimum(n, n - _needs(n, percent) + np.maximum(1, n // 10))


def _enough(n, percent: int):
    return np.maximum(1, _needs(n, percent) // 10)


def _only_equal(n, percent: int):
    """Sets of n link with equal ones only."""
    return 100 * n < percent * (n + 1)


def _sets_of(table: pa.Table, side: pa.Table, size: int, percent: int) -> tuple[_Sets, np.ndarray, np.ndarray]:
    """The chunk's sets, the rows that stand for their set, and their ids."""
    s = _Sets(table["text"], size)
    f1, f2 = s.prints()
    ids = table["doc_id"].to_numpy()
    mine = set(zip(side["rep"].to_pylist(), side["f1"].to_pylist(), side["f2"].to_pylist()))
    rows = []
    for i in np.flatnonzero(~_only_equal(s.n, percent) & (s.n > 0)):
        key = (int(ids[i]), int(f1[i]), int(f2[i]))
        if key in mine:
            mine.discard(key)
            rows.append(i)
    return s, np.array(rows, np.int64), ids


class _Prefixes:
    """The prefix tokens of one chunk's sets."""

    def __init__(self, s: _Sets, rows: np.ndarray, percent: int):
        p = _prefix(s.n[rows], percent)
        at = np.repeat(s.at[rows], p) + np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
        self.owner = np.repeat(np.arange(len(rows)), p)
        self.uniq, self.which, self.times = np.unique(s.tokens[at].view(np.int64), return_inverse=True, return_counts=True)

    def shared(self, told: np.ndarray) -> np.ndarray:
        """For each token: whether another set holds it; told: tokens of other chunks."""
        return ((self.times > 1) | np.isin(self.uniq, told))[self.which]


def _survivors(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Sets that may link with an unequal one: doc, n, tokens (48 bits each), bands, share (of its prefix that others have). docs has chunk, reps as well."""
    d = docs.where("doc_id is not null").select("chunk", "doc_id", "text")
    side = reps.select("chunk", "rep", "f1", "f2", F.lit(None).cast("long").alias("token"))

    @tidy
    def send(table: pa.Table, side: pa.Table) -> pa.Table:
        tokens, chunk = np.zeros(0, np.int64), None
        if table.num_rows and side.num_rows:
            s, mine, _ = _sets_of(table, side, size, percent)
            tokens, chunk = _Prefixes(s, mine, percent).uniq, table["chunk"][0].as_py()
        return pa.table({"chunk": pa.array([chunk] * len(tokens), pa.int64()), "token": pa.array(tokens)})

    @tidy
    def keep(table: pa.Table, side: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if table.num_rows and side.num_rows:
            s, mine, ids = _sets_of(table, side.filter(side["rep"].is_valid()), size, percent)
            p = _Prefixes(s, mine, percent)
            hit = p.shared(side["token"].drop_null().to_numpy())
            count = np.bincount(p.owner[hit], minlength=len(mine))
            share = dict(zip(mine, count / np.maximum(1, _prefix(s.n[mine], percent))))
            for i in mine[count >= _enough(s.n[mine], percent)]:
                out[0].append(int(ids[i]))
                out[1].append(int(s.n[i]))
                out[2].append(pack48(s.tokens[s.at[i] : s.at[i + 1]]))
                out[3].append(s.bands(i))
                out[4].append(float(share[i]))
        return pa.table({"doc": pa.array(out[0], pa.int64()), "n": pa.array(out[1], pa.int64()), "tokens": pa.array(out[2], pa.binary()), "bands": pa.array(out[3], pa.list_(pa.int64())), "share": pa.array(out[4], pa.float64())})

    sent = d.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(send, "chunk long, token long")
    # one plan and equal inputs: Spark shuffles the texts by chunk once and reads that shuffle twice
    told = shared_rows(sent, "token", "chunk").select("chunk", *[F.lit(None).cast("long").alias(c) for c in ("rep", "f1", "f2")], "token")
    return cut(d.groupBy("chunk").cogroup(side.unionByName(told).groupBy("chunk")).applyInArrow(keep, "doc long, n long, tokens binary, bands array<long>, share double"))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard value suffices."""
    x = pairs.join(sets.select(F.col("doc").alias("a"), F.col("n").alias("an"), F.col("tokens").alias("at")), "a").join(sets.select(F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("tokens").alias("bt")), "b")

    @tidy
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for n, m, s, t in zip(b["an"].to_pylist(), b["bn"].to_pylist(), b["at"].to_pylist(), b["bt"].to_pylist()):
                both = len(np.intersect1d(unpack48(s), unpack48(t), assume_unique=True))
                ok.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return x.select("a", "b", "an", "bn", "at", "bt").mapInArrow(check, "a long, b long")


def _rarity(sets: DataFrame) -> np.ndarray:
    """The power of two of the number of tokens in each bucket of the sketch: SKETCH counts, whatever the input."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)
        for b in batches:
            for blob in b["tokens"].to_pylist():
                np.add.at(total, (mix(unpack48(blob)) % U(SKETCH)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    found = sets.select("tokens").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    power = np.zeros(SKETCH, np.uint8)
    power[found["k"].to_numpy()] = np.floor(np.log2(found["n"].to_numpy())).astype(np.uint8)
    return power


def _prefix_rows(sets: DataFrame, percent: int) -> DataFrame:
    """(doc, n, pos, token): each set's prefix, rare tokens first."""
    power = _rarity(sets)

    @tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                tokens = []
                for blob in part["tokens"].to_pylist():
                    x = mix(unpack48(blob))
                    tokens.append(x[np.lexsort((x, power[(x % U(SKETCH)).astype(np.int64)]))[: int(_prefix(np.int64(len(x)), percent))]].view(np.int64))
                size = np.array([len(t) for t in tokens])
                row = pa.array(np.repeat(np.arange(len(size)), size))
                pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([part["doc"].take(row), part["n"].take(row), pa.array(pos), pa.array(np.concatenate(tokens))], ["doc", "n", "pos", "token"])

    return sets.select("doc", "n", "tokens").mapInArrow(rows, "doc long, n long, pos long, token long")


def _rooms(first: DataFrame, percent: int) -> DataFrame:
    """first with own (the class of a set's size) and partner: the classes of sizes for which its token's place leaves room for a link.

    Two sets of n and m whose first common token has the places i and j share
    min(n - i, m - j) tokens at most, and need percent / (100 + percent) of n + m.
    Common tokens come late, where hardly a class is left, so sets that have
    nothing but them in common do not meet, however many they are.
    """
    step = math.log(CLASS)
    size_class = lambda n: F.floor(F.log(n) / step).cast("int")
    n = F.col("n")
    reach = F.sequence(size_class(F.greatest(n * percent / 100, F.lit(1.0))), size_class(n * 100 / percent))
    least = F.pow(F.lit(CLASS), F.col("partner")) * 0.999  # no size of the class is below
    return first.withColumn("own", size_class(n)).withColumn("partner", F.explode(reach)).where((100 + percent) * (n - F.col("pos")) >= percent * (n + least))


def _met(first: DataFrame, percent: int) -> DataFrame:
    """(doc, n, pos, token, other): groups that a set meets at a token and by both classes."""
    rows = _rooms(first, percent)
    groups = rows.groupBy("token", F.col("own").alias("partner"), F.col("partner").alias("own"), F.col("grp").alias("other")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("pos").alias("first"))
    fits = f"grp < other and 100 * n >= {percent} * least and 100 * most >= {percent} * n and {100 + percent} * least(n - pos, most - first) >= {percent} * (n + least)"
    return rows.join(groups, ["token", "own", "partner"]).where(fits).select("doc", "n", "pos", "token", "other").distinct()


def _group_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of sets of different groups that may link, from the groups that each set opens.

    The first token that two linked sets have in common passes every bound, so
    it alone brings them together; the set's other tokens are not asked.
    """
    need = F.ceil(F.col("n") * percent / 100)
    enough = F.greatest(F.lit(1), F.floor(need / 10))
    t = _prefix_rows(sets, percent).join(groups, F.col("doc") == F.col("node"), "left").select("doc", "n", "pos", "token", F.coalesce("component", "doc").alias("grp"))
    several = t.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token")
    t = t.join(several, "token", "left_semi")
    some = t.groupBy("doc").agg(F.count("*").alias("c"), F.max("n").alias("n")).where(F.col("c") >= enough).select("doc")
    first = t.where(F.col("pos") <= F.col("n") - need)  # linked sets share a token here
    first = cut(first.join(some, "doc", "left_semi"))
    x = _met(first, percent).select(F.col("doc").alias("a"), F.col("other").alias("grp"), "token", F.col("n").alias("an"), F.col("pos").alias("i"))
    y = first.select("grp", "token", F.col("doc").alias("b"), F.col("n").alias("bn"), F.col("pos").alias("j"))
    near = f"100 * least(an, bn) >= {percent} * greatest(an, bn) and {100 + percent} * least(an - i, bn - j) >= {percent} * (an + bn)"
    return x.join(y, ["grp", "token"]).where(near).select("a", "b").distinct()


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, chunk_docs: int = CHUNK_DOCS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Documents linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct word shingles.

    docs: doc_id long, text string; other columns are ignored. Returns a row for
    each row: doc_id, n_shingles, component_id (the smallest doc_id reachable).
    A-Z is lower-cased. A text with fewer words than a shingle is one shingle;
    without words (or null) the set is empty and links with nothing.

    A null doc_id takes no part: its component_id is null. Repeated rows and
    repeated ids share a component. An empty table gives an empty one.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    @tidy
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                s = _Sets(b["text"], words)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s.n), *map(pa.array, s.prints())], ["doc_id", "n", "f1", "f2"])

    slim = cut(d.mapInArrow(prints, "doc_id long, n long, f1 long, f2 long"))
    reps = cut(slim.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")))
    n = F.lit(chunks(d, chunk_docs, chunk_bytes))
    few = reps.where(~_only_equal(F.col("n"), percent)).withColumn("chunk", F.pmod(F.xxhash64("rep"), n))
    sets = _survivors(d.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), n)), few, words, percent)

    best = F.struct((-F.col("share")).alias("s"), F.col("doc").alias("doc"))
    each = sets.select("doc", best.alias("own"), F.posexplode("bands").alias("band", "key"))
    lead = each.groupBy("band", "key").agg(F.min("own").alias("lead"))
    near = each.join(lead, ["band", "key"]).groupBy("doc").agg(F.min("lead").alias("lead")).select("doc", F.col("lead.doc").alias("lead")).where("lead != doc")
    links = cut(_links(near.select(F.col("lead").alias("a"), F.col("doc").alias("b")), sets, percent))

    links = links.union(_links(_group_pairs(sets, components(links, "a", "b"), percent), sets, percent))

    found = components(links, "a", "b")
    named = reps.join(found, reps.rep == found.node, "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = slim.join(named, ["f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
