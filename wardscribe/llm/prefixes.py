"""Conversation prefix trie from mergeable partial tries.

A node is a distinct sequence of first turns. Its key is 128 bits: two sums of
hashes of the turns so far, each hashed with its depth. A partial trie is a
table of (key, depth) with sums and minima, so partial tries merge by key:

1. Conversations are dealt by ranges of their ids. A task combines the rows that
   it meets into a partial trie; merges of FAN partial tries at a time, by key,
   leave one row a node, with its members, its smallest and its longest one.
2. Nodes whose smallest member is c are a tail of c's own path, from the depth
   at which c leaves the paths of smaller conversations. With that depth, a
   conversation's rows give every node's share of the subtree sums bottom-up:
   the texts that c alone adds below, whether it ends a leaf, and whether it
   starts a child. A second pass of partial tries and merges adds the shares.
3. End lists stay blocks of at most BLOCK ascending ids. A task's ids all lie
   below those of the next range, so a node's list is its blocks in order of
   their first id; their digest is taken block by block.

No row grows with a node's members, and no list is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut, partitions
from .textkit import tidy

FAN, BLOCK = 32, 4096
_KEY = ["k1", "k2", "depth"]
_SUMS = {"members": "sum", "least": "min", "longest": "max", "before": "max", "chars": "max"}
_SHARES = {"starts": "sum", "leaves": "sum", "saved": "sum"}


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text; by turn, null first, equal turns by role and text."""
    d = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return d.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "role", "text")


def conversations(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as what prefix_trie takes."""
    return _ordered(turns)


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Every conversation c as the first h turns of conversation c - c % group, then its own after its first h; h = crc32(c) % heads.

    turns: conv_id long, turn, role string, text string; other columns are
    ignored. Null roles and texts are empty, a null turn comes first, equal
    turns are ordered by role and text, rows without a conv_id take no part.
    Returns conv_id, pos, role, text; pos is null in the one row of a
    conversation that has no turns left.
    """
    own = _ordered(turns)
    own = cut(own)
    ids = own.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    first = own.where(f"conv_id % {group} = 0 and pos < {heads}").withColumnRenamed("conv_id", "base")
    given = ids.join(first, "base").where("pos <= h").select("conv_id", "pos", "role", "text")
    rest = own.join(ids, "conv_id").where("pos > h").select("conv_id", F.col("pos") + heads, "role", "text")
    none = ids.select("conv_id", *[F.lit(None).cast(t) for t in ("long", "string", "string")])
    return given.union(rest).union(none)


def _paths(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth (0 for the root): conv_id, k1, k2, depth, chars, before (characters above), longest, total, range (of ids)."""
    turn = lambda salt: F.xxhash64(F.lit(salt), "role", "text")
    d = turns.where("pos is not null").select("conv_id", "pos", turn(1).alias("t1"), turn(2).alias("t2"), F.char_length("text").cast("long").alias("chars"))
    zero = F.lit(0).cast("long")
    root = turns.select("conv_id").distinct().select("conv_id", F.lit(-1).cast("long"), zero, zero, zero)
    d = d.union(root).repartitionByRange(partitions(turns.sparkSession), "conv_id")
    order = Window.partitionBy("conv_id").orderBy("pos")
    whole = Window.partitionBy("conv_id")
    d = d.withColumn("depth", (F.row_number().over(order) - 1).cast("long"))
    for k in ("1", "2"):
        x = F.when(F.col("depth") > 0, F.xxhash64("depth", f"t{k}")).otherwise(0).cast("decimal(20, 0)")
        d = d.withColumn("_sum", F.sum(x).over(order))
        rest = "pmod(_sum, 18446744073709551616bd)"  # modulo 2 ** 64, then into the range of a long
        d = d.withColumn(f"k{k}", F.expr(f"cast({rest} - if({rest} >= 9223372036854775808bd, 18446744073709551616bd, 0bd) as long)"))
    d = d.withColumn("before", F.sum("chars").over(order) - F.col("chars"))
    return d.select("conv_id", "k1", "k2", "depth", "chars", "before", F.max("depth").over(whole).alias("longest"), F.sum("chars").over(whole).alias("total"), F.spark_partition_id().alias("range"))


def _merged(rows: DataFrame, how: dict[str, str]) -> DataFrame:
    """One row a node: tasks combine theirs, then FAN partial tries at a time are merged by key."""

    @tidy
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(_KEY).aggregate([(c, f) for c, f in how.items()])
            yield from t.rename_columns({f"{c}_{f}": c for c, f in how.items()}).select([*_KEY, *how]).to_batches()

    def merge(d: DataFrame, *keys: str) -> DataFrame:
        return d.groupBy(*_KEY, *keys).agg(*[getattr(F, f)(c).alias(c) for c, f in how.items()])

    d = rows.mapInArrow(combine, ", ".join(f"{c} long" for c in [*_KEY, *how])).withColumn("trie", F.spark_partition_id())
    tries = rows.rdd.getNumPartitions()
    while tries > FAN:
        d = merge(d.withColumn("trie", (F.col("trie") / FAN).cast("int")), "trie")
        tries = -(-tries // FAN)
    return merge(d)


def _end_lists(paths: DataFrame) -> DataFrame:
    """k1, k2, depth, ends_sha256, n_ends of the nodes at which conversations end."""

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).sort_by([("k1", "ascending"), ("k2", "ascending"), ("depth", "ascending"), ("conv_id", "ascending")])
            key = np.column_stack([t[c].to_numpy() for c in [*_KEY, "range"]])  # a batch may hold ranges that are not neighbours
            new = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))) if len(key) else np.zeros(0, int)
            cuts = np.unique(np.concatenate([np.arange(a, z, BLOCK) for a, z in zip(new, np.append(new[1:], len(key)))])) if len(key) else new
            ids = t["conv_id"].combine_chunks()
            yield pa.RecordBatch.from_arrays([*(pa.array(key[cuts, k]) for k in range(3)), ids.take(pa.array(cuts)), pa.ListArray.from_arrays(pa.array(np.append(cuts, len(key)), pa.int32()), ids)], [*_KEY, "first", "ids"])

    @tidy
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, n = None, None, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_KEY, now)) | {"ends_sha256": sha.hexdigest(), "n_ends": n}], kinds)

        for b in batches:
            for *key, ids in zip(*(b[c].to_pylist() for c in [*_KEY, "ids"])):
                if key != now:
                    if now is not None:
                        yield done()
                    now, sha, n = key, hashlib.sha256(), 0
                sha.update(("," * (n > 0) + ",".join(map(str, ids))).encode())
                n += len(ids)
        if now is not None:
            yield done()

    kinds = pa.schema([*((c, pa.int64()) for c in _KEY), ("ends_sha256", pa.string()), ("n_ends", pa.int64())])
    ends = paths.where("depth = longest").select(*_KEY, "conv_id", "range").mapInArrow(blocks, "k1 long, k2 long, depth long, first long, ids array<long>")
    ends = ends.repartition(partitions(paths.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "first")
    return ends.mapInArrow(digest, "k1 long, k2 long, depth long, ends_sha256 string, n_ends long")


def prefix_trie(turns: DataFrame, texts: bool = False) -> DataFrame:
    """A row for each distinct sequence of first turns, from the root without any on.

    turns: conv_id long, pos long (null: no turn), role string, text string.
    Returns conv_id (the smallest member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes of the subtree, itself
    included), saved_tokens (over the subtree, members but one times characters
    of the last text), n_ends, ends_sha256 (of the decimal ids that end here,
    ascending, joined by commas), and with texts the last turn's role and text.
    A conversation without turns is a member of the root. An empty table gives
    an empty one.
    """
    paths = cut(_paths(turns))
    nodes = cut(_merged(paths.select(*_KEY, F.lit(1).cast("long").alias("members"), F.col("conv_id").alias("least"), "longest", "before", "chars"), _SUMS))
    tails = nodes.groupBy(F.col("least").alias("conv_id")).agg(F.min("depth").alias("own"), F.min("before").alias("own_before"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    mine = paths.join(tails, "conv_id", "left")
    own = F.col("own")
    shares = mine.select(
        *_KEY,
        F.coalesce(((own <= F.col("depth") + 1) & (F.col("depth") < F.col("longest"))).cast("long"), F.lit(0).cast("long")).alias("starts"),
        F.coalesce("leaf", F.lit(0).cast("long")).alias("leaves"),
        F.greatest(F.coalesce("own_before", "total") - F.col("before"), F.lit(0).cast("long")).alias("saved"),
    )
    sums = _merged(shares, _SHARES)
    # the parent of a node inside its member's tail has the same member; only a tail's first node has to look
    heads = mine.where("depth = own - 1").select("conv_id", *_KEY).join(nodes.select(*_KEY, F.col("least").alias("parent")), _KEY).select(F.col("conv_id").alias("least"), (F.col("depth") + 1).alias("depth"), "parent")
    d = nodes.join(sums, _KEY).join(_end_lists(paths), _KEY, "left").join(heads, ["least", "depth"], "left")
    out = d.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "least")).alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("starts").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("n_ends", F.lit(0).cast("long")).alias("n_ends"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    if not texts:
        return out
    place = Window.partitionBy("conv_id").orderBy("pos")
    last = turns.where("pos is not null").select("conv_id", F.row_number().over(place).cast("long").alias("depth"), "role", "text")
    return out.join(last, ["conv_id", "depth"], "left")
