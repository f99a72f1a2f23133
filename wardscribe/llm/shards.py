"""Streams vector shards through a task: first a shard's members, then its queries in bounded blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import partitions

BLOCK = 2048


def matrix(col) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(n.max()) if len(n) else 0
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    for b in batches:
        key = np.column_stack([b[c].to_numpy() for c in ("part", "shard", "block", "kind")])
        cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if lo < hi:
                yield tuple(key[lo, :3]), int(key[lo, 3]), b.slice(lo, hi - lo)


def search(rows: DataFrame, index: Callable, ask: Callable, schema: str) -> DataFrame:
    """rows: part, shard, block int or long, kind int (0 member, 1 query), id long, extra long, vec array.

    index(members as (ids, extras, matrix), block) gives (state, table to yield);
    ask(state, queries) gives a table. Members are sent with each block. A task holds one shard and one block of
    queries at a time; queries of a shard without members are skipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, state = None, [], None

        def rows_of(parts: list[pa.RecordBatch]):
            t = pa.Table.from_batches(parts)
            return t["id"].to_numpy(), t["extra"].to_numpy(), matrix(t["vec"])

        waiting, n_wait = [], 0
        for key, kind, b in _runs(batches):
            if key != now:
                if held and state is None:
                    state, out = index(rows_of(held), now[2])
                    yield from out.to_batches()
                if waiting and state is not None:
                    yield from ask(state, rows_of(waiting)).to_batches()
                now, held, state, waiting, n_wait = key, [], None, [], 0
            if kind == 0:
                held.append(b)
                continue
            if state is None and held:
                state, out = index(rows_of(held), now[2])
                held = []
                yield from out.to_batches()
            waiting.append(b)
            n_wait += b.num_rows
            if n_wait >= BLOCK:
                if state is not None:
                    yield from ask(state, rows_of(waiting)).to_batches()
                waiting, n_wait = [], 0
        if held and state is None:
            state, out = index(rows_of(held), now[2])
            yield from out.to_batches()
        if waiting and state is not None:
            yield from ask(state, rows_of(waiting)).to_batches()

    n = partitions(rows.sparkSession)
    dealt = rows.select("part", "shard", "block", "kind", "id", "extra", "vec").repartition(n, "part", "shard", "block")
    return dealt.sortWithinPartitions("part", "shard", "block", "kind", "id").mapInArrow(run, schema)


def fit(x: np.ndarray, width: int) -> np.ndarray:
    """The first `width` columns, filled with zeros."""
    return np.pad(x[:, :width], ((0, 0), (0, max(0, width - x.shape[1]))))


def finite(col: Column) -> Column:
    """Whether an array is not null and holds neither null nor a non-finite number."""
    x = F.forall(col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return col.isNotNull() & F.coalesce(x, F.lit(False))
