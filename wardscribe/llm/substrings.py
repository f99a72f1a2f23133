"""Substring dedup by difference-cover anchors.

A window is 13 consecutive words. Words at positions p with p mod 7 in
{0, 1, 3} start anchors of 7 words. {0, 1, 3} is a difference cover modulo 7,
so of two equal windows, wherever they lie, at least one anchor lies at the
same place inside both. A window whose three anchors occur in one document
only is therefore unique and is never looked at again; the others are extended
to the full 13 words, hashed with 95 bits and compared.

Documents are dealt into chunks by a hash, some CHUNK_DOCS documents and
CHUNK_BYTES of text each. The tasks that read the texts send the anchors of
each chunk, a row for each in a slice of texts, which are sorted; a chunk hears
once which of its anchors another chunk has. It then sends each distinct window
with such an anchor as one row with the smallest doc_id that has it here, and
hears for which another chunk has a smaller one. Words go
that such a window covers, or one that an earlier document of the chunk has. Rows
are in proportion to the words whatever the number of chunks, sorts spill, and
a passage that a third of all documents hold is one row a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import cut
from .textkit import U, Words, slices, tidy

WINDOW, PERIOD, COVER, ANCHOR = 13, 7, (0, 1, 3), 7
ANCHOR_BITS = 40
CHUNK_DOCS, CHUNK_BYTES = 2000, 8_000_000
NO_ID = np.iinfo(np.int64).max


def _anchor_hashes(w: Words, at: np.ndarray) -> np.ndarray:
    """The leading bits of an anchor's hash: anchors only choose the windows to compare, so one that equals another by chance costs a window and changes no result."""
    return (w.roll(at, ANCHOR, 1) >> U(64 - ANCHOR_BITS)).astype(np.int64)


class _Chunk:
    """Words, anchors and windows of one chunk's documents."""

    def __init__(self, table: pa.Table):
        self.words = w = Words(table["text"])
        self.ids = table["doc_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        at = w.windows(ANCHOR)
        place = at - w.first[w.doc[at]]
        self.at = at[np.isin(place % PERIOD, COVER)]
        self.anchors, self.which = np.unique(_anchor_hashes(w, self.at), return_inverse=True)

    def candidates(self, anchors: np.ndarray | None = None, windows: np.ndarray | None = None) -> None:
        """Keeps the windows that hold one of the anchors of other chunks or, without these, one that two documents here hold; and the given windows (first hashes)."""
        w = self.words
        if anchors is not None:
            shared = np.isin(self.anchors, anchors)
        else:
            low = np.full(len(self.anchors), NO_ID)
            high = np.full(len(self.anchors), -NO_ID)
            owner = self.ids[w.doc[self.at]]
            np.minimum.at(low, self.which, owner)
            np.maximum.at(high, self.which, owner)
            shared = low < high
        held = np.zeros(len(w.starts) + 1, np.int64)
        held[self.at[shared[self.which]]] = 1
        run = np.concatenate(([0], np.cumsum(held)))
        at = w.windows(WINDOW)
        keep = run[at + WINDOW - ANCHOR + 1] > run[at]
        if windows is not None:
            keep |= np.isin(w.roll(at, WINDOW, 2).view(np.int64), windows)
        self.wat = at[keep]
        a, c = w.roll(self.wat, WINDOW, 2).view(np.int64), (w.roll(self.wat, WINDOW, 3) >> U(33)).astype(np.int64)
        order = np.lexsort((c, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (c[order[1:]] != c[order[:-1]])
        self.wwhich = np.empty(len(order), np.int64)
        self.wwhich[order] = np.cumsum(new) - 1
        self.a, self.c = a[order[new]], c[order[new]]
        self.wlow = np.full(len(self.a), NO_ID)
        np.minimum.at(self.wlow, self.wwhich, self.ids[w.doc[self.wat]])

    def removed(self, told: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """A mask of the words that a repeated window covers; told: windows that another chunk has in an earlier document."""
        w = self.words
        mine, theirs = (np.rec.fromarrays(k, names="a,c") for k in ((self.a, self.c), told))
        earlier = np.isin(mine, theirs)
        gone = self.wat[earlier[self.wwhich] | (self.ids[w.doc[self.wat]] > self.wlow[self.wwhich])]
        step = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(step, gone, 1)
        np.add.at(step, gone + WINDOW, -1)
        return np.cumsum(step[:-1]) > 0


def _chunk_of(table: pa.Table) -> int:
    return table["chunk"][0].as_py()


@tidy
def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each chunk, distinct within a slice of a task's rows; texts stay where they are."""
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part["text"])
            at = w.windows(ANCHOR)
            at = at[np.isin((at - w.first[w.doc[at]]) % PERIOD, COVER)]
            chunk, a = part["chunk"].to_numpy()[w.doc[at]], _anchor_hashes(w, at)
            order = np.lexsort((a, chunk))
            chunk, a = chunk[order], a[order]
            new = np.append(True, (a[1:] != a[:-1]) | (chunk[1:] != chunk[:-1])) if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(chunk[new]), pa.array(a[new])], ["chunk", "a"])


def _column(marks: pa.Table, name: str) -> np.ndarray:
    return marks[name].to_numpy().astype(np.int64)


@tidy
def _windows(table: pa.Table, marks: pa.Table) -> pa.Table:
    if not table.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("chunk", "a", "c", "low")})
    c = _Chunk(table)
    c.candidates(anchors=_column(marks, "a"))  # any place of a window that another chunk has holds an anchor that it has too
    return pa.table({"chunk": pa.array(np.full(len(c.a), _chunk_of(table))), "a": pa.array(c.a), "c": pa.array(c.c), "low": pa.array(c.wlow)})


def shared_rows(rows: DataFrame, by: str, other: str) -> DataFrame:
    """The rows (by, other) whose `by` another row has too, repeated ones included."""
    w = Window.partitionBy(by).orderBy(other)
    return rows.withColumn("_b", F.lag(other).over(w)).withColumn("_n", F.lead(other).over(w)).where("_b is not null or _n is not null").drop("_b", "_n")


def _elsewhere(anchors: DataFrame) -> DataFrame:
    """Each (chunk, a) once whose anchor another chunk has: a chunk's last row tells, by the first chunk of all and the next."""
    w = Window.partitionBy("a").orderBy("chunk")
    rows = anchors.withColumn("_next", F.lead("chunk").over(w)).withColumn("_first", F.first("chunk").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where("_next <> chunk or (_next is null and _first <> chunk)").select("chunk", "a")


def _digest(w: Words, gone: np.ndarray) -> Iterator[tuple[int, int, str]]:
    keep = np.flatnonzero(~gone)
    buf, tails = w.buf.copy(), w.ends[keep[:-1]][w.doc[keep[:-1]] == w.doc[keep[1:]]]
    buf[tails] = 0x20
    step = np.zeros(len(buf) + 2, np.int8)
    np.add.at(step, w.starts[keep], 1)
    np.add.at(step, w.ends[keep], -1)
    inside = np.cumsum(step[:-2], dtype=np.int8) > 0
    inside[tails] = True
    for i in range(len(w.offs) - 1):
        lo, hi = w.first[i], w.first[i + 1]
        mine = keep[np.searchsorted(keep, lo) : np.searchsorted(keep, hi)]
        n = int(hi - lo)
        if not len(mine):
            yield n, n, hashlib.sha256(b"").hexdigest()
            continue
        a, b = int(w.offs[i]), int(w.offs[i + 1])
        yield n, n - len(mine), hashlib.sha256(buf[a:b][inside[a:b]].tobytes()).hexdigest()


def _spans(w: Words, gone: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte ranges to cut, from a removed run's first word to the next kept word (or the text's end)."""
    out = []
    for i in range(len(w.offs) - 1):
        lo, hi = int(w.first[i]), int(w.first[i + 1])
        g = np.concatenate(([0], gone[lo:hi].astype(np.int8), [0]))
        edges = np.diff(g)
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        base = int(w.offs[i])
        out.append([(int(w.starts[lo + b]) - base, (int(w.starts[lo + e]) if lo + e < hi else int(w.offs[i + 1])) - base) for b, e in zip(begin, end)])
    return out


def chunks(docs: DataFrame, chunk_docs: int, chunk_bytes: int) -> int:
    """So many chunks of docs (text) that they hold about the given documents and bytes at most."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return max(1, -(-size.n // chunk_docs), -(-size.b // chunk_bytes))


def dedup_substrings(docs: DataFrame, chunk_docs: int = CHUNK_DOCS, texts: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Words that repeat a 13-word window of a document with a smaller doc_id.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id,
    n_words, n_removed, kept_sha256 and, with texts, text: the document without
    the removed words (unchanged if none is removed; the white space that
    follows a removed word goes with it), and rest: a struct of all other columns.

    Null and empty texts have no words. Rows with equal doc_id never remove
    each other's words. A null doc_id counts as larger than any other. Rows
    that are repeated give repeated rows; an empty table gives an empty one.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")] if texts else []
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    d = d.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks(d, chunk_docs, chunk_bytes))))
    anchors = d.select("chunk", "text").mapInArrow(_anchors, "chunk long, a long")
    m1 = cut(_elsewhere(anchors))
    # one plan for windows and removal, and equal inputs: Spark shuffles the texts by chunk once and reads that shuffle twice
    windows = d.groupBy("chunk").cogroup(m1.groupBy("chunk")).applyInArrow(_windows, "chunk long, a long, c long, low long")
    least = F.min("low").over(Window.partitionBy("a", "c"))
    m2 = windows.withColumn("least", least).where("least < low").select("chunk", "a", "c")

    @tidy
    def final(table: pa.Table, marks: pa.Table) -> pa.Table:
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"text": pa.string(), "rest": table.schema.field("rest").type} if texts else {})
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        c = _Chunk(table)
        c.candidates(windows=_column(marks, "a"))
        gone = c.removed((_column(marks, "a"), _column(marks, "c")))
        n, cut_, sha = zip(*_digest(c.words, gone))
        out = {"doc_id": table["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(cut_, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        if texts:
            new = []
            for text, spans in zip(table["text"].to_pylist(), _spans(c.words, gone)):
                if spans:
                    raw, at, parts = text.encode(), 0, []
                    for b, e in spans:
                        parts.append(raw[at:b])
                        at = e
                    text = b"".join([*parts, raw[at:]]).decode()
                new.append(text)
            out["text"], out["rest"] = pa.array(new, pa.string()), table["rest"]
        return pa.table(out)

    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string")
    if texts:
        schema = schema.add("text", "string").add("rest", d.schema["rest"].dataType)
    return d.groupBy("chunk").cogroup(m2.groupBy("chunk")).applyInArrow(final, schema)
