"""Words, hashes and byte ranges of Arrow text columns, vectorised with numpy.

A word is a maximal run of bytes outside {0x20, 0x09-0x0D}. UTF-8 never uses
those bytes inside a longer character, so byte runs equal character runs.
"""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable

import numpy as np
import pyarrow as pa

U = np.uint64
_C1, _C2, _C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def release() -> None:
    """Hands freed memory back to the system: a worker that waits for its next task would keep it beside those that run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def tidy(step: Callable) -> Callable:
    """A function of one or two groups, or of batches, that releases what it has freed at its end; Spark counts its arguments, so they stay as they are."""
    if inspect.isgeneratorfunction(step):

        def run(batches):
            yield from step(batches)
            release()

    elif step.__code__.co_argcount == 1:

        def run(table):
            out = step(table)
            release()
            return out

    else:

        def run(table, side):
            out = step(table, side)
            release()
            return out

    return functools.wraps(step)(run)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * _C2
    x = x ^ (x >> U(27))
    x = x * _C3
    return x ^ (x >> U(31))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary()).fill_null(b"") if len(col) else pa.array([], pa.large_binary())
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64, len(col) + 1, col.offset * 8) if bufs[1] is not None else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo, hi = int(offs[0]), int(offs[-1])
    return data[lo:hi], offs - lo


class Words:
    """starts, ends (byte ranges), hashes, and first: the words of row i are first[i]:first[i + 1]."""

    def __init__(self, col, lower: bool = False, hashes: bool = True):
        buf, self.offs = text_bytes(col)
        n = len(buf)
        pad = np.zeros(n + 16, np.uint8)
        pad[:n] = buf
        if lower:
            up = (pad >= 65) & (pad <= 90)
            pad[up] |= 0x20
        self.buf = pad
        if not hashes:
            return
        word = ~((buf == 0x20) | ((buf >= 9) & (buf <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[self.offs[(self.offs <= n)]] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:n]
        stop = word.copy()
        stop[:-1] &= ~word[1:] | edge[1:n]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.offs)
        self.hashes = word_hashes(pad, self.starts, self.ends)
        self.doc = np.repeat(np.arange(len(self.offs) - 1), np.diff(self.first))

    def windows(self, size: int) -> np.ndarray:
        """Index of each window's first word: windows lie in one row."""
        n = np.maximum(np.diff(self.first) - size + 1, 0)
        return np.arange(int(n.sum())) + np.repeat(self.first[:-1] - (np.cumsum(n) - n), n)

    def roll(self, at: np.ndarray, size: int, seed: int) -> np.ndarray:
        """A hash of the `size` words from each index in `at`."""
        out = np.full(len(at), (seed * 0x9E3779B97F4A7C15 + size) % 2**64, U)
        mult = U((seed * 2 + 1) * 0xD6E8FEB86659FD93 % 2**64 | 1)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = out * mult + self.hashes[at + k]
            return mix(out)


def word_hashes(pad: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lanes = np.ndarray((max(len(pad) - 7, 0),), "<u8", pad, 0, (1,))
    length = ends - starts
    with np.errstate(over="ignore"):
        h = length.astype(U) * _C1
        live, k = np.arange(len(starts)), 0
        while len(live):
            rest = length[live] - 8 * k
            lane = lanes[starts[live] + 8 * k]
            short = rest < 8
            lane[short] &= (U(1) << (rest[short].astype(U) * U(8))) - U(1)
            h[live] = mix((h[live] ^ lane) * _C1 + U(k + 1))
            live, k = live[~short & (rest > 8)], k + 1
    return h


def pack48(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1)


def slices(batch, column: str, limit: int = 4_000_000):
    """Parts of a record batch whose texts hold about `limit` bytes at most; one longer text is a part of its own."""
    size = np.cumsum(np.diff(text_bytes(batch.column(column))[1]))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
