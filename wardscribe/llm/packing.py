"""Bounded-space online best-fit packing of token sequences.

Each task packs the documents it reads, so nothing is shuffled. A task holds
at most `open_bins` open sequences: counts by free space beside a bitset with
a bit for every free space that some open sequence has, so the tightest fit is
one shift and one lowest bit. Past the limit the fullest sequence closes. The
pieces of a slice of the input (4 MB of text) arrive longest first.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, slices, word_hashes

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Words that a worker's token cache holds (some 100 MB) before it starts anew.
CACHE_WORDS = 1_500_000


class Bins:
    """Open sequences by free space; place() gives the sequence's number and the offset there."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit, self.mask, self.open, self.made = capacity, limit, 0, 0, 0
        self.free: dict[int, list[int]] = defaultdict(list)

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.mask &= ~(1 << space)
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fit = self.mask >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.capacity, self.made
            self.made += 1
        rest = space - length
        if rest:
            self.free[rest].append(number)
            self.mask |= 1 << rest
            self.open += 1
            if self.open > self.limit:
                self._take((self.mask & -self.mask).bit_length() - 1)
        return number, self.capacity - space


_PUNCTUATION, _ALNUM = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ".,;:!?%$#*|&"]] = True
_ALNUM[[*range(48, 58), *range(97, 123)]] = True


#: Byte-level models spell printable bytes as themselves and the others, in order, from U+0100.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}


class _Tokens:
    """Token ids of whole texts.

    The tokenizer never joins across ASCII white space, so distinct words are
    encoded once and kept. New words are encoded many in one text with a special
    token between them, which the tokenizer splits off before anything else;
    words that contain the special token's name are encoded one by one.
    """

    BATCH = 200

    def __init__(self, tokenizer_path: str, mark: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.mark, self.mark_id = mark, self.tokenizer.token_to_id(mark)
        self._fresh()

    def _fresh(self) -> None:
        self.keys, self.at, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.size = np.zeros(0, np.int64)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and flat ids of the words.

        A word of Latin-1 letters is one piece to the model, whatever stands
        before it in the tokenizer: only its bytes are spelt as characters.
        """
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if w.isalpha() and max(w) <= "\xff":
                out[i] = [t.id for t in self.model.tokenize(w.lower().encode().decode("latin-1").translate(_SPELT))]
            else:
                rest.append(i)
        for lo in range(0, len(rest), self.BATCH):
            some = rest[lo : lo + self.BATCH]
            if any(self.mark in words[i] for i in some):
                for i in some:
                    out[i] = self._encode(words[i])
                continue
            ids = self._encode(self.mark.join(words[i] for i in some))
            for i, part in zip(some, np.split(ids, np.flatnonzero(ids == self.mark_id))):
                out[i] = part[part != self.mark_id]
        size = np.array([len(x) for x in out], np.int64)
        return size, np.fromiter((t for x in out for t in x), np.uint32, int(size.sum()))

    def _split(self, col) -> Words:
        """Words, and punctuation after an ASCII letter or digit as words of its own: no token spans the two. Letters are lower-cased as the tokenizer does, unless a special token may be written there."""
        w = Words(col)
        if b"<|" in w.buf.tobytes():
            return w
        up = (w.buf >= 65) & (w.buf <= 90)
        w.buf[up] |= 0x20
        end, buf = w.ends.copy(), w.buf
        for _ in range(4):
            end -= (end > w.starts + 1) & _PUNCTUATION[buf[end - 1]]
        cut = (end < w.ends) & _ALNUM[buf[end - 1]]
        first = np.concatenate(([0], np.cumsum(cut)))[w.first] + w.first
        order = np.argsort(np.concatenate((w.starts, end[cut])), kind="stable")
        w.starts, w.ends = np.concatenate((w.starts, end[cut]))[order], np.concatenate((np.where(cut, end, w.ends), w.ends[cut]))[order]
        w.first, w.hashes = first, word_hashes(w.buf, w.starts, w.ends)
        return w

    def of(self, col) -> list[np.ndarray]:
        w = self._split(col)
        uniq, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self._fresh()
        pos = np.searchsorted(self.keys, uniq)
        known = self.keys[np.minimum(pos, len(self.keys) - 1)] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        new = np.flatnonzero(~known)
        if len(new):
            text = w.buf.tobytes()
            size, flat = self._words([text[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[first[new]].tolist(), w.ends[first[new]].tolist())])
            at = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate((self.ids, flat))
            keys = np.concatenate((self.keys, uniq[new]))
            order = np.argsort(keys, kind="stable")
            self.keys, self.at, self.size = keys[order], np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
            pos = np.searchsorted(self.keys, uniq)
        at, size = self.at[pos][which], self.size[pos][which]
        total = np.concatenate(([0], np.cumsum(size)))
        flat = self.ids[np.repeat(at - total[:-1], size) + np.arange(int(total[-1]))]
        return [np.append(flat[total[a] : total[b]], np.uint32(0)) for a, b in zip(w.first[:-1], w.first[1:])]


#: A worker keeps its cache from task to task.
_WORKER: dict[str, _Tokens] = {}


def _tokens(tokenizer_path: str) -> _Tokens:
    if tokenizer_path not in _WORKER:
        _WORKER[tokenizer_path] = _Tokens(tokenizer_path)
    return _WORKER[tokenizer_path]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, open_bins: int = 1024) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` tokens.

    docs: doc_id long, text string; other columns are ignored. A document is its
    token ids, then id 0; null and empty texts are the id 0 alone. Longer ones
    are cut into pieces of `capacity` ids; the last may be shorter. Returns a row
    a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Repeated rows are packed each; a null doc_id stays null; an empty table
    gives an empty one. tokenizer_path must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins = _tokens(tokenizer_path), Bins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            for b in slices(batch, "text"):
                rows = []
                for doc, ids in zip(b["doc_id"].to_pylist(), tokens.of(b["text"])):
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append((doc, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                rows.sort(key=lambda r: -r[3])
                placed = [bins.place(r[3]) for r in rows]
                cols = [*zip(*rows)] or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:]), pa.array([base + p[0] for p in placed], pa.int64()), pa.array([p[1] for p in placed], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
