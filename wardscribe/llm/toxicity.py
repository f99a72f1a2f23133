"""Toxicity of texts after noisy-channel deobfuscation.

1. A character trigram model is counted over all documents.
2. Words that may be disguised - look-alikes anywhere in the word, its edges
   too, other symbols among letters or digits, a letter three times or more,
   pieces of one or two letters one after another - become lattices:
   look-alikes, dropped symbols, collapsed repetitions and closed gaps are
   edges with a cost. Viterbi finds the cheapest reading under the model.
3. Features are the restored words and their first bytes. Of the features of a
   bounded sample of labelled documents the most telling FEATURES are kept; a
   logistic regression on their presence gives the score.

Sizes that do not grow with the data: the model (28 ** 3 counts), the sample
(SAMPLE labelled documents, chosen by a hash of their id) and FEATURES.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import U, Words, mix, slices, tidy, word_hashes

SAMPLE, FEATURES, LEAST_POSITIVE, THRESHOLD = 20_000, 4096, 5, 0.3
#: Bytes of text that a worker holds arrays of at a time, and readings that it keeps.
SLICE, READINGS = 1_000_000, 100_000
PREFIXES = (4, 5, 6, 7, 9)
#: What a character may stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h"}
SUBSTITUTE, DROP, COLLAPSE, KEEP_TWO, CLOSE_GAP = 1.0, 2.0, 0.2, 0.7, 0.1
N = 28  # a-z, a word's edge (26), any other character (27)
EDGE, OTHER = 26, 27

_ALIKE = np.zeros(256, bool)
_ALIKE[[ord(c) for c in LOOKALIKES]] = True
_SYMBOLS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_CODE = np.full(256, OTHER, np.int64)
_CODE[97:123] = _CODE[65:91] = np.arange(26)
_CODE[[9, 10, 11, 12, 13, 32]] = EDGE


def trigrams(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) by [a, b, c], from the character counts of all texts (byte-wise, A-Z as a-z)."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                w = Words(b["text"], hashes=False)
                # two edges before each text and after it, so that no count depends on the neighbours
                c = np.full(w.offs[-1] + 2 * len(w.offs), EDGE)
                c[np.arange(w.offs[-1]) + 2 * np.repeat(np.arange(1, len(w.offs)), np.diff(w.offs))] = _CODE[w.buf[: w.offs[-1]]]
                total += np.bincount((c[:-2] * N + c[1:-1]) * N + c[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = np.full(N**3, 0.1)
    for k, v in found:
        n[k] += v
    n = n.reshape(N, N, N)
    return np.log(n / n.sum(2, keepdims=True))


def restore(chars: str, model: np.ndarray | list[float], gaps: bool = False) -> str:
    """The cheapest reading of a disguised word (with gaps: of pieces, each gap closed or kept). A list is the model's cells in order, faster to read."""
    cells = model if isinstance(model, list) else model.ravel().tolist()
    beam: dict[tuple[int, int], tuple[float, tuple | None]] = {(EDGE, EDGE): (0.0, None)}  # a reading is a chain (reading before, text)
    for m in re.finditer(r"(.)\1*", chars.lower(), re.S):
        ch, n = m[0][0], len(m[0])
        letter = "a" <= ch <= "z"
        steps: list[tuple[float, str]] = []
        if letter:
            steps = [(0.0 if n == 1 else COLLAPSE, ch)] + ([(0.0 if n == 2 else KEEP_TWO, ch * 2)] if n > 1 else [])
        elif gaps and ch == " ":
            steps = [(CLOSE_GAP, ""), (0.0, " ")]
        else:
            steps = [(SUBSTITUTE * n, s * min(n, 2)) for s in LOOKALIKES.get(ch, "")] + ([] if ch.isalnum() else [(DROP, "")]) + [(0.0, ch * n)]
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, text) in beam.items():
            for price, out in steps:
                x, y, total = a, b, cost + price
                for c in out:
                    code = ord(c) - 97 if "a" <= c <= "z" else EDGE if c == " " else OTHER
                    total -= cells[(x * N + y) * N + code]
                    x, y = y, code
                if (x, y) not in nxt or total < nxt[x, y][0]:
                    nxt[x, y] = (total, (text, out))
        beam = nxt
    ends = [(cost - cells[(a * N + b) * N + EDGE], text) for (a, b), (cost, text) in beam.items()]
    least = min(cost for cost, _ in ends)
    return min(_unchained(text) for cost, text in ends if cost == least)


def _unchained(reading: tuple | None) -> str:
    parts = []
    while reading:
        reading, out = reading
        parts.append(out)
    return "".join(reversed(parts))


class _Features:
    """Hashed features of the words of a text column, found once for each distinct word of a slice."""

    def __init__(self, model: np.ndarray):
        self.model, self.cache = model.ravel().tolist(), {}

    def _hashes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A column for the whole word and one for each prefix (0 where the word is not longer; the shortest always, so that short words count twice too)."""
        size = ends - starts
        out = [mix(word_hashes(buf, starts, ends) ^ U(0x517CC1B727220A95))]
        lanes = [np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))[starts], np.ndarray((len(buf) - 15,), "<u8", buf, 8, (1,))[starts]]
        with np.errstate(over="ignore"):
            for k in PREFIXES:
                n = np.minimum(size, k)
                one = np.where(n >= 8, lanes[0], lanes[0] & ((U(1) << (np.minimum(n, 7).astype(U) * U(8))) - U(1)))
                rest = np.clip(n - 8, 0, 8)
                two = np.where(rest >= 8, lanes[1], lanes[1] & ((U(1) << (np.minimum(rest, 7).astype(U) * U(8))) - U(1)))
                h = mix(mix(one + U(k)) ^ two)
                out.append(np.where((size > k) | (k == PREFIXES[0]), h, U(0)))
        return np.stack(out, 1)

    def _learn(self, keys: set[tuple[str, bool]]) -> None:
        """Reads disguised words that are not in the cache; the features of all are found at once."""
        if len(self.cache) > READINGS:
            self.cache.clear()
        new = [k for k in keys if k not in self.cache]
        each = [[q for p in restore(word, self.model, gaps).split() if len(q := p.strip(_SYMBOLS).encode()) > 1] for word, gaps in new]
        size = np.array([len(q) for e in each for q in e], np.int64)
        ends = np.cumsum(size)
        h = self._hashes(np.frombuffer(b"".join(q for e in each for q in e) + bytes(16), np.uint8), ends - size, ends)
        at = np.cumsum([0, *map(len, each)])
        for key, lo, hi in zip(new, at[:-1], at[1:]):
            f = h[lo:hi].ravel()
            self.cache[key] = f[f != 0]

    def _restored(self, word: str, gaps: bool = False) -> np.ndarray:
        return self.cache[word, gaps]

    def of(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(rows, features), each pair once."""
        w = Words(col, lower=True)
        if not len(w.starts):
            return np.zeros(0, np.int64), np.zeros(0, U)
        _, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        s, e, buf = w.starts[first].copy(), w.ends[first].copy(), w.buf
        inner = (buf >= 0x80) | ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57))
        place = np.arange(len(buf))  # punctuation around a word goes: to the next letter, and back to the last
        s = np.minimum(np.minimum.accumulate(np.where(inner, place, len(buf))[::-1])[::-1][s], e)
        e = np.maximum(np.maximum.accumulate(np.where(inner, place, -1))[e - 1] + 1, s)
        words = np.flatnonzero(e - s > 1)
        feats = self._hashes(np.concatenate((buf, np.zeros(16, np.uint8))), s[words], e[words])
        # each (word, row) once, then each feature of the word
        pair = np.unique(which.astype(np.int64) * (len(w.offs)) + w.doc)
        wid, row = pair // len(w.offs), pair % len(w.offs)
        slot = np.full(len(first), -1)
        slot[words] = np.arange(len(words))
        ok = slot[wid] >= 0
        f = feats[slot[wid[ok]]]
        rows, found = np.repeat(row[ok], f.shape[1]), f.ravel()
        rows, found = rows[found != 0], found[found != 0]
        more = self._disguised(w, first, s, e, wid, row)
        if more:
            rows = np.concatenate((rows, *(np.full(len(h), r) for r, h in more)))
            found = np.concatenate((found, *(h for _, h in more)))
        return rows, found

    def _disguised(self, w: Words, first, s, e, wid, row) -> list[tuple[int, np.ndarray]]:
        """(row, features) of readings; first, s, e: distinct words and their bounds without punctuation, wid, row: the rows of each."""
        buf = w.buf
        alpha = (buf >= 97) & (buf <= 122)
        run = lambda m: np.concatenate(([0], np.cumsum(m)))
        alike, rest = run(_ALIKE[buf]), run(~alpha & (buf < 0x80))
        same = np.zeros(len(buf), bool)
        same[2:] = alpha[2:] & (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2])
        triple = run(same)
        change = np.zeros(len(buf), bool)
        change[1:] = buf[1:] != buf[:-1]
        changes = run(change)
        a, b = w.starts[first], w.ends[first]
        # a run of one symbol reads as two letters at most, which are no feature
        odd = (b - a > 2) & (changes[b] - changes[a + 1] > 0) & ((alike[b] - alike[a] > 0) | (rest[e] - rest[s] > 0))
        odd |= triple[b] - triple[np.minimum(a + 2, b)] > 0
        text = buf.tobytes()
        asked = [(r, text[a[i] : b[i]].decode("utf-8", "replace"), False) for i, r in zip(*(x[odd[wid]].tolist() for x in (wid, row)))]
        # words in pieces: three or more words of one or two letters or look-alikes on end, one of them of one
        like = run(alpha | _ALIKE[buf])
        size = w.ends - w.starts
        short = (size <= 2) & (like[w.ends] - like[w.starts] == size)
        new = np.ones(len(short) + 1, bool)  # a run ends where its document does
        new[1:-1] = w.doc[1:] != w.doc[:-1]
        begin = short & (new[:-1] | ~np.concatenate(([False], short[:-1])))
        stop = short & (new[1:] | ~np.concatenate((short[1:], [False])))
        ones = run(size == 1)
        lo, hi = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        ok = (hi - lo > 2) & (ones[hi] > ones[lo])
        for a_, b_ in zip(lo[ok].tolist(), hi[ok].tolist()):
            asked.append((int(w.doc[a_]), " ".join(text[w.starts[k] : w.ends[k]].decode("ascii") for k in range(a_, b_)), True))
        self._learn({(word, gaps) for _, word, gaps in asked})
        return [(r, h) for r, word, gaps in asked if len(h := self._restored(word, gaps))]


def _unique(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


class Model:
    """Trigram model, selected features (ascending) and their weights."""

    def __init__(self, lm: np.ndarray, features: np.ndarray, weights: np.ndarray, bias: float):
        self.lm, self.features, self.weights, self.bias = lm, features, weights, bias

    def present(self, maker: _Features, col) -> tuple[np.ndarray, np.ndarray]:
        rows, found = maker.of(col)
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        ok = self.features[at] == found
        return _unique(rows[ok], at[ok])

    def scores(self, maker: _Features, col, n: int) -> np.ndarray:
        rows, at = self.present(maker, col)
        x = self.bias + np.bincount(rows, self.weights[at], minlength=n) if len(rows) else np.full(n, self.bias)
        return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(rows: list[tuple[int, list[int]]], n_features: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge by gradient steps scaled per feature; classes weigh as they occur."""
    y = np.array([r[0] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    at = np.array([k for r in rows for k in r[1]], np.int64)
    w, rate = np.zeros(n_features), min(max(y.mean(), 1e-4), 1 - 1e-4)
    bias = math.log(rate / (1 - rate))
    past, past_b = np.full(n_features, 1e-8), 1e-8
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[at], minlength=len(y)), -35, 35)))
        g = np.bincount(at, (p - y)[doc], minlength=n_features) + 0.02 * w
        b = float((p - y).sum())
        past, past_b = past + g**2, past_b + b**2
        w -= 0.5 * g / np.sqrt(past)
        bias -= 0.5 * b / math.sqrt(past_b)
    return w, bias


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from labels (doc_id, toxic 0 or 1; others and nulls are ignored) of at most about `sample` documents of docs."""
    spark, lm = docs.sparkSession, trigrams(docs)
    y = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = y.count()
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").select("text", "toxic")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Features(lm)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                rows, found = _unique(*maker.of(b["text"]))
                found, which = np.unique(found, return_inverse=True)
                pos = np.bincount(which, b["toxic"].to_numpy()[rows], minlength=len(found)).astype(np.int64)
                every = np.bincount(which, minlength=len(found))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(pos), pa.array(every - pos)], ["f", "pos", "neg"])

    total = known.agg(F.sum("toxic"), F.count("*")).first()
    pos, neg = total[0] or 0, total[1] - (total[0] or 0)
    if not pos or not neg:
        return Model(lm, np.zeros(0, U), np.zeros(0), -35.0 if not pos else 35.0)
    f = known.mapInArrow(count, "f long, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= LEAST_POSITIVE)
    gain = F.col("pos") * F.log((F.col("pos") / pos) / ((F.col("neg") + 0.5) / neg))
    best = [r[0] for r in f.orderBy(gain.desc(), "f").limit(FEATURES).select("f").collect()]
    model = Model(lm, np.sort(np.array(best, np.int64).view(U)), np.zeros(len(best)), 0.0)

    @tidy
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Features(lm)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                rows, at = model.present(maker, b["text"])
                split = np.searchsorted(rows, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b["toxic"], pa.array([at[i:j].astype(np.int32) for i, j in zip(split[:-1], split[1:])], pa.list_(pa.int32()))], ["y", "x"])

    rows = sorted((r[0], list(r[1])) for r in known.mapInArrow(seen, "y int, x array<int>").collect())  # at most the sample
    model.weights, model.bias = _fit(rows, len(best))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds _toxicity, 0 to 1, to the rows of docs (text string): the whole text is scored.

    Null and empty texts get the score of a text without any feature. Other
    columns are kept (the name _toxicity is taken); repeated rows are scored
    each; an empty table gives an empty one.
    """
    return scored(docs, model).select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns], "_toxicity")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(rest, text, _toxicity): the rows of docs, their columns but text in rest; a text goes to Python once."""
    x = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), F.col("text").cast("string").alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _Features(model.lm)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([b["rest"], b["text"], pa.array(model.scores(maker, b["text"], b.num_rows))], ["rest", "text", "_toxicity"])

    return x.mapInArrow(run, x.select("rest", "text", F.lit(0.0).alias("_toxicity")).schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels of held-out documents are not used.

    A null doc_id is never held out nor labelled.
    """
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), sample)
    s = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))
