"""Collocations: phrases that occur often, scored by their weakest cut, from position bitmaps.

1. Texts are cut into pieces and words. Words of one language go into shards of
   about SHARD words in the order in which a task meets them; a piece's end
   takes a position of its own. A shard stores its word sequence as codes, the
   frequent words first, and its own vocabulary with counts, which add up to
   the counts of a language. Words below the support are blank from here on.
2. A shard holds a bitmap of positions for each frequent word, compressed to
   its 64-bit blocks that are not empty, and the same blocks ordered by place.
   A phrase's bitmap marks where it ends. Shifted by one bit and ANDed with the
   word bitmaps of the same blocks it gives the bitmaps of all phrases that are
   a word longer; popcounts are their occurrences. As pieces are apart by a
   blank position, no phrase leaves its piece.
3. Pairs are counted in each shard, summed over shards and told back where they
   have the support. Then a shard goes depth-first: a class of first words is
   extended down to the longest phrases before the next class begins, and a
   step is taken only where its last two words are such a pair.
4. Sums of the popcounts that reach the support are the candidates.

A task holds one shard. A row is sent for each distinct pair or phrase of a
shard, so a phrase that a third of all documents hold is one row a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import cut
from .textkit import U, slices, text_bytes, tidy, word_hashes

SHARD, CLASS = 1_500_000, 2_000_000
#: Bytes between words, and bytes between pieces.
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, np.uint8)
_KIND[list(SPACES)], _KIND[list(BREAKS)] = 1, 2


class _Text:
    """Words of a column: the padded bytes, byte ranges, hashes, and whether a word begins a piece."""

    def __init__(self, col):
        buf, offs = text_bytes(col)
        n = len(buf)
        self.buf = np.zeros(n + 16, np.uint8)
        self.buf[:n] = buf
        self.buf[(self.buf >= 65) & (self.buf <= 90)] |= 0x20
        kind = _KIND[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        word = kind == 0
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1] | edge[1:n]
        stop[:-1] &= ~word[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.hashes = word_hashes(self.buf, self.starts, self.ends)
        piece = np.cumsum((kind == 2) | edge[:n])[self.starts]
        self.opens = np.ones(len(piece), bool)
        self.opens[1:] = piece[1:] != piece[:-1]


def _gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte ranges as strings."""
    size = ends - starts
    offs = np.concatenate(([0], np.cumsum(size)))
    data = buf[np.arange(offs[-1]) + np.repeat(starts - offs[:-1], size)]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.string())


def _shard(number: int, lang: str, parts: list[_Text]) -> pa.RecordBatch:
    """The shard's row; a code is a word's place in the vocabulary and one more, zero an end of a piece."""
    base = np.cumsum([0] + [len(t.buf) for t in parts])[:-1]
    buf = np.concatenate([t.buf for t in parts])
    starts, ends = (np.concatenate([getattr(t, k) + b for t, b in zip(parts, base)]) for k in ("starts", "ends"))
    _, at, which, times = np.unique(np.concatenate([t.hashes for t in parts]), return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    opens = np.concatenate([t.opens for t in parts])
    codes = np.zeros(len(opens) + int(opens.sum()), np.uint32)
    codes[np.arange(len(opens)) + np.cumsum(opens)] = place[which] + 1
    words = _gather(buf, starts[at[order]], ends[at[order]])
    one = pa.array([0, len(order)], pa.int32())
    values = [pa.array([number]), pa.array([lang]), pa.array([(codes & 0xFFFF).astype("<u2").tobytes()]), pa.array([(codes >> 16).astype("<u2").tobytes()]), pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(times[order]))]
    return pa.RecordBatch.from_arrays(values, ["shard", "lang", "low", "high", "words", "counts"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) of a task as shards; several languages are open at a time, four shards of words at most in all."""
    held: dict[str, list[_Text]] = {}
    number = TaskContext.get().partitionId() << 24
    for batch in batches:
        for part in slices(batch, "text"):
            langs = part["lang"].dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                t = _Text(part["text"].filter(pa.array(langs.indices.to_numpy() == k)))
                if len(t.starts):
                    held.setdefault(lang, []).append(t)
            size = {lang: sum(len(t.starts) for t in ts) for lang, ts in held.items()}
            for lang in sorted(size, key=size.get, reverse=True):
                if size[lang] >= SHARD or sum(size.values()) >= 4 * SHARD:
                    yield _shard(number, lang, held.pop(lang))
                    number, size[lang] = number + 1, 0
    for lang, ts in held.items():
        yield _shard(number, lang, ts)
        number += 1


class Bitmaps:
    """Position bitmaps of items 0 to `many` - 1 of a sequence (-1: blank), compressed to the blocks that are not empty."""

    def __init__(self, items: np.ndarray, many: int):
        self.many = many
        at = np.flatnonzero(items >= 0)
        item = items[at]
        order = np.argsort(item, kind="stable")
        item, at = item[order], at[order]
        block, bit = at >> 6, U(1) << (at & 63).astype(U)
        new = np.ones(len(at), bool)
        new[1:] = (item[1:] != item[:-1]) | (block[1:] != block[:-1])
        head = np.flatnonzero(new)
        self.item, self.block = item[head], block[head]
        self.bits = np.bitwise_or.reduceat(bit, head) if len(head) else bit
        self.blocks = (len(items) >> 6) + 2
        # the same entries by block: what a shifted bitmap is ANDed with
        by = np.argsort(self.block, kind="stable")
        self.there, self.with_bits = self.item[by], self.bits[by]
        self.first = np.searchsorted(self.block[by], np.arange(self.blocks + 1))

    def longer(self, row: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, item, block, bits) of the phrases of `row` extended by each item that follows: shift, AND, empty results dropped."""
        over = np.flatnonzero(bits >> U(63))
        row, block = np.concatenate((row, row[over])), np.concatenate((block, block[over] + 1))
        bits = np.concatenate((bits << U(1), np.ones(len(over), U)))
        n = self.first[block + 1] - self.first[block]
        mine = np.repeat(np.arange(len(row)), n)
        theirs = np.arange(len(mine)) + np.repeat(self.first[block] - (np.cumsum(n) - n), n)
        both = bits[mine] & self.with_bits[theirs]
        hit = np.flatnonzero(both)
        mine = mine[hit]
        return row[mine], self.there[theirs[hit]], block[mine], both[hit]

    def classes(self) -> Iterator[slice]:
        """Runs of entries, whole items each, whose extension looks at about CLASS entries."""
        cost = np.cumsum(self.first[self.block + 1] - self.first[self.block])
        ends = np.flatnonzero(np.append(self.item[1:] != self.item[:-1], True)) + 1 if len(self.item) else np.zeros(0, np.int64)
        lo = 0
        while lo < len(self.item):
            limit = (cost[lo - 1] if lo else 0) + CLASS
            fit = int(np.searchsorted(cost[ends - 1], limit, "right"))
            hi = int(ends[max(fit - 1, int(np.searchsorted(ends, lo, "right")))])
            yield slice(lo, hi)
            lo = hi

    def walk(self, words: int, pairs: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Depth-first: (phrases as rows of items, occurrences) of 2 to `words` words. pairs: ascending a * many + b of the steps that may be taken."""

        def deeper(phrases: np.ndarray, row: np.ndarray, block: np.ndarray, bits: np.ndarray):
            row, item, block, bits = self.longer(row, block, bits)
            if pairs is not None:
                step = phrases[row, -1] * self.many + item
                at = np.searchsorted(pairs, step)
                ok = np.flatnonzero(pairs[np.minimum(at, len(pairs) - 1)] == step) if len(pairs) else np.zeros(0, np.int64)
                row, item, block, bits = row[ok], item[ok], block[ok], bits[ok]
            if not len(row):
                return
            key = row * self.many + item
            order = np.argsort(key, kind="stable")
            key = key[order]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            found = np.column_stack((phrases[row[order[head]]], item[order[head]]))
            yield found, np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), head)
            if found.shape[1] < words:
                child = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(key))))
                yield from deeper(found, child, block[order], bits[order])

        for c in self.classes():
            first, row = np.unique(self.item[c], return_inverse=True)
            yield from deeper(first[:, None], row, self.block[c], self.bits[c])


def _open(table: pa.Table, told: pa.Table) -> tuple[np.ndarray, Bitmaps]:
    """The shard's frequent words' ids, ascending, and their bitmaps; told has (code, id) of them."""
    mark = told.filter(told["code"].is_valid())
    code, ident = mark["code"].to_numpy(), mark["id"].to_numpy()
    low, high = (np.frombuffer(table[k][0].as_py(), "<u2") for k in ("low", "high"))
    codes = low.astype(np.int64) | high.astype(np.int64) << 16
    order = np.argsort(ident)
    item = np.full(int(codes.max(initial=0)) + 1, -1)
    item[code[order] + 1] = np.arange(len(order))
    return ident[order], Bitmaps(item[codes], max(1, len(order)))


@tidy
def _pairs(table: pa.Table, told: pa.Table) -> pa.Table:
    out = [[np.zeros(0, np.int64)] for _ in range(3)]
    if table.num_rows and told.num_rows:
        ids, maps = _open(table, told)
        for found, times in maps.walk(2):
            for to, x in zip(out, (ids[found[:, 0]], ids[found[:, 1]], times)):
                to.append(x)
    a, b, n = map(np.concatenate, out)
    return pa.table({"shard": pa.array(np.full(len(a), table["shard"][0].as_py() if len(a) else 0)), "a": pa.array(a), "b": pa.array(b), "n": pa.array(n)})


def _phrases(words: int):
    @tidy
    def longer(table: pa.Table, told: pa.Table) -> pa.Table:
        ids_out, times_out = [], []
        if table.num_rows and told.num_rows:
            ids, maps = _open(table, told)
            steps = told.filter(told["b"].is_valid())
            a, b = (np.searchsorted(ids, steps[k].to_numpy()) for k in ("id", "b"))
            for found, times in maps.walk(words, np.sort(a * maps.many + b)):
                if found.shape[1] > 2:
                    size = found.shape[1]
                    ids_out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * size, pa.int32()), pa.array(ids[found].reshape(-1))))
                    times_out.append(times)
        ids_col = pa.chunked_array(ids_out, pa.list_(pa.int64()))
        return pa.table({"ids": ids_col, "n": pa.array(np.concatenate(times_out) if times_out else np.zeros(0, np.int64))})

    return longer


def collocations(docs: DataFrame, words: int = 3, support: int = 10, covered: int = 50) -> DataFrame:
    """Candidates of 2 to `words` words with `support` occurrences or more: lang, words (array), phrase, a, l, r, k, n, score.

    docs: text string, lang string; other columns are ignored. A-Z is lower-cased.
    Pieces end at . , ; : ! ? and at line ends; words are apart by spaces and
    tabs. Everything is counted for a language alone. n: all words; a: the
    phrase's occurrences inside pieces, overlapping ones too. A cut after k words
    has l and r occurrences of its parts and the score floor(1000000 a a / (l r));
    the lowest counts, of equal ones the first. A candidate whose words lie inside
    a longer one goes if the longer one has `covered` percent of its occurrences.

    A null language is `und`. Null and empty texts have no words; repeated rows
    count each; an empty table gives an empty one. A text is never split
    between shards, so one longer than a shard makes a longer shard.
    """
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    shards = cut(d.mapInArrow(tidy(_shards), "shard long, lang string, low binary, high binary, words array<string>, counts array<long>"))
    each = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w")).select("shard", "lang", "code", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    known = each.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= support)
    known = cut(known.withColumn("id", F.monotonically_increasing_id()))
    marks = cut(each.drop("n").join(known.drop("n"), ["lang", "word"]).select("shard", F.col("code").cast("long").alias("code"), "id", F.lit(None).cast("long").alias("b")))
    codes = shards.select("shard", "low", "high")
    pairs = codes.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(_pairs, "shard long, a long, b long, n long")
    pairs = cut(pairs.withColumn("n", F.sum("n").over(Window.partitionBy("a", "b"))).where(F.col("n") >= support))

    sized = known.select(F.array("id").alias("ids"), "lang", F.array("word").alias("words"), F.array("n").alias("heads"), F.array("n").alias("tails"))
    counts = {2: pairs.groupBy("a", "b").agg(F.first("n").alias("n")).select(F.array("a", "b").alias("ids"), "n")}
    if words > 2:
        steps = pairs.select("shard", F.lit(None).cast("long").alias("code"), F.col("a").alias("id"), "b")
        found = codes.groupBy("shard").cogroup(marks.unionByName(steps).groupBy("shard")).applyInArrow(_phrases(words), "ids array<long>, n long")
        found = cut(found.groupBy("ids").agg(F.sum("n").alias("n")).where(F.col("n") >= support))
        counts |= {d: found.where(F.size("ids") == d) for d in range(3, words + 1)}

    levels = []
    for depth in range(2, words + 1):  # counts of all beginnings come from the phrase without its last word, of all ends from that without its first
        c = counts[depth].select("ids", "n", F.slice("ids", 1, depth - 1).alias("front"), F.slice("ids", 2, depth - 1).alias("back"))
        front = sized.select(F.col("ids").alias("front"), "lang", F.col("words").alias("fw"), "heads")
        back = sized.select(F.col("ids").alias("back"), F.col("words").alias("bw"), "tails")
        sized = c.join(front, "front").join(back, "back").select("ids", "lang", F.concat("fw", F.slice("bw", -1, 1)).alias("words"), F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"))
        sized = cut(sized)
        levels.append(sized.withColumn("a", F.element_at("heads", -1)))
    kept = levels[-1]
    for shorter, longer in zip(levels[-2::-1], levels[:0:-1]):
        size = F.size("ids") - 1
        inside = longer.select(F.explode(F.array(F.slice("ids", F.lit(1), size), F.slice("ids", F.lit(2), size))).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("most"))
        rest = shorter.join(inside, "ids", "left").where(f"most is null or 100 * most < {covered} * a").drop("most")
        kept = kept.unionByName(rest)
    wide = "cast({} as decimal(14, 0))"  # counts to 10 ** 14, products to 37 digits
    cuts = f"transform(sequence(1, size(ids) - 1), k -> struct({wide.format('heads[k - 1]')} as l, {wide.format('tails[size(ids) - k - 1]')} as r, k as k))"
    scored = f"array_min(transform({cuts}, c -> struct(cast(1000000 as decimal(7, 0)) * {wide.format('a')} * {wide.format('a')} div (c.l * c.r) as score, c.k as k, cast(c.l as long) as l, cast(c.r as long) as r)))"
    total = shards.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    return kept.withColumn("s", F.expr(scored)).join(total, "lang").select("lang", "words", F.array_join("words", " ").alias("phrase"), "a", "s.l", "s.r", F.col("s.k").cast("int").alias("k"), "n", "s.score")


def best_phrases(found: DataFrame, first: int = 2000) -> DataFrame:
    """The `first` candidates of each language by score, then occurrences, then phrase in byte order, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).withColumn("rank", F.col("rank").cast("long"))
