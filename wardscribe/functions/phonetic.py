"""A phonetic key for drug names as English, Hindi and Tamil speakers write them, and names that sound alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of one sound, applied in this order to small letters. A rule is a pattern that Java and RE2 share.
SOUNDS = [
    ("[^a-z]", ""), ("ph|f|v|w", "f"), ("th|dh|t|d", "t"), ("sh|ch|z|x|c([eiy])", "s$1"), ("kh|gh|ck|c|q|k|g", "k"), ("bh|b|p", "p"),
    ("y|ee|ea", "i"), ("h", ""), ("^[aeiou]+", "a"), ("([^a])[aeiou]+", "$1"), ("j", "s"),
]


def key(name: Column) -> Column:
    """Consonants by their sound, doubled ones once, vowels only at the start. Null stays null."""
    x = F.lower(name)
    for pattern, to in SOUNDS:
        x = F.regexp_replace(x, pattern, to)
    once = lambda letters: F.filter(letters, lambda c, i: (i == 0) | (c != F.get(letters, i - 1)))
    return F.array_join(_once(F.split(x, ""), once), "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time, and not for each element of a lambda inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _variants(k: Column, edits: int) -> Column:
    """The key and all that it gives by leaving out up to `edits` letters."""
    out = F.array(k)
    for _ in range(edits):
        shorter = F.flatten(F.transform(out, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))
        out = F.array_distinct(F.concat(out, shorter))
    return out


def sound_alikes(said: DataFrame, names: DataFrame, edits: int = 2, most: int = 3) -> DataFrame:
    """(said, name, distance, rank, code): up to `most` names whose keys are within `edits` edits of a word's, by distance, edit distance of the words, name.

    said: said string; names: name string; distinct values count. Words meet
    names by equal variants of their keys: of two keys within `edits` edits,
    leaving out that many letters of each at most gives an equal one, so no pair
    is missed and the two tables are never crossed. code is AMBIGUOUS_DRUG where
    the distance is under 2 and the word is not the name itself. Nulls and words
    without a Latin letter meet nothing.
    """
    a = said.select("said").distinct().withColumn("a", key(F.col("said"))).where("a != ''")
    b = names.select("name").distinct().withColumn("b", key(F.col("name"))).where("b != ''")
    met = a.withColumn("v", F.explode(_variants(F.col("a"), edits))).join(b.withColumn("v", F.explode(_variants(F.col("b"), edits))), "v").select("said", "name", "a", "b").distinct()
    near = met.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= edits)
    order = F.struct("distance", F.levenshtein(F.lower("said"), F.lower("name")).alias("spelled"), "name")
    best = near.groupBy("said").agg(F.slice(F.sort_array(F.collect_list(order)), 1, most).alias("best"))
    code = F.when((F.col("x.distance") < 2) & (F.lower("said") != F.lower("x.name")), "AMBIGUOUS_DRUG")
    return best.select("said", F.posexplode("best").alias("pos", "x")).select("said", "x.name", "x.distance", (F.col("pos") + 1).alias("rank"), code.alias("code"))


def repeats(words: Column, longest: int = 3) -> Column:
    """Of an array of words, for each length of 1 to `longest` the most copies of a run of so many words one after another (1: none), by length.

    The run of places at which a word equals the one `length` before, divided by
    the length, is the number of further copies. Null gives null, no words zeros.
    """

    def copies(ws: Column, size: int) -> Column:
        same = F.transform(ws, lambda w, i: (i >= size) & F.coalesce(w == F.get(ws, i - size), F.lit(False)))
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
        step = lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["most"], F.when(x, s["now"] + 1).otherwise(0)).alias("most"))
        return F.aggregate(same, start, step, lambda s: F.when(F.size(ws) < size, 0).otherwise(F.floor(s["most"] / size) + 1).cast("int"))

    return _once(words, lambda ws: F.when(ws.isNotNull(), F.array(*[copies(ws, k) for k in range(1, longest + 1)])))


def is_stuck(text: Column, least: int = 3, longest: int = 3) -> Column:
    """Whether a run of 1 to `longest` words is said `least` times or more on end, whatever their case: a recognizer that repeats itself."""
    return F.coalesce(F.array_max(repeats(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), longest)) >= least, F.lit(False))
