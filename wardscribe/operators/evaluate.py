"""Scores of results against gold values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def field_scores(gold: DataFrame, got: DataFrame) -> DataFrame:
    """Strict precision, recall and F1 of (job_id, field, value) by lang and over all: a grouping set over one full join."""
    g, h = gold.withColumn("_g", F.lit(1)), got.withColumn("_h", F.lit(1))
    x = g.join(h.drop("lang"), ["job_id", "field", "value"], "full")
    langs = gold.select("job_id", F.col("lang").alias("l2")).distinct()
    x = x.join(langs, "job_id", "left").withColumn("lang", F.coalesce("lang", "l2"))
    s = x.groupingSets([["lang"], []], "lang").agg(F.count_if(F.expr("_g = 1 and _h = 1")).alias("tp"), F.count_if(F.expr("_g is null")).alias("fp"), F.count_if(F.expr("_h is null")).alias("fn"), F.grouping_id().alias("gid"))
    f1 = 2 * F.col("tp") / F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return s.select(F.when(F.col("gid") == 1, "all").otherwise(F.col("lang")).alias("lang"), "tp", "fp", "fn", F.round(f1, 6).alias("f1"))


ERRORS = "errors long, words long, medical_errors long, medical_words long"
_CELLS = 2_000_000


def _aligned(ref: list[np.ndarray], hyp: list[np.ndarray], medical: np.ndarray) -> np.ndarray:
    """Least weights of alignments, all pairs of texts at once: an error weighs 2 ** 32, and 1 more if a word in it is medical.

    ref, hyp: word numbers of each text; medical: by number. A row of the table
    is one step over all texts; chains of insertions are a running minimum.
    """
    one, n, m = np.int64(2**32), np.array([len(x) for x in ref]), np.array([len(x) for x in hyp])
    r, h = (np.full((len(x), max(map(len, x), default=0)), len(medical)) for x in (ref, hyp))
    for to, x in ((r, ref), (h, hyp)):
        for k, words in enumerate(x):
            to[k, : len(words)] = words
    weight = one + np.append(medical, False).astype(np.int64)
    inserted = np.concatenate((np.zeros((len(hyp), 1), np.int64), np.cumsum(weight[h], 1)), 1)
    row = inserted.copy()
    out = np.where(n == 0, row[np.arange(len(m)), m], 0)
    for i in range(r.shape[1]):
        w = r[:, i : i + 1]
        changed = np.where(h == w, 0, np.maximum(weight[h], weight[w]))
        step = np.minimum(row[:, 1:] + weight[w], row[:, :-1] + changed)
        step = np.concatenate((row[:, :1] + weight[w], step), 1)
        row = np.minimum.accumulate(step - inserted, 1) + inserted
        out = np.where(n == i + 1, row[np.arange(len(m)), m], out)
    return out


def word_errors(texts: DataFrame, ref: str, hyp: str, terms: list[str]) -> DataFrame:
    """texts with ERRORS: word edit distance of hyp to ref, and of its errors those that touch a medical word.

    Medical words are numbers and `terms` (drug names and units in small
    letters). Of all shortest alignments the one with the fewest medical errors
    counts. Words are apart by white space and compared in small letters; null
    is empty. Texts are aligned in groups of similar length, a table row at a
    time for a whole group, so a task holds two rows of each.
    """
    names = frozenset(terms)
    kinds = [c.split() for c in ERRORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number: dict[str, int] = {}
            pairs = [[np.array([number.setdefault(w, len(number)) for w in (t or "").lower().split()], np.int64) for t in b[c].to_pylist()] for c in (ref, hyp)]
            medical = np.array([w in names or any(c.isdigit() for c in w) for w in number], bool)
            size = np.array([len(x) for x in pairs[1]]) + 1
            order, weight = np.argsort(size, kind="stable"), np.zeros(b.num_rows, np.int64)
            lo = 0
            while lo < len(order):
                hi = lo + 1
                while hi < len(order) and (hi + 1 - lo) * size[order[hi]] <= _CELLS:
                    hi += 1
                at = order[lo:hi]
                weight[at] = _aligned([pairs[0][k] for k in at], [pairs[1][k] for k in at], medical)
                lo = hi
            flags = np.append(medical, False)
            counts = [weight >> 32, np.array([len(x) for x in pairs[0]]), weight & (2**32 - 1), np.array([int(flags[x].sum()) for x in pairs[0]])]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int64)) for c in counts)], [*b.schema.names, *(k for k, _ in kinds)])

    schema = T.StructType(list(texts.schema.fields))
    for name, _ in kinds:
        schema = schema.add(name, "long")
    return texts.mapInArrow(run, schema)


def _rate(part: Column, whole: Column) -> Column:
    return F.round(part / F.when(whole > 0, whole), 6)


def _by_lang(rows: DataFrame, *sums: Column) -> DataFrame:
    s = rows.groupingSets([["lang"], []], "lang").agg(*sums, F.grouping_id().alias("gid"))
    return s.withColumn("lang", F.when(F.col("gid") == 1, "all").otherwise(F.coalesce("lang", F.lit("und")))).drop("gid")


def error_rates(counted: DataFrame) -> DataFrame:
    """(lang, errors, words, wer, medical_errors, medical_words, medical_wer) of word_errors with lang, by lang and over all; rates are null where there are no words."""
    s = _by_lang(counted, *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("errors", "words", "medical_errors", "medical_words")])
    return s.select("lang", "errors", "words", _rate(F.col("errors"), F.col("words")).alias("wer"), "medical_errors", "medical_words", _rate(F.col("medical_errors"), F.col("medical_words")).alias("medical_wer"))


# Kinds of fields in which a wrong value is dangerous.
CRITICAL = ("drug", "dose", "diagnosis", "allergy")


def field_rates(fields: DataFrame) -> DataFrame:
    """(lang, fields, accuracy, critical, critical_rate, review_rate, correction_rate) of fields(lang, kind, value, gold, color, final).

    accuracy: value equals gold, nulls too. critical: a wrong value of a CRITICAL
    kind that is GREEN, so that no one looks at it. review: not GREEN. correction:
    final, what the doctor left, differs from value.
    """
    right = F.col("value").eqNullSafe(F.col("gold"))
    slip = ~right & F.col("kind").isin(*CRITICAL) & (F.col("color") == "GREEN")
    n = F.count("*")
    share = lambda c: F.round(F.count_if(c) / n, 6)
    looked = ~F.col("color").eqNullSafe(F.lit("GREEN"))
    return _by_lang(fields, n.alias("fields"), share(right).alias("accuracy"), F.count_if(slip).alias("critical"), share(slip).alias("critical_rate"), share(looked).alias("review_rate"), share(~F.col("value").eqNullSafe(F.col("final"))).alias("correction_rate"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return rows.groupBy(by).agg(F.count("*").alias("n"), p.alias("p")).select(by, "n", *[F.round(F.col("p")[i], 6).alias(c) for i, c in enumerate(("p50", "p95", "p99"))])
