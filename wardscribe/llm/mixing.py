"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is u ** (1 / weight) with u drawn from a hash of its id;
within a source the largest keys come first. Keys are counted in 1,024 slices
of their range, then the one slice in which the budget ends in 1,024 more, so
only the documents of one slice of a slice are ever sorted: a source with a
third of all rows never meets in one task. Complete epochs of a source precede
the fractional selection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 1024
#: Sources up to which the plan is broadcast (under 10 MB); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A document's weight, 0.25 to 1: the share of its characters that aren't markup or filler symbols."""
    n = F.length(text)
    share = F.length(F.translate(text, "%$#&*!|{}<>=_~^\\", "")) / F.when(n > 0, n)
    return F.greatest(F.lit(0.25), F.coalesce(share, F.lit(0.25)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds target to (source, source_size): a row for each source, so one task can order them.

    Sources in code point order, null last, weigh `weights` in turn and share
    `share` of all sizes; none gets over `most` times its size. The level at
    which the sources fill, target = min(most * size, weight * level), is found
    from prefix sums over the sources by their filling level.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))).cast("int") + 1)
    s = sizes.withColumn("w", w.cast("double")).withColumn("full", most * F.col("source_size"))
    by = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    s = s.withColumn("k", F.row_number().over(by)).withColumn("before", F.sum("full").over(by) - F.col("full"))
    after = Window.orderBy(F.col("k").desc())
    all_ = Window.partitionBy(F.lit(1))
    level = (share * F.sum("source_size").over(all_) - F.col("before")) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("full") / F.col("w"))
    at = F.min(F.when(F.col("fits"), F.struct("k", "level"))).over(all_)["level"]
    return s.withColumn("target", F.least(F.col("full"), F.coalesce(at * F.col("w"), F.col("full")))).select("source", "source_size", "target")


def _boundary(rows: DataFrame, plan: DataFrame, slice_: str, rest: str, out: str, out_rest: str) -> DataFrame:
    """Adds to the plan the slice of each source in which its budget ends, and what is left of the budget there."""
    z = rows.groupBy("source", F.col(slice_).alias("k")).agg(F.sum("size").alias("z"))
    z = z.withColumn("after", F.sum("z").over(Window.partitionBy("source").orderBy(F.col("k").desc())))
    p = plan.select(F.col("source").alias("s2"), F.col(rest).alias("rest"))
    hit = z.join(p, F.col("source").eqNullSafe(F.col("s2"))).where("after - z <= rest and rest < after")
    hit = hit.select(F.col("s2"), F.col("k").alias(out), (F.col("rest") - F.col("after") + F.col("z")).alias(out_rest))
    return plan.join(hit, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").fillna({out: -1})


def mix(docs: DataFrame, seed: int = 7, weight=quality, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: bool = False) -> DataFrame:
    """How many words of each document the mix takes.

    docs: doc_id, source, text. Returns a row for each row: doc_id, size,
    source_size, target, taken and copies (taken is copies * size); with keep,
    only copies and _row, a struct of all columns of docs, whatever their names.

    A document is taken whole or not at all in each epoch; the last one taken is
    the one that brings the source nearest to its target. Null and empty texts
    have size 0 and count as taken while budget is left. Null sources are one
    source. Equal keys are ordered by doc_id; repeated rows are drawn each. An
    empty table gives an empty one.
    """
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size")), F.lit(2**53)) + F.lit(0.5)) / F.lit(float(2**53))
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), *([F.struct("*").alias("_row")] if keep else []))
    base = base.withColumn("size", word_count(F.col("text"))).withColumn("key", F.pow(u, 1 / weight(F.col("text")))).drop("text")
    base = base.withColumn("k1", F.least(F.floor(F.col("key") * SLICES), F.lit(SLICES - 1))).withColumn("k2", F.least(F.floor((F.col("key") * SLICES - F.col("k1")) * SLICES), F.lit(SLICES - 1)))
    slim = cut(base.drop("_row"))
    plan = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0)))
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    plan = cut(_boundary(slim, plan, "k1", "rest", "b1", "r1"))
    p1 = plan.select(F.col("source").alias("s3"), "b1")
    inside = slim.join(p1, F.col("source").eqNullSafe(F.col("s3"))).where("k1 = b1")
    plan = cut(_boundary(inside, plan, "k2", "r1", "b2", "r2").withColumnRenamed("source", "s4"))
    few = plan.count() <= BROADCAST_SOURCES
    rows = (base if keep else slim).join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("s4")))
    last = F.expr("k1 = b1 and k2 = b2")
    chosen = F.expr("case when k1 != b1 then k1 > b1 else k2 > b2 end")
    w = Window.partitionBy("source").orderBy(F.col("key").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(last).withColumn("chosen", F.sum("size").over(w) - F.col("size") / 2 <= F.col("r2"))
    out = rows.where(~last).withColumn("chosen", chosen).unionByName(ends).withColumn("copies", F.col("epochs") + F.col("chosen").cast("long"))
    if keep:
        return out.select("_row", "copies")
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
