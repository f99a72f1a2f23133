"""Monitoring of jobs: the same functions work on batch and streaming frames of events(ts, key, kind, value).

Streams carry a watermark of LATE; rows later than that are dropped by the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LATE = "10 minutes"


def watermarked(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", LATE) if events.isStreaming else events


def over_limit(events: DataFrame, most: int = 20) -> DataFrame:
    """(key, minute, n): keys with more than `most` calls in a minute."""
    w = watermarked(events).groupBy("key", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return w.where(F.col("n") > most).select("key", F.col("w.start").alias("minute"), "n")


def alerts(events: DataFrame, width: str, slide: str, least_rate: float) -> DataFrame:
    """(kind, since, n, rate): sliding windows in which the share of rows with value > 0 stays under least_rate."""
    w = watermarked(events).groupBy("kind", F.window("ts", width, slide).alias("w")).agg(F.count("*").alias("n"), F.avg((F.col("value") > 0).cast("double")).alias("rate"))
    return w.where(F.col("rate") < least_rate).select("kind", F.col("w.start").alias("since"), "n", F.round("rate", 6).alias("rate"))


def sustained(events: DataFrame, bad: Column, width: str = "1 minute", for_s: int = 600) -> DataFrame:
    """(kind, since, until, windows): times of `for_s` seconds or more in which every window of `width` is bad.

    bad: over the columns n, rate (share of rows with value > 0), sum, most and
    avg of a window. A window without rows ends such a time. Gaps and islands:
    the start of a window less its rank among the bad ones of its kind is the
    same along a run. Only the bad windows are sorted, one row each. A null
    value counts as a row with the value 0.
    """
    v = F.coalesce("value", F.lit(0.0))
    w = events.groupBy("kind", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.avg((v > 0).cast("double")).alias("rate"), F.sum(v).alias("sum"), F.max(v).alias("most"), F.avg(v).alias("avg"))
    start, end = (F.unix_micros(F.col(f"w.{c}").cast("timestamp")) for c in ("start", "end"))
    b = w.where(bad).withColumn("island", start - (end - start) * F.row_number().over(Window.partitionBy("kind").orderBy("w.start")))
    runs = b.groupBy("kind", "island").agg(F.min("w.start").alias("since"), F.max("w.end").alias("until"), F.count("*").alias("windows"))
    long = F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= for_s * 1_000_000
    return runs.where(long).select("kind", "since", "until", "windows")


def stage_latency(events: DataFrame, width: str = "1 hour") -> DataFrame:
    p = F.percentile_approx("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 10000)
    w = watermarked(events).groupBy("kind", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), p.alias("p"))
    return w.select("kind", F.col("w.start").alias("since"), "n", *[F.col("p")[i].alias(c) for i, c in enumerate(("p50", "p95", "p99"))])


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(key, since, until, n): sessions without a gap of that length or more."""
    s = watermarked(events).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("key", F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def first_of_key(events: DataFrame) -> DataFrame:
    """The first row of each idempotency key; streams keep keys for the watermark's time."""
    if events.isStreaming:
        return watermarked(events).dropDuplicatesWithinWatermark(["key"])
    return events.groupBy("key").agg(F.min(F.struct("ts", "id", "kind", "value")).alias("f")).select("key", "f.*")


def folded(rows: DataFrame, key: str, order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Rows of each key in order through step(state, row) -> (state, result or None), from start(key).

    For rules where each row's result depends on all before. Rows are sorted
    within their partition (the sort spills) and read batch by batch, so a task
    holds one state and one batch, however many rows a key has. step gets
    None for the row after a key's last.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last, begun = None, None, False
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = getattr(row, key)
                if not begun or k != last:
                    if begun:
                        out.append(step(state, None)[1])
                    state, last, begun = start(k), k, True
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame([r for r in out if r is not None], columns=names)
        if begun:
            end = step(state, None)[1]
            yield pd.DataFrame([end] if end is not None else [], columns=names)

    return rows.where(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def _seconds(events: DataFrame, *more: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return events.select(F.col("key").cast("string").alias("key"), t.alias("t"), *more)


BUCKET_CALL = "key string, id long, allowed boolean, retry_after double"
BREAKER_CALL = "key string, id long, state string, passed boolean"


def bucket_step(rate: float, burst: float) -> Callable:
    """A call takes a token; tokens come back at `rate` a second up to `burst`. State: tokens, time of the last call (None: full)."""

    def step(s, row):
        if row is None:
            return s, None
        tokens, last = s
        tokens = burst if last is None else min(burst, tokens + (row.t - last) * rate)
        ok = bool(tokens >= 1)
        return (tokens - ok, row.t), (row.key, row.id, ok, 0.0 if ok else round((1 - tokens) / rate, 6))

    return step


def bucket_calls(events: DataFrame, rate: float = 1.0, burst: float = 10.0) -> DataFrame:
    """(key, id, allowed, retry_after) of events(ts, key, id): a token bucket for each key, seconds until the next token for refused calls."""
    return folded(_seconds(events, "id"), "key", ["t", "id"], lambda k: (burst, None), bucket_step(rate, burst), BUCKET_CALL)


def token_bucket(events: DataFrame, rate: float = 1.0, burst: float = 10.0) -> DataFrame:
    """(key, allowed, refused): each key's calls by what its token bucket made of them."""
    return bucket_calls(events, rate, burst).groupBy("key").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


def breaker_step(failures: int, within_s: float, wait_s: float) -> Callable:
    """State: since when the breaker is open (None: closed), times of failed calls."""

    def step(s, row):
        opened, failed = s
        if row is None:
            return s, None
        if opened is not None and row.t - opened < wait_s:
            return s, (row.key, row.id, "open", False)
        if opened is not None:
            return ((None, ()) if row.ok else (row.t, ())), (row.key, row.id, "half-open", True)
        if not row.ok:
            failed = tuple(t for t in failed if row.t - t <= within_s) + (row.t,)
        return ((row.t, ()) if len(failed) >= failures else (None, failed)), (row.key, row.id, "closed", True)

    return step


def breaker(calls: DataFrame, failures: int = 5, within_s: float = 60.0, wait_s: float = 30.0) -> DataFrame:
    """(key, id, state, passed) of calls(ts, key, id, ok): a circuit breaker for each provider.

    Closed until `failures` failed calls lie within `within_s`; then open, and
    calls are refused; after `wait_s` the next call is a trial that closes it
    or opens it again. A null ok is a failure.
    """
    c = _seconds(calls, "id", F.coalesce("ok", F.lit(False)).alias("ok"))
    return folded(c, "key", ["t", "id"], lambda k: (None, ()), breaker_step(failures, within_s, wait_s), BREAKER_CALL)


def publish_conflicts(publishes: DataFrame) -> DataFrame:
    """(key, id, based_on, version, error_code) of publishes(ts, key, id, based_on): optimistic locking of each template.

    A publish passes, and makes the next version, if it is based on the current
    one (0 at first); a stale one gets 409 and the version stays.
    """

    def step(version, row):
        if row is None:
            return version, None
        ok = row.based_on == version
        return version + ok, (row.key, row.id, row.based_on, version + ok, 0 if ok else 409)

    p = _seconds(publishes, "id", F.coalesce(F.col("based_on").cast("long"), F.lit(-1).cast("long")).alias("based_on"))
    out = folded(p, "key", ["t", "id"], lambda k: 0, step, "key string, id long, based_on long, version long, error_code int")
    return out.withColumn("error_code", F.nullif("error_code", F.lit(0))).withColumn("based_on", F.nullif("based_on", F.lit(-1).cast("long")))


# Seconds that each kind of cached result lives.
LIFE_S = {"stt": 7 * 86400, "code": 30 * 86400, "template": 3600}


def cache_hits(events: DataFrame) -> DataFrame:
    """Lookups of events(ts, key, kind, action: put, drop or get) with hit: the last put or drop before is a put within its kind's life.

    An as-of join without a join: one window over each (kind, key) carries the
    last write forward. A write at the same time counts as before the lookup.
    """
    write = F.col("action").isin("put", "drop")
    w = Window.partitionBy("kind", "key").orderBy("ts", F.when(F.col("action") == "put", 0).when(F.col("action") == "drop", 1).otherwise(2)).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(write, F.struct("action", "ts")), ignorenulls=True).over(w)
    life = F.create_map(*[F.lit(x) for kv in LIFE_S.items() for x in kv])[F.col("kind")]
    age = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("last.ts").cast("timestamp"))
    x = events.withColumn("last", last).where("action = 'get'")
    return x.withColumn("hit", F.coalesce((F.col("last.action") == "put") & (age <= life.cast("long") * 1_000_000), F.lit(False))).drop("last")
