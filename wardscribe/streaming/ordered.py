"""Rules where each row's result depends on all before, on streams; and a sink that writes each batch once.

The same step functions run in monitor.folded over whole tables and here over
streams. A stream's rows come in any order: they wait in state until the
watermark has passed them, and go through the step in time order when a timer
fires, so the results are those of the table whatever the micro-batches were.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .monitor import BREAKER_CALL, BUCKET_CALL, LATE, breaker_step, bucket_step

#: The store that keeps state of transformWithState; a session setting.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


class _Ordered(StatefulProcessor):
    """Rows of a key wait until the watermark has passed them; `idle_s` after its last row a key's state goes."""

    def __init__(self, columns: list[str], order: list[str], start: Callable, step: Callable, names: list[str], idle_s: float):
        self.columns, self.order, self.start, self.step, self.names, self.idle_s = columns, order, start, step, names, idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "row string")
        self.state = handle.getValueState("state", "value string, last double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = 0
        for b in rows:
            part = b[self.columns].astype(object).where(b[self.columns].notna(), None)
            self.waiting.appendList([(json.dumps(r),) for r in part.values.tolist()])
            latest = max(latest, int(b["t"].max() * 1000))
        self.handle.registerTimer(latest + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        rows = [dict(zip(self.columns, json.loads(r))) for (r,) in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in rows if int(r["t"] * 1000) < until), key=lambda r: [r[c] for c in self.order])
        stored = self.state.get() if self.state.exists() else None
        if not due:
            if stored is not None and until >= int((stored[1] + self.idle_s) * 1000) and not rows:
                self.state.clear()
            return
        later = [(json.dumps([r[c] for c in self.columns]),) for r in rows if int(r["t"] * 1000) >= until]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        state = _tuples(json.loads(stored[0])) if stored is not None else self.start(key[0])
        out = []
        for r in due:
            state, result = self.step(state, SimpleNamespace(**r))
            if result is not None:
                out.append(result)
        last = due[-1]["t"]
        self.state.update((json.dumps(state), float(last)))
        self.handle.registerTimer(int((last + self.idle_s) * 1000) + 1)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def ordered(events: DataFrame, columns: dict[str, str], order: list[str], start: Callable, step: Callable, schema: str, idle_s: float, late: str = LATE) -> DataFrame:
    """step over the rows of each key of a stream events(ts, key, ...) in the order given, as monitor.folded does over a table.

    columns: expressions of the row's other fields; t is the time in seconds. A
    row's result comes when the watermark (`late` behind the latest ts) has
    passed it; rows that come later than that are dropped by the engine, rows
    without a key take no part. A key's state goes `idle_s` after its last row,
    so start must give the same as the state of that age. Needs STORE.
    """
    t = (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t")
    rows = events.where("key is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).select("ts", F.col("key").cast("string").alias("key"), t, *[F.expr(e).alias(c) for c, e in columns.items()])
    names = [c.split()[0] for c in schema.split(", ")]
    processor = _Ordered(["key", "t", *columns], order, start, step, names, idle_s)
    return rows.groupBy("key").transformWithStateInPandas(processor, schema, "Append", "EventTime")


def bucket_calls(events: DataFrame, rate: float = 1.0, burst: float = 10.0, late: str = LATE) -> DataFrame:
    """monitor.bucket_calls of a stream: an idle bucket is full after burst / rate seconds, like a new one."""
    return ordered(events, {"id": "cast(id as long)"}, ["t", "id"], lambda k: (burst, None), bucket_step(rate, burst), BUCKET_CALL, burst / rate, late)


def breaker(calls: DataFrame, failures: int = 5, within_s: float = 60.0, wait_s: float = 30.0, idle_s: float = 86400.0, late: str = LATE) -> DataFrame:
    """monitor.breaker of a stream; a provider without calls for a day starts closed."""
    columns = {"id": "cast(id as long)", "ok": "coalesce(ok, false)"}
    return ordered(calls, columns, ["t", "id"], lambda k: (None, ()), breaker_step(failures, within_s, wait_s), BREAKER_CALL, max(idle_s, within_s, wait_s), late)


def _parts(folder: str) -> tuple[str, str]:
    return f"{folder.rstrip('/')}/rows", f"{folder.rstrip('/')}/ledger"


def _there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def outbox(folder: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that publishes each batch once.

    A batch's rows are written to a place named by its id, then the id goes into
    the ledger. A batch that is in the ledger is not written again; one that was
    written but not entered, as its driver was lost, is overwritten by its
    replay. published() reads what the ledger has, so nothing is seen half.
    """
    rows, ledger = _parts(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if _there(spark, f"{ledger}/batch={batch_id}/_SUCCESS"):
            return
        batch.write.mode("overwrite").parquet(f"{rows}/batch={batch_id}")
        spark.range(1).select(F.lit(batch_id).cast("long").alias("id"), F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return write


def published(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all batches in the ledger, with batch (its id); empty before the first."""
    rows, ledger = _parts(folder)
    if not _there(spark, ledger):
        return spark.createDataFrame([], f"{schema}, batch long")
    done = spark.read.schema("id long, at timestamp, batch long").parquet(ledger).select("batch").distinct()
    return spark.read.schema(f"{schema}, batch long").option("basePath", rows).parquet(rows).join(done, "batch", "left_semi")
