"""Streams with state: shuffled micro-batches give what the table gives; a replayed batch is published once; sustained alerts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wardscribe.streaming import monitor, ordered

CALLS = "ts timestamp, key string, id long, ok boolean"
T0 = datetime(2024, 1, 1)


def calls(n, seed=0):
    rng = random.Random(seed)
    return [(T0 + timedelta(seconds=rng.uniform(0, 300)), rng.choice("ab"), i, rng.choice([True, False, False, None])) for i in range(n)]


@pytest.fixture
def store(spark):
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def streamed(spark, tmp_path, batches, run, schema):
    """run over a stream whose micro-batches are given; a last far row moves the watermark past all others."""
    for k, part in enumerate([*batches, [(T0 + timedelta(days=9), "end", -1, True)], [(T0 + timedelta(days=9), "end", -2, True)]]):
        spark.createDataFrame(part, CALLS).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    s = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = run(s).writeStream.foreachBatch(ordered.outbox(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted(tuple(r) for r in ordered.published(spark, f"{tmp_path}/out", schema).where("key != 'end'").drop("batch").collect())


@pytest.mark.parametrize("rule", ["bucket", "breaker"])
def test_stream_equals_table(spark, tmp_path, store, rule):
    rows = calls(90)
    parts = [rows[k::5] for k in range(5)]  # each micro-batch has rows of the whole time
    late = "1 hour"
    if rule == "bucket":
        got = streamed(spark, tmp_path, parts, lambda s: ordered.bucket_calls(s, 0.1, 3, late), monitor.BUCKET_CALL)
        want = monitor.bucket_calls(spark.createDataFrame(rows, CALLS), 0.1, 3)
    else:
        got = streamed(spark, tmp_path, parts, lambda s: ordered.breaker(s, 3, 60.0, 20.0, late=late), monitor.BREAKER_CALL)
        want = monitor.breaker(spark.createDataFrame(rows, CALLS), 3, 60.0, 20.0)
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 90


def test_a_replayed_batch_is_published_once(spark, tmp_path):
    schema = "id long"
    write = ordered.outbox(f"{tmp_path}/out")
    assert ordered.published(spark, f"{tmp_path}/out", schema).count() == 0
    write(spark.range(5), 0)
    # the driver is lost after the rows of batch 1 are written and before the ledger has it
    spark.range(5, 8).write.parquet(f"{tmp_path}/out/rows/batch=1")
    assert ordered.published(spark, f"{tmp_path}/out", schema).count() == 5
    write(spark.range(5, 8), 1)
    write(spark.range(5, 8), 1)
    assert sorted(r.id for r in ordered.published(spark, f"{tmp_path}/out", schema).collect()) == list(range(8))


def test_an_outbox_goes_on_after_a_failure(spark, tmp_path):
    spark.range(20).withColumn("key", F.lit("k")).repartition(4).write.parquet(f"{tmp_path}/in")
    write, died = ordered.outbox(f"{tmp_path}/out"), []

    def once(batch, batch_id):
        if batch_id == 1 and not died:
            died.append(batch_id)
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/rows/batch=1")
            raise RuntimeError("lost between the rows and the ledger")
        write(batch, batch_id)

    def run():
        s = spark.readStream.schema("id long, key string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = s.writeStream.foreachBatch(once).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost between"):
        run()
    run()
    assert sorted(r.id for r in ordered.published(spark, f"{tmp_path}/out", "id long, key string").collect()) == list(range(20))


def test_sustained(spark):
    """Bad minutes 0-9 fire, 20-28 are too few, 30-34 and 36-44 have a gap, of another kind 0-14 fire."""
    bad = {"a": [*range(10), *range(20, 29), *range(30, 35), *range(36, 45)], "b": range(15)}
    rows = [(T0 + timedelta(minutes=m, seconds=s), k, -1.0 if m in bad[k] else 1.0) for k in "ab" for m in range(60) for s in (1, 30)]
    rows += [(T0, "a", None)]
    got = monitor.sustained(spark.createDataFrame(rows, "ts timestamp, kind string, value double"), F.col("rate") < 0.5, "1 minute", 600).collect()
    assert sorted((r.kind, (r.since - T0).seconds // 60, (r.until - T0).seconds // 60, r.windows) for r in got) == [("a", 0, 10, 10), ("b", 0, 15, 15)]
