import wave
from datetime import datetime, timedelta

import numpy as np

from wardscribe.sources import files
from wardscribe.streaming import monitor

SCHEMA = "ts timestamp, key string, kind string, value double, id long"


def rows(n, key="a", start=0, step=1):
    return [(datetime(2024, 1, 1) + timedelta(seconds=start + i * step), key, "stt", float(i), i) for i in range(n)]


def run_stream(spark, tmp_path, data, f, mode="append"):
    for k, part in enumerate(data):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = f"t{abs(hash(str(tmp_path))) % 10**8}"
    s = f(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = s.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    data = rows(50) + rows(5, "b")
    later = rows(1, "z", 7200) + rows(1, "z", 9000)
    got = run_stream(spark, tmp_path, [data, later[:1], later[1:]], lambda e: monitor.over_limit(e, 20))
    want = monitor.over_limit(spark.createDataFrame(data, SCHEMA), 20).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want} and len(want) == 1


def test_idempotency_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, [rows(3), rows(3, start=5), rows(1, "b", 20)], lambda e: monitor.first_of_key(e).select("key"))
    assert sorted(r.key for r in got) == ["a", "b"]


def test_token_bucket(spark):
    x = spark.createDataFrame(rows(30, step=0), SCHEMA)
    assert tuple(monitor.token_bucket(x, 1.0, 10.0).first()) == ("a", 10, 20)


def test_recordings(spark, tmp_path):
    t = np.arange(16000) / 16000
    for name, y in (("ok.wav", np.sin(440 * t) * 0.5), ("short.wav", np.zeros(800))):
        with wave.open(str(tmp_path / name), "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(16000)
            w.writeframes((y * 32767).astype("<i2").tobytes())
    (tmp_path / "bad.wav").write_bytes(b"not audio")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.recordings(spark, str(tmp_path)).collect()}
    assert got["ok.wav"].error_code is None and len(got["ok.wav"].samples) == 16000 and got["ok.wav"].duration == 1.0
    assert got["short.wav"].error_code == 422 and got["bad.wav"].samples is None


def test_audit_appends(spark, tmp_path):
    a = spark.createDataFrame([(1, "k")], "job_id long, key string")
    files.append_audit(a, str(tmp_path / "audit"))
    files.append_audit(a, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
