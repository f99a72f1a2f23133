"""Checks and levels of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of recordings.
MAX_MB, LONGEST_S, SHORTEST_S, FAINT, LEAST_VOICE = 100, 1800, 0.6, 0.005, 0.05


def error_code(size: Column, duration: Column) -> Column:
    """404 missing, 413 too large or long, 422 empty or too short, null if fine; an unknown duration is accepted."""
    return (F.when(size.isNull(), 404).when(size > MAX_MB * 1024 * 1024, 413).when(size == 0, 422).when(duration > LONGEST_S, 413).when(duration < SHORTEST_S, 422))


def levels(waves: DataFrame, rate: int = 16000) -> DataFrame:
    """(job_id, rms, peak, gain, snr_before_db, snr_after_db, low_energy) of waves(job_id, samples)."""
    n = F.size("samples")
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.when(n > 0, n))
    x = waves.select("job_id", rms.alias("rms"), F.array_max(F.transform("samples", lambda v: F.abs(v.cast("double")))).alias("peak"))
    before = 20 * F.log10(F.col("rms") + 1e-6) + 60
    return x.select("job_id", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round(0.1 / F.when(F.col("rms") > 0, F.col("rms")), 6).alias("gain"), F.round(before, 4).alias("snr_before_db"), F.round(before + 6, 4).alias("snr_after_db"), (20 * F.log10(F.col("rms") + 1e-6) < -30).alias("low_energy"))


def voice_ratio(waves: DataFrame, frame: int = 480, least: float = 0.02) -> DataFrame:
    """(job_id, frames, speech, ratio): frames whose RMS reaches `least`; where none does, the loudest fifth.

    A recording's frames are slices of its own array: no row for a sample, no shuffle.
    """
    starts = F.when(F.size("samples") > 0, F.sequence(F.lit(1), F.size("samples"), F.lit(frame))).otherwise(F.array().cast("array<int>"))
    power = lambda at: F.aggregate(F.slice("samples", at, frame), F.lit(0.0), lambda a, y: a + y.cast("double") * y)
    rms = F.transform(starts, lambda at: F.sqrt(power(at) / F.least(F.lit(frame), F.size("samples") - at + 1)))
    x = waves.select("job_id", rms.alias("rms")).withColumn("frames", F.size("rms").cast("long")).where("frames > 0")
    loud = F.size(F.filter("rms", lambda r: r >= least)).cast("long")
    speech = F.when(loud > 0, loud).otherwise(F.greatest(F.floor(F.col("frames") * 0.2), F.lit(1)))
    return x.select("job_id", "frames", speech.alias("speech")).withColumn("ratio", F.round(F.col("speech") / F.col("frames"), 6))


def silence(peak: Column, ratio: Column, seconds: Column) -> Column:
    """422 for a recording without speech: too faint, too little voice or too short; null if fine, and where a value is unknown."""
    return F.when((peak < FAINT) | (ratio < LEAST_VOICE) | (seconds < SHORTEST_S), 422)


def segment_confidence(avg_logprob: Column, capped: bool = False) -> Column:
    """A segment's confidence from the recognizer's mean log probability; over 1 for sure ones unless capped. To hundredths, ties to even in binary arithmetic."""
    c = F.rint((0.7 - avg_logprob) * 100) / 100
    return F.least(c, F.lit(1.0)) if capped else c


def scaled(waves: DataFrame) -> DataFrame:
    """(job_id, samples) at an RMS of 0.1, clipped to -1 to 1; silence stays."""
    n = F.size("samples")
    rms = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double") * x) / F.when(n > 0, n))
    gain = F.coalesce(0.1 / F.when(rms > 0, rms), F.lit(1.0))
    return waves.select("job_id", "samples", gain.alias("gain")).select("job_id", F.transform("samples", lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double") * F.col("gain")))).alias("samples"))


def mock_segments(notes: DataFrame, sents: DataFrame) -> DataFrame:
    """(job_id, id, text, start, end): sentences of 0.32 s a word (0.6 s at least), 0.3 s apart, from 0.2 s."""
    n = F.size(F.array_remove(F.split(F.trim("raw"), r"\s+"), ""))
    s = sents.select("job_id", "sent", F.col("raw").alias("text"), n.alias("n")).where("n > 0").withColumn("dur", F.greatest(F.lit(0.6), 0.32 * F.col("n")))
    w = Window.partitionBy("job_id").orderBy("sent")
    start = F.coalesce(F.sum(F.col("dur") + 0.3).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + 0.2
    return s.select("job_id", (F.row_number().over(w) - 1).alias("id"), "text", F.round(start, 2).alias("start"), F.round(start + F.col("dur"), 2).alias("end"))


def mock_first(raws: Column) -> Column:
    """The first of mock_segments (id, start, end) of a note's sentences, null where none has a word."""
    sizes = F.filter(F.transform(raws, lambda s: F.size(F.array_remove(F.split(s, r"\s+"), ""))), lambda n: n > 0)
    end = F.round(F.lit(0.2) + F.greatest(F.lit(0.6), 0.32 * F.get(sizes, F.lit(0))), 2)
    return F.when(F.size(sizes) > 0, F.struct(F.lit(0).alias("id"), F.round(F.lit(0.2), 2).alias("start"), end.alias("end")))
