"""Rules over resolved drugs and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import FREQ_PER_DAY


def band(confidence: Column) -> Column:
    return F.when(F.coalesce(confidence, F.lit(0.0)) < 0.85, "RED").when(confidence <= 0.95, "YELLOW").otherwise("GREEN")


def per_day(frequency: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in FREQ_PER_DAY.items() for x in kv])
    hours = F.regexp_extract(F.lower(frequency), r"^(?:every\s+|q)(\d+)\s*h", 1).try_cast("int")
    return F.coalesce(known[F.lower(frequency)], F.floor(24 / F.when(hours > 0, hours))).cast("int")


def dose_rules(drugs: DataFrame, dim: DataFrame) -> DataFrame:
    """Drugs with issue flags from the drug dimension (broadcast: 30 rows): dose over the daily most, single and by frequency, mcg given as mg, high risk."""
    x = drugs.join(F.broadcast(dim), "name", "left").withColumn("times", per_day(F.col("frequency")))
    over = F.col("dose") > F.col("max_daily_mg")
    return x.select(*drugs.columns, F.coalesce((F.col("unit") == "mg") & over, F.lit(False)).alias("dose_exceeded"), F.coalesce((F.col("unit") == "mg") & (F.col("dose") * F.col("times") > F.col("max_daily_mg")), F.lit(False)).alias("daily_exceeded"),
                    F.coalesce((F.col("usual_unit") == "mcg") & (F.col("unit") == "mg"), F.lit(False)).alias("unit_flip"), F.coalesce("high_risk", F.lit(False)).alias("high_risk"), "times")


def required_missing(slots: DataFrame, jobs: DataFrame, required: list[str]) -> DataFrame:
    """(job_id, key): required fields that are absent or NIL."""
    want = jobs.select("job_id", F.explode(F.array(*map(F.lit, required))).alias("key"))
    have = slots.where(~F.col("text").startswith("NIL") & (F.col("text") != "")).select("job_id", "key")
    return want.join(have, ["job_id", "key"], "left_anti")


def sound_alikes(said: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """(said, name, distance, rank): the nearest dictionary names of unknown words by edit distance, ties by name."""
    x = said.select("said").distinct().crossJoin(F.broadcast(names)).withColumn("distance", F.levenshtein("said", "name"))
    best = x.groupBy("said").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "name"))), 1, most).alias("b"))
    return best.select("said", F.posexplode("b").alias("rank", "b")).select("said", "b.name", "b.distance", (F.col("rank") + 1).alias("rank"))


def overlaps(segments: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of a job's segments (a before b) that overlap by more than `least` seconds.

    An interval join by doubling lengths: a segment of a length between 2**k and
    2**(k + 1) is dealt into the cells of that width that it touches, three at
    most, and meets the others there; one that is longer than another looks the
    shorter one's start up in its own cells. So one long segment does not widen
    the cells of the short ones.
    """
    s = segments.select("job_id", "id", "start", "end").where(F.col("end") - F.col("start") > least)
    s = s.withColumn("k", F.floor(F.log2(F.col("end") - F.col("start"))).cast("int"))
    levels = s.groupBy("job_id").agg(F.sort_array(F.collect_set("k")).alias("ks"))
    cell = lambda t, k: F.floor(t / F.pow(F.lit(2.0), k))
    a = s.withColumn("cell", F.explode(F.sequence(cell(F.col("start"), F.col("k")), cell(F.col("end"), F.col("k")))))
    a = a.selectExpr("job_id", "id as a", "start as a0", "end as a1", "k", "cell")
    b = s.join(levels, "job_id").withColumn("k2", F.explode("ks")).where("k2 >= k")
    b = b.withColumn("cell", F.explode(F.sequence(cell(F.col("start"), F.col("k2")), cell(F.col("end"), F.col("k2")))))
    b = b.selectExpr("job_id", "id as b", "start as b0", "end as b1", "k as bk", "k2 as k", "cell")
    x = a.join(b, ["job_id", "k", "cell"]).where("k > bk or a < b")
    x = x.select("job_id", F.struct(F.col("a0").alias("t"), F.col("a").alias("id"), F.col("a1").alias("e")).alias("x"), F.struct(F.col("b0").alias("t"), F.col("b").alias("id"), F.col("b1").alias("e")).alias("y")).distinct()
    x = x.select("job_id", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    shared = F.least("x.e", "y.e") - F.col("y.t")
    return x.where(shared > least).select("job_id", F.col("x.id").alias("a"), F.col("y.id").alias("b"), shared.alias("shared"))


def chain_breaks(chain: DataFrame) -> DataFrame:
    """Rows of a hash chain (job_id, seq, payload, hash) that do not follow from the row before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("job_id").orderBy("seq")), F.lit(""))
    return chain.withColumn("_b", before).where(F.col("hash") != F.sha2(F.concat("_b", "payload"), 256)).drop("_b")


STATES = ["received", "cleaned", "transcribed", "normalized", "extracted", "filled", "review", "verified", "exported"]


def illegal_moves(log: DataFrame) -> DataFrame:
    """Status changes (job_id, ts, seq, status) that are not a step to the next state or back to review."""
    at = F.array_position(F.array(*map(F.lit, STATES)), F.col("status"))
    before = F.lag(at).over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    return log.withColumn("_b", before).withColumn("_a", at).where("_b is not null and _a != _b + 1 and not (status = 'review' and _b > _a)").select("job_id", "ts", "seq", "status")


def route(air_gapped: Column, lang: Column, agreement: Column) -> Column:
    """The tier that transcribes a job: local when air-gapped, a language model for mixed speech, the cloud only under an agreement."""
    return F.when(air_gapped, "local").when(lang != "en", "multilingual").when(agreement, "cloud").otherwise("local")


def review_refusals(reviews: DataFrame, drugs: DataFrame, dim: DataFrame, least_s: float = 5.0) -> DataFrame:
    """(job_id, code) of reviews(job_id, seconds, reviewer, reviewer_2, bulk_red) that may not verify.

    Too fast a review, all RED fields accepted at once, and drugs of high risk
    or dosed in mcg without a second reviewer, who must be another person.
    """
    risky = drugs.join(F.broadcast(dim.select("name", "high_risk")), "name", "left").where(F.coalesce("high_risk", F.lit(False)) | (F.col("unit") == "mcg")).select("job_id").distinct()
    x = reviews.join(risky.withColumn("risky", F.lit(True)), "job_id", "left")
    alone = F.col("reviewer_2").isNull() | F.col("reviewer_2").eqNullSafe(F.col("reviewer"))
    codes = [F.when(F.col("seconds") < least_s, "REVIEW_TOO_FAST"), F.when(F.col("bulk_red"), "BULK_ACCEPT_RED"), F.when(F.col("risky") & alone, "SECOND_REVIEWER_REQUIRED")]
    return x.select("job_id", F.explode(F.array_compact(F.array(*codes))).alias("code"))


def duration_kind(sentence: Column) -> Column:
    """Whether a sentence's duration is of the therapy or of the history; null without a duration, unclear without a cue."""
    has = sentence.rlike(r"(?i)\b\d+[- ]?(?:days?|weeks?|months?)\b")
    history = sentence.rlike(r"(?i)\b(?:history|since|past|last)\b|\bago\b")
    therapy = sentence.rlike(r"(?i)\b(?:give|take|continue|start|prescribe|mg|mcg|ml)\b")
    return F.when(~F.coalesce(has, F.lit(False)), None).when(history & ~therapy, "history").when(therapy & ~history, "therapy").otherwise("unclear")


def stored(jobs: DataFrame) -> DataFrame:
    """Jobs(consent, raw_path) without the raw path where consent to store is not given (false or null); all else is kept."""
    return jobs.withColumn("raw_path", F.when(F.col("consent"), F.col("raw_path")))


def exportable(jobs: DataFrame) -> DataFrame:
    """Jobs(status) with error_code 403 unless they are verified."""
    return jobs.withColumn("error_code", F.when(~F.col("status").eqNullSafe("verified"), 403))


def own_rows(rows: DataFrame, hospital_id) -> DataFrame:
    """The rows of one hospital only; the predicate reaches the scan."""
    return rows.where(F.col("hospital_id") == hospital_id)
