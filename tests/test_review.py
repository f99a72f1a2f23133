"""Rules folded over time, caches, provenance and documents."""

import io
import random
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from wardscribe.functions import lexicon as L
from wardscribe.operators import audio, extract, provenance, slots, validate
from wardscribe.plans.queries import QUERIES
from wardscribe.sources import files
from wardscribe.streaming import monitor

T0 = datetime(2024, 1, 1)
CALLS = "ts timestamp, key string, id long, ok boolean"


def at(s):
    return T0 + timedelta(seconds=s)


def breaker_by_hand(calls):
    out, failed, opened = [], [], None
    for t, ok in calls:
        if opened is not None and t - opened < 30:
            out.append(("open", False))
        elif opened is not None:
            out.append(("half-open", True))
            opened, failed = (None if ok else t), []
        else:
            out.append(("closed", True))
            if not ok:
                failed = [f for f in failed if t - f <= 60] + [t]
                if len(failed) >= 5:
                    opened, failed = t, []
    return out


def test_breaker_opens_and_tries_again(spark):
    calls = [(0, True)] + [(k, False) for k in range(1, 6)] + [(10, True), (36, False), (40, True), (70, True), (71, True)]
    df = spark.createDataFrame([(at(t), "stt", i, ok) for i, (t, ok) in enumerate(calls)], CALLS)
    got = [r.state for r in monitor.breaker(df).orderBy("id").collect()]
    assert got == ["closed"] * 6 + ["open", "half-open", "open", "half-open", "closed"]


def test_breaker_by_hand_over_many_batches(spark):
    rng = random.Random(4)
    keys = {k: [(t, rng.random() < 0.4) for t in sorted(rng.sample(range(4000), 400))] for k in "abc"}
    rows = [(at(t), k, i, ok) for k, calls in keys.items() for i, (t, ok) in enumerate(calls)]
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = monitor.breaker(spark.createDataFrame(rows, CALLS)).collect()
        n = monitor.token_bucket(spark.createDataFrame([r[:2] for r in rows], "ts timestamp, key string"), 0.05, 3.0).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k, calls in keys.items():
        mine = [(r.state, r.passed) for r in sorted((r for r in got if r.key == k), key=lambda r: r.id)]
        assert mine == breaker_by_hand(calls)
    assert {r.key: r.allowed + r.refused for r in n} == dict.fromkeys("abc", 400)


def test_stale_publishes_conflict(spark):
    rows = [(at(0), "er", 0, 0), (at(1), "er", 1, 0), (at(2), "er", 2, 1), (at(3), "er", 3, None), (at(0), "icu", 4, 1)]
    got = monitor.publish_conflicts(spark.createDataFrame(rows, "ts timestamp, key string, id long, based_on long")).orderBy("id").collect()
    assert [(r.version, r.error_code) for r in got] == [(1, None), (1, 409), (2, None), (2, 409), (0, 409)]


def test_cache_lives_and_is_dropped(spark):
    rows = [(0, "template", "get"), (10, "template", "put"), (20, "template", "get"), (3609, "template", "get"), (3611, "template", "get"), (4000, "template", "put"), (4001, "template", "drop"), (4002, "template", "get"), (0, "other", "put"), (1, "other", "get")]
    df = spark.createDataFrame([(at(t), "k", kind, a) for t, kind, a in rows], "ts timestamp, key string, kind string, action string")
    got = [r.hit for r in monitor.cache_hits(df).orderBy("kind", "ts").collect()]
    assert got == [False, False, True, True, False, False]


def test_empty_folds(spark):
    df = spark.createDataFrame([], CALLS)
    assert monitor.breaker(df).count() == 0 and monitor.token_bucket(df).count() == 0
    assert monitor.breaker(spark.createDataFrame([(at(0), None, 1, True)], CALLS)).count() == 0


@pytest.fixture(scope="module")
def note(spark):
    text = "Patient has fever. Give dolo 650 mg BD for 3 days. Patient denies chest pain. No penicillin allergy. Review after 5 days."
    return spark.createDataFrame([(1, text), (2, "Nothing to report.")], "job_id long, text string")


def test_provenance(note):
    sents = extract.sentences(note, numbers=False)
    seg = audio.mock_segments(note, sents)
    found = {(r.job_id, r.sent): r.id for r in provenance.segment_of(sents, seg).collect()}
    assert found == {(1, k): k for k in range(5)} | {(2, 0): 0}
    w = provenance.words(seg).where("job_id = 1").orderBy("id", "pos").collect()
    assert [x.word for x in w[:3]] == ["Patient", "has", "fever."] and w[0].start == 0.2
    clicks = note.sparkSession.createDataFrame([(1, 0, 0.53), (1, 1, 1.3), (1, 2, 99.0)], "job_id long, click int, at double")
    assert [(r.click, r.word) for r in provenance.word_at(clicks, provenance.words(seg)).collect()] == [(0, "has")]


def test_page_lines(spark, note):
    sents = extract.sentences(note, numbers=False)
    sym, al = extract.symptoms(sents), extract.allergies(sents)
    drugs = extract.resolve_drugs(extract.drug_mentions(sents), L.aliases(spark), False)
    no = provenance.denied_lines(al, sym)
    assert [(r.text, r.y) for r in no.orderBy("line").collect()] == [("penicillin", 154.0), ("chest pain", 156.8)]
    inline = provenance.inline_words(note, sym, drugs).orderBy("slot").collect()
    assert [(r.word, r.x, r.y) for r in inline] == [("fever", 37.9, 66), ("chest pain", 140.7, 66)]
    p = provenance.proof_strip(note, audio.mock_segments(note, sents), drugs, slots.vitals_boxes(extract.vitals(sents)), no, extract.findings(note)).orderBy("job_id").collect()
    assert p[0].heard.startswith('Heard: "Give dolo 650 mg BD for 3 days." [seg 0 0.2-') and p[0].more.startswith("DENIED: penicillin; DENIED: chest pain; Follow-up: ")
    assert p[1].heard.startswith('Heard: "Nothing to report." [seg 0') and p[1].more == ""


def test_review_refusals(spark):
    drugs = spark.createDataFrame([(1, "insulin", "U"), (2, "salbutamol", "mcg"), (3, "paracetamol", "mg"), (4, "insulin", "U")], "job_id long, name string, unit string")
    r = spark.createDataFrame([(1, 9.0, "a", None, False), (2, 4.0, "a", "a", False), (3, 9.0, "a", None, True), (4, 9.0, "a", "b", False)], "job_id long, seconds double, reviewer string, reviewer_2 string, bulk_red boolean")
    got = {(x.job_id, x.code) for x in validate.review_refusals(r, drugs, L.drugs(spark)).collect()}
    assert got == {(1, "SECOND_REVIEWER_REQUIRED"), (2, "REVIEW_TOO_FAST"), (2, "SECOND_REVIEWER_REQUIRED"), (3, "BULK_ACCEPT_RED")}


def test_duration_kind(spark):
    s = spark.createDataFrame([("Give it for 5 days.",), ("A 5-day history of fever.",), ("Fever 3 days.",), ("Fever.",), (None,)], "t string")
    assert [r[0] for r in s.select(validate.duration_kind(F.col("t"))).collect()] == ["therapy", "history", "unclear", None, None]


def test_documents_open(spark):
    s = spark.createDataFrame([(1, "b", "x < y & z"), (1, "a", "one\x07"), (2, "a", None)], "job_id long, key string, text string")
    got = {r.job_id: r.docx for r in files.render_docx(s).collect()}
    z = zipfile.ZipFile(io.BytesIO(bytes(got[1])))
    assert z.testzip() is None and "[Content_Types].xml" in z.namelist()
    assert ["".join(p.itertext()) for p in ElementTree.fromstring(z.read("word/document.xml"))[0]] == ["a: one", "b: x < y & z"]
    again = {r.job_id: bytes(r.docx) for r in files.render_docx(s.repartition(3)).collect()}
    assert again == {k: bytes(v) for k, v in got.items()}


def test_consent_and_export_cover_every_order(spark, sf):
    jobs = spark.createDataFrame([(1, True, "a", "t"), (2, False, "b", "t"), (3, None, "c", None)], "job_id long, consent boolean, raw_path string, text string")
    assert sorted(map(tuple, validate.stored(jobs).select("job_id", "raw_path", "text").collect())) == [(1, "a", "t"), (2, None, "t"), (3, None, None)]
    every = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert QUERIES["stored_jobs"](spark, sf).count() == QUERIES["export_gate"](spark, sf).count() == every
    assert QUERIES["stored_jobs"](spark, sf).where("not consent and raw_path is not null").count() == 0
