"""Goldens of the discharge-note engine, from wording to fields."""

import pytest
from pyspark.sql import functions as F

from wardscribe.functions import lexicon as L
from wardscribe.functions.normalize import lang_tag, normalize, number_words
from wardscribe.operators import extract, merge, ocr, slots, validate

TEXTS = {
    1: "Patient ko fever hai, bukhar 101 degree, give paracetamol 500 mg BID, do time, 3 din tak. No allergy.",
    2: "Khansi hai, cough for 5 days, BP 130 by 80, give azithromycin 500 mg once daily 3 days. No penicillin allergy, patient denies chest pain.",
    3: "Patient has fever. BPA 130 by AC, give asitromaisin 500 mg once daily for 3 days.",
    4: "Blood pressure is around 122 of 78. Give amoxicillin 875 milligrams twice a day for 7 days along with ibuprofen, for 100 mg every 8 hours. Temp is currently 100.4 degrees fahrenheit. 99% on room air.",
    5: "Patient doesn't have any known allergy to a moxasillin.",
    6: None,
    7: "",
}


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(list(TEXTS.items()), "job_id long, text string")


@pytest.fixture(scope="module")
def sents(notes):
    return extract.sentences(notes).cache()


def drugs(spark, sents):
    rows = extract.resolve_drugs(extract.drug_mentions(sents), L.aliases(spark)).collect()
    return {(r.job_id, r.name): r for r in rows}


def test_drugs(spark, sents):
    d = drugs(spark, sents)
    assert d[1, "paracetamol"].dose == 500.0 and d[1, "paracetamol"].frequency == "BID" and d[1, "paracetamol"].duration == "3 din"
    assert (d[2, "azithromycin"].frequency, d[2, "azithromycin"].duration) == ("once daily", "3 days")
    assert d[3, "azithromycin"].color == "GREEN"
    a, i = d[4, "amoxicillin"], d[4, "ibuprofen"]
    assert (a.dose, a.unit, a.frequency, a.duration) == (875.0, "mg", "twice a day", "7 days")
    assert (i.dose, i.frequency) == (100.0, "every 8 hours")
    assert {k for k in d} == {(1, "paracetamol"), (2, "azithromycin"), (3, "azithromycin"), (4, "amoxicillin"), (4, "ibuprofen")}


def test_fuzzy_name(spark):
    s = extract.sentences(spark.createDataFrame([(1, "Give moxacillin 250 mg. Give xyzzyq 5 mg.")], "job_id long, text string"))
    d = drugs(spark, s)
    assert list(d) == [(1, "amoxicillin")] and d[1, "amoxicillin"].color == "YELLOW" and d[1, "amoxicillin"].confidence == 0.88
    image = extract.resolve_drugs(extract.drug_mentions(s), L.aliases(spark), fuzzy=False)
    assert image.count() == 0


def test_boxes(sents, notes):
    raw = {r.job_id: r for r in slots.vitals_boxes(extract.vitals(sents)).collect()}
    assert raw[1].temp == "101 degree" and raw[1].sys == "NIL"
    assert (raw[2].sys, raw[2].dia) == ("130", "80")
    assert (raw[4].sys, raw[4].dia) == ("122", "78") and raw[4].temp.startswith("100.4") and raw[4].spo2.startswith("99")


def test_normalized(notes):
    n = {r.job_id: r for r in normalize(notes).collect()}
    assert "BP 130/80" in n[3].normalized_en and "122/78" in n[4].normalized_en and "twice daily" in n[1].normalized_en
    assert [e["from"] for e in n[3].normalizations] == ["BPA", "by AC"]
    assert n[1].lang_tag == "mix" and n[7].normalized_en == "" and n[6].normalized_en is None


def test_equal_image_rows_stay_apart(spark):
    x = spark.createDataFrame([(1, "BP 130 by 80\nfive mg")] * 2 + [(2, None)], "job_id long, text string")
    got = [(r.job_id, r.normalized_en, len(r.normalizations or [])) for r in normalize(x, source="image").orderBy("job_id").collect()]
    assert got[:2] == [(1, "BP 130/80\n5 mg", 0)] * 2 and got[2][0] == 2 and not got[2][2]


def test_image_lines_are_apart(spark):
    x = spark.createDataFrame([(1, "BPA 130 by AC\nparacetamol\n500mg")], "job_id long, text string")
    r = normalize(x, source="image").first()
    assert r.normalized_en == "BPA 130 by AC\nparacetamol\n500 mg"
    assert [s.raw for s in extract.sentences(x, source="image").orderBy("sent").collect()] == ["BPA 130 by AC", "paracetamol", "500mg"]


@pytest.mark.parametrize(("said", "digits"), [("one thirty by eighty", "130 by 80"), ("five-hundred mg", "500 mg"), ("nineteen eighty", "99"), ("five and six", "11"), ("zero", "zero"), ("and", "and"), ("hundred", "100"), ("Twenty five", "25"), ("someone", "someone")])
def test_number_words(spark, said, digits):
    assert spark.createDataFrame([(said,)], "t string").select(number_words("t")).first()[0] == digits


def test_language_tags(spark):
    rows = [("fever", "en-IN"), ("बुखार", "hi-IN"), ("காய்ச்சல்", "ta-IN"), ("fever बुखार", "mix"), ("fever hai", "mix"), ("", "en-IN")]
    for r in spark.createDataFrame(rows, "t string, want string").select(lang_tag(F.col("t")).alias("got"), "want").collect():
        assert r.got == r.want


def test_symptoms_and_allergies(sents):
    s = {(r.job_id, r.symptom): r.negated for r in extract.symptoms(sents).collect()}
    assert s[2, "chest pain"] and not s[2, "cough"] and (2, "pain") not in s
    a = {(r.job_id, r.allergen): r.negated for r in extract.allergies(sents).collect()}
    assert a[2, "penicillin"] and a[5, "moxasillin"]


def test_candidates_are_gated(spark):
    raw = 'thinking {"a": 1} ok ```{"name": "para\x1b[4D\x1b[Kx{", "n": 2}``` end'
    assert spark.createDataFrame([(raw,), ("none",), (None,)], "t string").select(merge.salvage_json("t").alias("j")).collect()[0].j == '{"name": "x{", "n": 2}'
    x = spark.createDataFrame([("BP 130/80", "999/99"), ("BP 130/80", "13"), ("BP", "none")], "s string, v string")
    assert [r[0] for r in x.select(merge.digits_supported(F.col("v"), F.col("s"))).collect()] == [False, True, True]


def test_reading_order(spark):
    rows = [(1, 1, "left", 0.0, 10.0, 20.0, 0.9), (1, 2, "right", 50.0, 12.0, 22.0, 0.7), (1, 3, "below", 0.0, 40.0, 50.0, 0.8)]
    got = ocr.lines(spark.createDataFrame(rows, "job_id long, block_id long, text string, x0 double, y0 double, y1 double, confidence double")).orderBy("line").collect()
    assert [(r.text, r.min_confidence, r.n_blocks) for r in got] == [("left right", 0.7, 2), ("below", 0.8, 1)]


def test_edits_open_the_gate(spark):
    s = spark.createDataFrame([(1, "dx_code_box", "NIL", "RED"), (2, "dx_code_box", "NIL", "RED")], "job_id long, key string, text string, color string")
    e = spark.createDataFrame([(1, "dx_code_box", "A00", 2), (1, "dx_code_box", "B00", 1)], "job_id long, key string, value string, ts long")
    new, audit = slots.apply_edits(s, e)
    assert [tuple(r) for r in audit.collect()] == [(1, "dx_code_box", "NIL", "A00", 2)]
    assert {r.job_id: r.may_verify for r in slots.gate(new, audit).collect()} == {1: True, 2: False}


def test_overlaps_by_brute_force(spark):
    import random

    random.seed(3)
    seg = [(j, i, (a := random.uniform(0, 60)), a + random.uniform(0.1, 9)) for j in range(3) for i in range(40)]
    got = {tuple(r)[:3] for r in validate.overlaps(spark.createDataFrame(seg, "job_id long, id long, start double, end double")).collect()}
    want = {(x[0], x[1], y[1]) for x in seg for y in seg if x[0] == y[0] and (x[2], x[1]) < (y[2], y[1]) and min(x[3], y[3]) - y[2] > 0.3}
    assert got == want
