"""Corrections written back into entities."""

import pytest
from pyspark.sql import functions as F

from wardscribe.operators.candidates import DRUG, TEXT, VITALS
from wardscribe.operators.patch import patch_entities

SCHEMA = f"job_id long, drugs array<{DRUG}>, structured {VITALS}, symptoms array<{TEXT}>, allergies array<{TEXT}>, diagnosis {TEXT}, followup {TEXT}, patient {TEXT}, boxes {VITALS}, icd10 string, signature string, verified boolean"


def said(text, negated=False):
    return (text, 0.9, "RED", negated, "", "")


def drug(name, dose=500.0):
    return (name, dose, "mg", "", "", 0.7, "RED", "", "")


@pytest.fixture(scope="module")
def apply(spark):
    def run(edits, **over):
        base = dict(drugs=[drug("dolo")], structured=None, symptoms=[said("chest pain", True), said("fever")], allergies=[said("penicillin", True), said("dust")], diagnosis=None, followup=None, patient=None, boxes=("120", "80", "NIL", None), icd10=None, signature=None, verified=True) | over
        e = spark.createDataFrame([(1, k, v, t, n) for n, (k, v, t) in enumerate(edits)], "job_id long, key string, value string, ts long, id long")
        return patch_entities(spark.createDataFrame([(1, *base.values())], SCHEMA), e).first()

    return run


def trail(r):
    return [(a.key, a.original, a.corrected) for a in r.audit]


def test_last_edit_counts_and_takes_verified_back(apply):
    r = apply([("cc_blank", "cough", 5), ("cc_blank", " cold ", 9), ("nothing", "x", 9)])
    assert [s.text for s in r.symptoms] == ["chest pain", "cold"] and r.symptoms[1].color == "YELLOW"
    assert trail(r) == [("cc_blank", "fever", "cold")] and r.audit[0].ts == 9 and r.verified is False


def test_unchanged_edits_leave_no_trail(apply):
    assert apply([("cc_blank", "fever", 1), ("drug_0_dose", "500", 1)]).verified is True
    r = apply([])
    assert r.audit == [] and r.verified is True and r.structured is None and r.drugs[0].color == "RED"


def test_untouched_vitals_are_carried_over(apply):
    r = apply([("vitals_temp", "101", 1)])
    assert tuple(r.structured) == ("120", "80", "101", None) and trail(r) == [("vitals_temp", "", "101")]
    r = apply([("vitals_temp", "NIL", 1)], structured=("110", None, "99", "97"))
    assert tuple(r.structured) == ("110", "80", "", "97") and trail(r) == [("vitals_temp", "99", "")]


def test_drug_rows_are_added(apply):
    r = apply([("drug_1_name", "azithral", 1), ("drug_1_dose", "two spoons", 1), ("drug_0_dose", "NIL", 1)])
    assert [(d.name, d.dose, d.color, d.confidence) for d in r.drugs] == [("dolo", None, "YELLOW", 0.85), ("azithral", None, "YELLOW", 0.85)]
    assert r.drugs[1].note == "human-added dose as written: two spoons"
    assert trail(r) == [("drug_0_dose", "500.0", None), ("drug_1_name", "", "azithral"), ("drug_1_dose", None, "two spoons")]
    assert [d.name for d in apply([("drug_1_name", "x", 1)], drugs=None).drugs] == ["", "x"]


def test_denied_allergies_stay(apply):
    r = apply([("allergy_line", "nuts; ; NIL known;latex", 1)])
    assert [(a.text, a.negated) for a in r.allergies] == [("penicillin", True), ("nuts", False), ("latex", False)]
    assert trail(r) == [("allergy_line", "dust", "nuts; ; NIL known;latex")]


def test_texts_and_missing_columns(apply):
    r = apply([("dx_text", "flu", 1), ("dx_code_box", "A00", 1), ("fu_text", "nil", 1), ("sign_line", "R", 1), ("patient_name", "Asha", 1), ("cc_blank", None, 1)], symptoms=None)
    assert (r.diagnosis.text, r.icd10, r.followup.text, r.signature, r.patient.text, r.symptoms[0].text) == ("flu", "A00", "", "R", "Asha", "")
    assert [k for k, _, _ in trail(r)] == ["patient_name", "dx_text", "dx_code_box", "sign_line"]
