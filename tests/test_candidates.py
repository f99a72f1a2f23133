"""Model output to typed candidates, and merges: goldens and a plain version of the drug merge."""

import json
import random
from difflib import SequenceMatcher

import pytest

from wardscribe.operators import candidates as C

OCR = "\n".join(["Patient Name: Ravi Kumar", "Temp: 101 F", "Tab Paracetamol 500 mg twice daily for 3 days", "BP 130/80", "No known allergy", "Impression: viral fever", "Review after 3 days"])
GOOD = {
    "patient_name": "Ravi Kumar", "chief_complaint": "fever",
    "drugs": [{"name": "paracetamol", "dose": 500, "unit": "mg", "frequency": "twice daily", "duration": "3 days", "source_line": "Tab Paracetamol 500 mg twice daily for 3 days", "line_no": 2}],
    "vitals": {"sys": "130", "dia": "80", "temp": "101 F", "spo2": ""},
    "diagnosis": {"text": "viral fever", "source_line": "Impression: viral fever", "line_no": 5}, "followup": {"text": "Review after 3 days", "source_line": "Review after 3 days", "line_no": 6},
}
FOUND = "job_id long, " + ", ".join(f"{k} {t}" for k, t in C.ENTITIES.items())


def drug(name, dose=None, unit=None, frequency="", duration="", note=""):
    return (name, dose, unit, frequency, duration, 0.9, "GREEN", "", note)


def typed(spark, raws, text=OCR, image=True):
    rows = [(i, r if isinstance(r, str) or r is None else json.dumps(r), text) for i, r in enumerate(raws)]
    return C.entities(spark.createDataFrame(rows, "job_id long, raw string, text string"), image)


def found(spark, drugs=(), vitals=(), ids=(0,), **more):
    row = {"drugs": list(drugs), "vitals": [(v, 0.9, "GREEN", False, "", "") for v in vitals], "symptoms": [], "allergies": []} | more
    return spark.createDataFrame([(i, *[row.get(k) for k in C.ENTITIES]) for i in ids], FOUND)


def test_image_output_fills_what_was_missed(spark):
    c = typed(spark, [GOOD])
    base = found(spark, [drug("paracetamol", 500.0, "mg", "twice daily", "3 days")], ["Temp: 101 F", "BP 130/80"])
    m = C.merge_candidates(base, c, spark.createDataFrame([(0, OCR)], "job_id long, text string")).first()
    assert m.diagnosis.text == "viral fever" and m.followup.text == "Review after 3 days" and m.patient.text == "Ravi Kumar"
    assert [d.name for d in m.drugs] == ["paracetamol"] and m.symptoms[0].text == "fever"
    assert [v.text for v in m.vitals] == ["Temp: 101 F", "BP 130/80", "101 F"] and m.structured.sys is None  # a bare number is of no kind, so it is added


def test_invented_values_go(spark):
    bad = GOOD | {"drugs": [{"name": "mysterycure", "dose": 100, "unit": "mg", "source_line": "Take mysterycure 100 mg daily"}], "vitals": {"sys": "999", "dia": "99"}, "patient_name": "Nobody", "symptoms_denied": ["chest pain"], "allergies_active": ["dust"], "allergies_denied": ["known allergy"]}
    r = typed(spark, [bad]).first()
    assert r.drugs == [] and r.vitals == [] and r.structured.sys is None and r.patient is None
    assert [s.text for s in r.symptoms] == ["fever"] and [a.text for a in r.allergies] == ["known allergy"]


def test_gate_clears_a_proof_that_is_not_there(spark):
    r = typed(spark, [{"drugs": [{"name": "paracetamol", "dose": "500", "unit": "mg", "source_line": "made up"}, {"name": "Paracetamol", "dose": "many", "unit": "spoons"}], "diagnosis": {"text": "flu", "source_line": "made up"}}]).first()
    assert [(d.dose, d.unit, d.confidence, d.proof, d.note) for d in r.drugs] == [(500.0, "mg", 0.8, "", "llm-image unprovenance"), (None, None, 0.7, "", "llm-image dose/unit missing")]
    assert r.diagnosis.proof == "" and r.diagnosis.confidence == 0.8 and r.diagnosis.note == "llm-image unprovenance"


def test_outputs_of_any_shape(spark):
    raws = [None, "", "hello", '{"drugs": [}', '{"other": 1}', "[1, 2]", {"drugs": "text", "vitals": [1]}, {"drugs": [1, None, {"dose": 5}, {"name": ""}, {"name": "x"}, [2]]}, {"chief_complaint": {"a": 1}, "followup": "in a week", "diagnosis": "flu"}, 'thinking... {"drugs": []} and {"vitals": {"temp": 101, "sys": 130, "dia": 80}} done']
    r = typed(spark, raws, image=False).orderBy("job_id").collect()
    assert [x.status for x in r] == ["no_json", "no_json", "no_json", "unparsable", "missing_keys", "no_json", "ok", "ok", "ok", "ok"]
    assert [x.n_malformed for x in r] == [0, 0, 0, 0, 0, 0, 0, 5, 0, 0]
    assert r[8].followup.text == "in a week" and r[8].diagnosis is None
    assert [v.text for v in r[9].vitals] == ["BP 130/80", "101"]
    counts = {x.status: (x.notes, x.malformed) for x in C.output_counts(typed(spark, raws, image=False)).collect()}
    assert counts == {"no_json": (4, 0), "unparsable": (1, 0), "missing_keys": (1, 0), "ok": (4, 5)}


def plain_merge(base, new):
    """The drug merge over dictionaries."""
    fields = ("dose", "unit", "frequency", "duration")
    out = [dict(d) for d in base]
    for t in new:
        scores = [SequenceMatcher(None, t["name"].lower(), d["name"].lower()).ratio() for d in out]
        k = scores.index(max(scores)) if scores else None
        if k is not None and scores[k] >= 0.6:
            out[k] |= {f: t[f] for f in fields if out[k][f] in (None, "", 0) and t[f] not in (None, "", 0)}
        elif t["name"]:
            out.append(dict(t))
    return [tuple(d[f] for f in ("name", *fields)) for d in out]


def test_merge_equals_the_plain_version(spark):
    rng = random.Random(1)
    names = ["paracetamol", "paracetmol", "Parcetamol", "azithromycin", "azithral", "asitromaisin", "insulin", "insuline", "", "dolo"]

    def some():
        return [{"name": rng.choice(names), "dose": rng.choice([None, 0.0, 5.0, 500.0]), "unit": rng.choice([None, "", "mg"]), "frequency": rng.choice(["", "daily"]), "duration": rng.choice(["", "3 days", None])} for _ in range(rng.randrange(5))]

    notes = [(i, some(), some()) for i in range(150)]
    frame = lambda k: spark.createDataFrame([(n[0], [drug(*(d[f] for f in ("name", "dose", "unit", "frequency", "duration"))) for d in n[k]], *[None] * 7) for n in notes], FOUND)
    got = {r.job_id: [(d.name, d.dose, d.unit, d.frequency, d.duration) for d in r.drugs] for r in C.merge_candidates(frame(1), frame(2)).collect()}
    assert got == {i: plain_merge(a, b) for i, a, b in notes}


def test_spoken_candidates(spark):
    """Vitals of unfilled kinds only, structured vitals replaced, symptoms by their text, notes without candidates."""
    out = {"drugs": [], "vitals": {"sys": "130", "dia": "80", "temp": "101", "spo2": "97%"}, "symptoms_denied": ["Chest Pain", "cough"], "diagnosis": {"text": "flu"}}
    base = found(spark, vitals=["BP 130 by 80"], ids=(0, 1), symptoms=[("chest pain", 0.9, "GREEN", True, "", "")], structured=("130", "80", None, None), diagnosis=("cold", 0.9, "GREEN", False, "", ""))
    rows = {r.job_id: r for r in C.merge_candidates(base, typed(spark, [out], "BP 130 by 80, 101 and 97%", False)).collect()}
    r = rows[0]
    assert [v.text for v in r.vitals] == ["BP 130 by 80", "101", "97%"] and tuple(r.structured) == (None, None, "101", "97%")
    assert [s.text for s in r.symptoms] == ["chest pain", "cough"] and r.diagnosis.text == "cold"
    assert [v.text for v in rows[1].vitals] == ["BP 130 by 80"] and rows[1].structured.sys == "130"


def test_image_doses_need_their_print(spark):
    text = spark.createDataFrame([(0, "Tab Paracetamol 500 mg twice daily")], "job_id long, text string")
    m = C.merge_candidates(found(spark, [drug("paracetamol")]), found(spark, [drug("paracetamol", 500.0, "mg", "Twice Daily", "9 days")]), text).first().drugs[0]
    assert (m.dose, m.unit, m.frequency, m.duration, m.note) == (None, None, "Twice Daily", "", "llm-image-gapfill")


def test_tidied_drugs(spark):
    base = found(spark, [drug("Dolo", None, "mg"), drug("dolo", 0.0, "spoon"), drug("insulin", 5.0, "U")])
    tidy = found(spark, [drug("dolo", 650.0, "mg", "daily"), drug(None), drug("azee", 500.0, "tab")])
    r = C.merge_tidied(base, tidy).first()
    assert [(d.name, d.dose, d.unit, d.frequency, d.confidence) for d in r.drugs] == [("dolo", 650.0, None, "daily", 0.9), ("insulin", 5.0, "U", "", 0.9), ("azee", 500.0, None, "", 0.85)] and r.n_dropped == 1


@pytest.mark.parametrize("merge", [C.merge_candidates, C.merge_tidied])
def test_no_rows(spark, merge):
    none = found(spark, ids=())
    assert merge(none, none).count() == 0
