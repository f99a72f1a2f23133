"""Word lists and dimensions of the discharge-note engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Wordings that the results depend on.
LEXICON = [
    ("bukhar", "fever"), ("बुखार", "fever"), ("khansi", "cough"), ("खांसी", "cough"),
    ("do time", "twice daily"), ("din tak", "days"), ("din", "days"),
    ("BID", "twice daily"), ("OD", "once daily"), ("TDS", "thrice daily"),
    ("500 मिलीग्राम", "500 mg"), ("मिलीग्राम", "mg"), ("माइक्रोग्राम", "mcg"),
]
SYMPTOMS = ["fever", "cough", "chest pain", "headache", "vomiting", "diarrhea", "breathlessness", "sore throat", "cold", "pain", "bukhar", "khansi"]
DENIABLE = ("chest pain", "breathlessness")
ALLERGENS = ("penicillin", "sulfa", "sulpha")
SYMPTOM_CANON = {"khansi": "cough", "bukhar": "fever"}
UNITS = {"milligram": "mg", "milligrams": "mg", "microgram": "mcg", "micrograms": "mcg", "gram": "g", "grams": "g", "milliliter": "ml", "milliliters": "ml", "units": "U", "unit": "U"}
# name, aliases, usual unit, most mg a day, high risk, allergy watch
DRUGS = [
    ("paracetamol", ["paracetemol", "parcetamol", "crocin", "dolo"], "mg", 4000.0, False, False),
    ("azithromycin", ["azithral", "azee", "asitromaisin", "acytromycin", "acytromicin", "thromice"], "mg", 500.0, False, False),
    ("amoxicillin", ["amox", "moxasillin", "amoxasillin", "amoxicilin", "moxicillin"], "mg", 3000.0, False, False),
    ("ibuprofen", ["brufen"], "mg", 1200.0, False, False),
    ("cetirizine", ["cetrizine", "zyrtec"], "mg", 10.0, False, False),
    ("metformin", [], "mg", 2550.0, False, False),
    ("amlodipine", [], "mg", 10.0, False, False),
    ("atorvastatin", [], "mg", 80.0, False, False),
    ("omeprazole", [], "mg", 40.0, False, False),
    ("pantoprazole", [], "mg", 40.0, False, False),
    ("aspirin", ["ecosprin"], "mg", 300.0, False, False),
    ("clopidogrel", [], "mg", 75.0, False, False),
    ("insulin", ["insuline", "huminsulin"], "U", None, True, False),
    ("levothyroxine", ["thyroxine", "thyronorm"], "mcg", None, True, False),
    ("warfarin", [], "mg", 10.0, True, False),
    ("salbutamol", ["asthalin"], "mcg", None, False, False),
    ("budesonide", [], "mcg", None, False, False),
    ("doxycycline", [], "mg", 200.0, False, False),
    ("ciprofloxacin", ["ciplox"], "mg", 1500.0, False, False),
    ("ondansetron", ["emset", "zofran"], "mg", 24.0, False, False),
    ("ranitidine", [], "mg", 300.0, False, False),
    ("diclofenac", ["voveran"], "mg", 150.0, False, False),
    ("tramadol", [], "mg", 400.0, False, False),
    ("losartan", [], "mg", 100.0, False, False),
    ("metoprolol", [], "mg", 200.0, False, False),
    ("furosemide", ["lasix"], "mg", 600.0, False, False),
    ("prednisolone", [], "mg", 60.0, False, False),
    ("dextromethorphan", [], "mg", 120.0, False, False),
    ("penicillin", [], "mg", None, False, True),
    ("sulfa", ["sulpha"], "mg", None, False, True),
]
FREQ_PER_DAY = {"once daily": 1, "od": 1, "daily": 1, "twice daily": 2, "bid": 2, "bd": 2, "twice a day": 2, "two times a day": 2, "thrice daily": 3, "tds": 3, "tid": 3, "thrice a day": 3, "three times a day": 3, "qid": 4}


def drugs(spark: SparkSession) -> DataFrame:
    """The drug dimension, 30 rows."""
    return spark.createDataFrame(DRUGS, "name string, aliases array<string>, usual_unit string, max_daily_mg double, high_risk boolean, allergy_watch boolean")


def aliases(spark: SparkSession) -> DataFrame:
    """(alias, canonical): every surface form, its own name included."""
    return spark.createDataFrame([(a, d[0]) for d in DRUGS for a in (d[0], *d[1])], "alias string, canonical string")
