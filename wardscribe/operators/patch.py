"""Corrections written back into a note's entities, with their audit, in the note's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import DRUG, TEXT

# Fields that can be corrected, and the entity each one changes.
DRUG_FIELDS = ("name", "dose", "unit", "freq", "duration")
VITAL_FIELDS = {"vitals_bp_sys": "sys", "vitals_bp_dia": "dia", "vitals_temp": "temp", "vitals_spo2": "spo2"}
KEYS = ("patient_name", "cc_blank", *[f"drug_{i}_{f}" for i in (0, 1) for f in DRUG_FIELDS], *VITAL_FIELDS, "allergy_line", "dx_text", "dx_code_box", "fu_text", "sign_line")
ADDED, CORRECTED = "human-added", "human-corrected"


def _nil(x: Column) -> Column:
    return F.upper(x).startswith("NIL")


def _blank_if_nil(x: Column) -> Column:
    return F.when(_nil(x), "").otherwise(x)


def _str(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def dose_value(x: Column) -> Column:
    """The number that a dose cell states; null for empty, NIL and other text."""
    return F.when(~_nil(x), x.try_cast("double"))


def _human(text: Column, confidence: float, note: str) -> Column:
    return F.struct(text.alias("text"), F.lit(confidence).alias("confidence"), F.lit("YELLOW").alias("color"), F.lit(False).alias("negated"), F.lit("").alias("proof"), F.lit(note).alias("note")).cast(TEXT)


def patch_entities(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """entities with the last edit of each field, and audit: array of (key, original, corrected, ts).

    entities: job_id, columns of candidates.ENTITIES, and boxes (the vitals as
    the form shows them, same type as structured), icd10, signature, verified.
    edits: job_id, key, value, ts, id; the greatest (ts, id) of a field counts,
    unknown keys do not, a null value is an empty one.

    An edit that changes nothing is not audited; one that does takes `verified`
    back. A complaint goes to the first symptom that is not denied, drug cells to
    the first two drugs; what is missing there is added. A corrected vital makes
    `structured` the source of all four, so the others are carried over from
    boxes unless NIL. Denied allergies stay, the active ones are replaced. A dose
    that is no number is null, and the drug's note keeps what was written.
    """
    last = edits.where(F.col("key").isin(*KEYS)).groupBy("job_id").agg(*[F.max(F.when(F.col("key") == k, F.struct("ts", "id", F.trim(F.coalesce("value", F.lit(""))).alias("value")))).alias(f"_{k}") for k in KEYS])
    x = entities.join(last, "job_id", "left")
    given = {k: F.col(f"_{k}").isNotNull() for k in KEYS}
    new = {k: F.col(f"_{k}")["value"] for k in KEYS} | {k: _blank_if_nil(F.col(f"_{k}")["value"]) for k in ("patient_name", "fu_text", *VITAL_FIELDS)}
    none = F.array().cast(f"array<{TEXT}>")
    symptoms, allergies = F.coalesce("symptoms", none), F.coalesce("allergies", none)
    drugs = F.coalesce("drugs", F.array().cast(f"array<{DRUG}>"))
    denied = lambda s: F.coalesce(s["negated"], F.lit(False))
    audit = []

    def note(key: str, old: Column, now: Column) -> None:
        audit.append(F.when(given[key] & ~old.eqNullSafe(now), F.struct(F.lit(key).alias("key"), old.alias("original"), now.alias("corrected"), F.col(f"_{key}")["ts"].alias("ts"))))

    def text_of(column: str, key: str) -> Column:
        old = F.coalesce(F.col(column), _human(F.lit(""), 0.0, "").withField("color", F.lit(None).cast("string")))
        return F.when(given[key], old.withField("text", new[key])).otherwise(F.col(column))

    note("patient_name", _str(F.col("patient")["text"]), new["patient_name"])
    patient = text_of("patient", "patient_name")
    patient = F.when(given["patient_name"], patient.withField("color", F.lit("YELLOW"))).otherwise(patient)

    at = F.array_position(F.transform(symptoms, denied), False)
    note("cc_blank", F.when(at > 0, _str(F.try_element_at(symptoms, at.cast("int"))["text"])).otherwise(""), new["cc_blank"])
    changed = F.transform(symptoms, lambda s, i: F.when(i + 1 == at, s.withField("text", new["cc_blank"]).withField("color", F.lit("YELLOW"))).otherwise(s))
    complaint = F.when(~given["cc_blank"], F.col("symptoms")).when(at > 0, changed).otherwise(F.concat(symptoms, F.array(_human(new["cc_blank"], 0.85, ADDED))))

    touched = [F.lit(False), F.lit(False)]
    for i in (0, 1):
        for f in DRUG_FIELDS:
            key, old = f"drug_{i}_{f}", F.get(drugs, F.lit(i))["frequency" if f == "freq" else f]
            touched[i] = touched[i] | given[key]
            number = dose_value(new[key])
            # a dose is compared as a number, other text as it is; both are shown as text
            note(key, old.cast("string") if f == "dose" else _str(old), (F.when(number.isNotNull(), number.cast("string")).when((new[key] != "") & ~_nil(new[key]), new[key])) if f == "dose" else new[key])
    blank = F.struct(F.lit("").alias("name"), F.lit(None).cast("double").alias("dose"), *[F.lit("").alias(c) for c in ("unit", "frequency", "duration")], F.lit(0.85).alias("confidence"), F.lit("YELLOW").alias("color"), F.lit("").alias("proof"), F.lit(ADDED).alias("note")).cast(DRUG)
    wanted = F.when(touched[1], 2).when(touched[0], 1).otherwise(0)
    padded = F.concat(drugs, F.array_repeat(blank, F.greatest(wanted - F.size(drugs), F.lit(0))))

    def row(d: Column, i: int) -> Column:
        out = d
        for f in DRUG_FIELDS:
            key, field = f"drug_{i}_{f}", "frequency" if f == "freq" else f
            out = out.withField(field, F.when(given[key], dose_value(new[key]) if f == "dose" else new[key]).otherwise(d[field]))
        written = new[f"drug_{i}_dose"]
        odd = given[f"drug_{i}_dose"] & dose_value(written).isNull() & (written != "") & ~_nil(written)
        out = out.withField("note", F.when(odd, F.trim(F.concat(_str(d["note"]), F.lit(" dose as written: "), written))).otherwise(d["note"]))
        return out.withField("color", F.lit("YELLOW")).withField("confidence", F.greatest(F.coalesce(d["confidence"], F.lit(0.0)), F.lit(0.85)))

    rows = F.when(touched[0] | touched[1], F.transform(padded, lambda d, n: F.when((n == 0) & touched[0], row(d, 0)).when((n == 1) & touched[1], row(d, 1)).otherwise(d))).otherwise(F.col("drugs"))

    any_vital = F.lit(False)
    for k in VITAL_FIELDS:
        any_vital = any_vital | given[k]
    vitals = []
    for k, f in VITAL_FIELDS.items():
        now, box = F.col("structured")[f], F.trim(F.col("boxes")[f])
        note(k, _str(now), new[k])
        vitals.append(F.when(given[k], new[k]).when(any_vital & now.isNull() & (box != "") & ~_nil(box), box).otherwise(now).alias(f))
    structured = F.when(any_vital, F.struct(*vitals)).otherwise(F.col("structured"))

    note("allergy_line", F.array_join(F.transform(F.filter(allergies, lambda a: ~denied(a)), lambda a: _str(a["text"])), "; "), new["allergy_line"])
    parts = F.filter(F.transform(F.split(new["allergy_line"], ";"), lambda p: F.trim(p)), lambda p: (p != "") & ~_nil(p))
    active = F.concat(F.filter(allergies, denied), F.transform(parts, lambda p: _human(p, 0.9, CORRECTED)))

    note("dx_text", _str(F.col("diagnosis")["text"]), new["dx_text"])
    diagnosis = text_of("diagnosis", "dx_text")
    diagnosis = F.when(given["dx_text"], diagnosis.withField("color", F.lit("YELLOW"))).otherwise(diagnosis)
    note("dx_code_box", _str(F.col("icd10")), new["dx_code_box"])
    note("fu_text", _str(F.col("followup")["text"]), new["fu_text"])
    note("sign_line", _str(F.col("signature")), new["sign_line"])

    done = {
        "drugs": rows, "structured": structured, "symptoms": complaint, "allergies": F.when(given["allergy_line"], active).otherwise(F.col("allergies")), "diagnosis": diagnosis, "followup": text_of("followup", "fu_text"), "patient": patient,
        "icd10": F.when(given["dx_code_box"], new["dx_code_box"]).otherwise(F.col("icd10")), "signature": F.when(given["sign_line"], new["sign_line"]).otherwise(F.col("signature")),
    }
    trail = F.array_compact(F.array(*audit))
    verified = F.coalesce("verified", F.lit(False)) & (F.size(trail) == 0)
    return x.select(*[(done[c] if c in done else verified if c == "verified" else F.col(c)).alias(c) for c in entities.columns], trail.alias("audit"))
