"""A model's free-form output as typed candidates, and their merge into what was found.

A note is one row throughout: candidates and findings are arrays in it, gates
and merges are folds over these arrays, and nothing is exploded or regrouped.
Output is parsed as VARIANT, so a value of an unexpected kind is a null of its
field and not a failed row.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merge import salvage_json

# Units that are kept, and the empty shapes of a note.
UNITS = ("mg", "mcg", "g", "ml", "U")
DRUG = "struct<name string, dose double, unit string, frequency string, duration string, confidence double, color string, proof string, note string>"
TEXT = "struct<text string, confidence double, color string, negated boolean, proof string, note string>"
VITALS = "struct<sys string, dia string, temp string, spo2 string>"
ENTITIES = {"drugs": f"array<{DRUG}>", "vitals": f"array<{TEXT}>", "structured": VITALS, "symptoms": f"array<{TEXT}>", "allergies": f"array<{TEXT}>", "diagnosis": TEXT, "followup": TEXT, "patient": TEXT}
ALIKE = 0.6
_NUMBER = r"\d+(?:\.\d+)?"


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str, kind: str = "variant") -> Column:
    return F.coalesce(_get(v, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def _said(x: Column) -> Column:
    """A value that is there: not null, empty, zero or false."""
    return x.isNotNull() & ~F.lower(x).isin("", "0", "0.0", "false")


def _in(x: Column, text: Column) -> Column:
    return F.contains(F.lower(text), F.lower(x))


def _first_number_in(x: Column, text: Column) -> Column:
    n = F.regexp_extract(x, _NUMBER, 0)
    return (n != "") & F.contains(text, n)


def _numbers_in(x: Column, text: Column) -> Column:
    n = F.regexp_extract_all(x, F.lit(f"({_NUMBER})"), F.lit(1))
    return (F.size(n) > 0) & F.forall(n, lambda d: F.contains(text, d))


def _text(text: Column, confidence: float, color: str | None, negated: bool = False, note: str = "", proof: Column | None = None) -> Column:
    proof = F.lit("") if proof is None else proof
    return F.struct(text.alias("text"), F.lit(confidence).alias("confidence"), F.lit(color).cast("string").alias("color"), F.lit(negated).alias("negated"), proof.alias("proof"), F.lit(note).alias("note")).cast(TEXT)


def _gated(item: Column, text: Column) -> Column:
    """A proof that does not occur in the text, nor its first 40 characters, goes; the confidence is then 0.8 at most."""
    proof = item["proof"]
    bad = (F.coalesce(proof, F.lit("")) != "") & ~F.contains(text, F.substring(proof, 1, 40)) & ~F.contains(text, proof)
    less = item.withField("proof", F.lit("")).withField("confidence", F.least(item["confidence"], F.lit(0.8))).withField("note", F.trim(F.concat(item["note"], F.lit(" unprovenance"))))
    return F.when(bad, less).otherwise(item)


def _drug(x: Column, proof: str, origin: str) -> Column:
    dose, unit = _get(x, "$.dose", "double"), _get(x, "$.unit")
    unit = F.when(unit.isin(*UNITS), unit)
    part = dose.isNull() | unit.isNull()
    blank = lambda path: F.when(_said(_get(x, path)), _get(x, path)).otherwise("")
    return F.struct(
        _get(x, "$.name").alias("name"), dose.alias("dose"), unit.alias("unit"), blank("$.frequency").alias("frequency"), blank("$.duration").alias("duration"),
        F.when(part, 0.7).otherwise(0.9).alias("confidence"), F.when(part, "RED").otherwise("YELLOW").alias("color"), F.coalesce(_get(x, f"$.{proof}"), F.lit("")).alias("proof"), F.when(part, f"{origin} dose/unit missing").otherwise(origin).alias("note"),
    ).cast(DRUG)


def entities(outputs: DataFrame, image: bool = False) -> DataFrame:
    """Typed candidates of outputs(job_id, raw, text): ENTITIES, and status, n_malformed.

    raw is what a model printed, text what the note says. status is ok, no_json
    (nothing balanced in it), unparsable, or missing_keys (no object with drugs,
    chief_complaint or vitals); all but ok have no candidates. n_malformed counts
    the drugs that are no objects or have no name; they go. Numbers of vitals must
    occur in the text. From images a drug, symptom, allergy, diagnosis' proof or
    patient must occur in it too, and active allergies are read as well.
    """
    origin, proof = ("llm-image", "source_line") if image else ("llm-primary", "source_sentence")
    text = F.coalesce("text", F.lit(""))
    note = origin if image else ""
    d = outputs.withColumn("_json", salvage_json(F.col("raw"))).withColumn("_v", F.try_parse_json("_json"))
    keys = F.map_keys(_get(F.col("_v"), "$", "map<string, variant>"))
    status = F.when(F.col("_json").isNull(), "no_json").when(F.col("_v").isNull(), "unparsable").when(F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, ("drugs", "chief_complaint", "vitals")))), F.lit(False)), "ok").otherwise("missing_keys")
    d = d.withColumn("status", status).withColumn("_v", F.when(F.col("status") == "ok", F.col("_v")))
    v = F.col("_v")
    d = d.withColumn("_all", F.transform(_list(v, "$.drugs"), lambda x: _drug(x, proof, origin)))
    named = F.filter("_all", lambda x: _said(x["name"]))
    drugs = F.transform(named, lambda x: _gated(x, text))
    if image:
        drugs = F.transform(F.filter(drugs, lambda x: _in(x["name"], text)), lambda x: x.withField("confidence", F.when(x["proof"] == "", F.least(x["confidence"], F.lit(0.8))).otherwise(x["confidence"])))
    sure = {k: F.when(_said(_get(v, f"$.vitals.{k}")) & _first_number_in(_get(v, f"$.vitals.{k}"), text), _get(v, f"$.vitals.{k}")) for k in ("sys", "dia", "temp", "spo2")}
    pair = sure["sys"].isNotNull() & sure["dia"].isNotNull()
    vitals = F.array_compact(F.array(
        F.when(pair, _text(F.concat(F.lit("BP "), sure["sys"], F.lit("/"), sure["dia"]), 0.88, "YELLOW", note=note)),
        *[F.when(sure[k].isNotNull(), _text(sure[k], 0.87, "YELLOW", note=note)) for k in ("temp", "spo2")],
    ))
    shown = (lambda x: _in(x, text)) if image else (lambda x: F.lit(True))
    listed = lambda path: F.filter(_list(v, path, "string"), lambda x: x.isNotNull() & shown(x))
    main = _get(v, "$.chief_complaint")
    symptoms = F.concat(
        F.when(_said(main) & shown(main), F.array(_text(main, 0.9, "YELLOW", note=note))).otherwise(F.array().cast(f"array<{TEXT}>")),
        F.transform(listed("$.symptoms_denied"), lambda x: _text(x, 0.91, "GREEN", True, "DENIED - excluded")),
    )
    allergies = F.transform(listed("$.allergies_denied"), lambda x: _text(x, 0.9, None, True, f"NEGATED - {origin}"))
    if image:
        allergies = F.concat(allergies, F.transform(listed("$.allergies_active"), lambda x: _text(x, 0.82, "YELLOW", False, f"{origin} - verify")))

    def one(key: str, confidence: float) -> Column:
        said = F.coalesce(_get(v, f"$.{key}.text"), _get(v, f"$.{key}")) if key == "followup" else _get(v, f"$.{key}.text")
        line = F.coalesce(_get(v, f"$.{key}.source_line"), F.lit("")) if image else None
        item = _text(said, confidence, "YELLOW", note=note, proof=line)
        return F.when(_said(said), _gated(item, text) if image else item)

    name = _get(v, "$.patient_name")
    patient = F.when(_said(name) & _in(name, text), _text(name, 0.85, "YELLOW", note=f"{origin} - verify")) if image else F.lit(None).cast(TEXT)
    pressure = {k: F.when(pair, sure[k]) for k in ("sys", "dia")}
    found = {
        "drugs": drugs, "vitals": vitals, "structured": F.struct(*[pressure.get(k, sure[k]).alias(k) for k in sure]), "symptoms": symptoms, "allergies": allergies,
        "diagnosis": one("diagnosis", 0.85), "followup": one("followup", 0.88), "patient": patient,
    }
    return d.select("job_id", "status", (F.size("_all") - F.size(named)).alias("n_malformed"), *[c.cast(ENTITIES[k]).alias(k) for k, c in found.items()])


def output_counts(typed: DataFrame) -> DataFrame:
    """Notes and malformed drugs by status."""
    return typed.groupBy("status").agg(F.count("*").alias("notes"), F.sum("n_malformed").alias("malformed"))


@lru_cache(200_000)
def likeness(said: str, name: str) -> float:
    """Gestalt similarity of a candidate's and a found name."""
    return SequenceMatcher(None, said, name).ratio()


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def _likenesses(said: pd.Series, names: pd.Series) -> pd.Series:
    """A row for each candidate name with its similarity to each other name of the note; no built-in has it."""
    return pd.Series([[[likeness(a, b) for b in ns] for a in s] for s, ns in zip(said, names)])


def vital_kind(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\d+\s*(?:by|/|over|of)\s*\d+|^BP\b"), "bp").when(text.rlike("(?i)degree|temp|fahrenheit|°"), "temp").when(text.rlike("(?i)spo2|o2|%|oxygen"), "spo2").otherwise("other")


def _filled(vitals: Column) -> dict[str, Column]:
    """Which kinds of vitals were found: one text may count for several."""
    rules = {"bp": r"\d+\s*(?:by|/|over|of)\s*\d+", "temp": "(?i)degree|temp|fahrenheit|°", "spo2": "(?i)spo2|o2|%|oxygen"}
    having = lambda rule: F.exists(vitals, lambda x: x["text"].rlike(rule))
    return {k: having(rule) for k, rule in rules.items()}


def _empty(x: Column, field: str) -> Column:
    return F.coalesce(x == (0.0 if field == "dose" else ""), F.lit(True))


def _drug_fold(found: Column, new: Column, like: Column, image: bool, text: Column) -> Column:
    """Candidates in order: each goes to the drug whose name is most like its own, the first of equal ones, and fills what is empty there; one that is like none is added."""

    def fill(d: Column, t: Column) -> Column:
        out = d
        for k in ("dose", "unit", "frequency", "duration"):
            use = _empty(d[k], k) & ~_empty(t[k], k)
            if image:
                use = use & (_numbers_in(t[k].cast("string"), text) if k in ("dose", "unit") else _in(t[k], text))
                out = out.withField("note", F.when(use, F.trim(F.concat(F.coalesce(out["note"], F.lit("")), F.lit(" llm-image-gapfill")))).otherwise(out["note"]))
            out = out.withField(k, F.when(use, t[k]).otherwise(d[k]))
        return out

    def step(acc: Column, c: Column) -> Column:
        t = c["d"]
        score = lambda s: F.get(F.get(like, c["k"]), s["i"])
        best = F.array_min(F.transform(acc, lambda s, p: F.struct((-score(s)).alias("s"), p.alias("p"))))
        hit = F.coalesce(best["s"] <= -ALIKE, F.lit(False))
        more = " llm-image-gapfill - verify spelling" if image else " llm-primary"
        own = t.withField("note", F.trim(F.concat(F.coalesce(t["note"], F.lit("")), F.lit(more))))
        own = own.withField("color", F.lit("YELLOW")) if image else own
        allowed = F.coalesce(t["name"] != "", F.lit(False)) & (_in(t["name"], text) if image else F.lit(True))
        filled = F.transform(acc, lambda s, p: F.when(p == best["p"], s.withField("d", fill(s["d"], t))).otherwise(s))
        added = F.concat(acc, F.array(F.struct((F.size(found) + c["k"]).alias("i"), own.alias("d"))))
        return F.when(~allowed & F.lit(image), acc).when(hit, filled).when(allowed, added).otherwise(acc)

    state = F.transform(found, lambda d, i: F.struct(i.alias("i"), d.alias("d")))
    turns = F.transform(new, lambda d, k: F.struct(k.alias("k"), d.alias("d")))
    return F.aggregate(turns, state, step, lambda acc: F.transform(acc, lambda s: s["d"]))


def merge_candidates(found: DataFrame, candidates: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Candidates fill the gaps of what was found; both have job_id and ENTITIES. What was found always wins.

    A candidate drug goes to the found drug whose name is most like its own
    (Gestalt similarity of ALIKE or more) and fills its empty dose, unit,
    frequency and duration; else it is added. A diagnosis or follow-up is taken
    where none was found, symptoms and allergies with other texts are added,
    vitals only of kinds that were not found. With texts (job_id, text) the
    image rules hold: what a candidate gives must occur in the text, a dose by
    its decimal print (500.0) and a unit by its numbers, so a unit is never
    filled. Notes without candidates stay as they are; notes that are only
    among the candidates are left out. Null arrays are empty.
    """
    image = texts is not None
    side = lambda d, p: d.select("job_id", *[F.coalesce(F.col(k), F.array().cast(t)).alias(f"{p}_{k}") if t.startswith("array") else F.col(k).alias(f"{p}_{k}") for k, t in ENTITIES.items()])
    x = side(found, "f").join(side(candidates, "c"), "job_id", "left")
    x = x.join(texts.select("job_id", F.col("text").alias("_text")), "job_id", "left") if image else x
    f, c = ({k: F.col(f"{p}_{k}") for k in ENTITIES} for p in "fc")
    c |= {k: F.coalesce(c[k], F.array().cast(t)) for k, t in ENTITIES.items() if t.startswith("array")}
    text = F.coalesce("_text", F.lit("")) if image else F.lit("")
    lowered = lambda a: F.transform(a, lambda d: F.lower(F.coalesce(d["name"], F.lit(""))))
    x = x.withColumn("_like", _likenesses(lowered(c["drugs"]), F.concat(lowered(f["drugs"]), lowered(c["drugs"]))))
    shown = (lambda t: _in(t, text)) if image else (lambda t: F.lit(True))
    texts_of = lambda a: F.transform(a, lambda t: F.lower(t["text"]))

    def added(k: str) -> Column:
        new = F.filter(c[k], lambda t: ~F.array_contains(texts_of(f[k]), F.lower(t["text"])) & shown(t["text"]))
        if image:  # of equal texts the first
            new = F.filter(new, lambda t, i: F.array_position(texts_of(new), F.lower(t["text"])) == i + 1)
        return F.concat(f[k], new)

    has = _filled(f["vitals"])
    taken = lambda t: F.coalesce(F.element_at(F.create_map(*[y for k, h in has.items() for y in (F.lit(k), h)]), vital_kind(t["text"])), F.lit(False))
    vitals = F.filter(c["vitals"], lambda t: ~taken(t) & ~F.array_contains(texts_of(f["vitals"]), F.lower(t["text"])) & shown(t["text"]))
    kinds = {"sys": "bp", "dia": "bp", "temp": "temp", "spo2": "spo2"}
    new = {k: F.when(~has[kind], c["structured"][k]) for k, kind in kinds.items()}
    if image:
        new = {k: F.when(_numbers_in(n, text), n) for k, n in new.items()}
        structured = F.struct(*[F.coalesce(n, f["structured"][k]).alias(k) for k, n in new.items()])
    else:  # candidates replace the whole record if any is left
        structured = F.when(F.coalesce(*new.values()).isNotNull(), F.struct(*[n.alias(k) for k, n in new.items()])).otherwise(f["structured"])
    take = lambda k: F.when(F.coalesce(f[k]["text"], F.lit("")) == "", F.when(shown(c[k]["text"]), c[k])).otherwise(f[k])
    merged = {
        "drugs": _drug_fold(f["drugs"], c["drugs"], F.col("_like"), image, text), "vitals": F.concat(f["vitals"], vitals), "structured": structured,
        "symptoms": added("symptoms"), "allergies": added("allergies"), "diagnosis": take("diagnosis"), "followup": take("followup"), "patient": take("patient") if image else f["patient"],
    }
    return x.select("job_id", *[m.cast(ENTITIES[k]).alias(k) for k, m in merged.items()])


def merge_tidied(found: DataFrame, tidied: DataFrame) -> DataFrame:
    """Found drugs with the gaps that tidied drugs of the same name fill, then tidied drugs of other names: job_id, drugs, n_dropped.

    Both have job_id and drugs; n_dropped counts tidied ones without a name.
    Of found drugs with one name the last stays, in the place of the first; a
    drug that was tidied keeps a known unit only.
    """
    x = found.select("job_id", F.coalesce("drugs", F.array().cast(ENTITIES["drugs"])).alias("f")).join(tidied.select("job_id", F.coalesce("drugs", F.array().cast(ENTITIES["drugs"])).alias("t")), "job_id", "left")
    x = x.withColumn("t", F.coalesce("t", F.array().cast(ENTITIES["drugs"])))
    low = lambda d: F.lower(F.coalesce(d["name"], F.lit("")))
    start = F.filter("f", lambda d: low(d) != "")

    def put(acc: Column, d: Column) -> Column:
        same = F.exists(acc, lambda a: low(a) == low(d))
        return F.when(same, F.transform(acc, lambda a: F.when(low(a) == low(d), d).otherwise(a))).otherwise(F.concat(acc, F.array(d)))

    def mend(d: Column, t: Column) -> Column:
        for k in ("dose", "unit", "frequency", "duration", "confidence"):
            blank = _empty(d[k], "dose" if k == "confidence" else k)
            d = d.withField(k, F.when(blank & ~_empty(t[k], "dose" if k == "confidence" else k), t[k]).otherwise(d[k]))
        return d.withField("unit", F.when(d["unit"].isin(*UNITS), d["unit"]))

    def tidy(acc: Column, t: Column) -> Column:
        base = t.withField("confidence", F.lit(0.85)).withField("color", F.lit("YELLOW")).withField("proof", F.lit("")).withField("note", F.lit(None).cast("string"))
        same = F.exists(acc, lambda a: low(a) == low(t))
        return F.when(same, F.transform(acc, lambda a: F.when(low(a) == low(t), mend(a, t)).otherwise(a))).otherwise(F.concat(acc, F.array(mend(base, t))))

    none = F.array().cast(ENTITIES["drugs"])
    named = F.filter("t", lambda d: low(d) != "")
    return x.select("job_id", F.aggregate(named, F.aggregate(start, none, put), tidy).alias("drugs"), (F.size("t") - F.size(named)).alias("n_dropped"))
