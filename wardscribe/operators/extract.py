"""From notes to long tables of sentences, drugs, symptoms, vitals, allergies and single findings.

Everything is keyed (job_id, sent) and stays a narrow projection: only explodes
and broadcast dimension joins, and one shuffle where "first wins" needs it.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions import patterns as P
from ..functions.normalize import number_words, once


def exploded(rows: DataFrame, array: str, pos: str, item: str) -> DataFrame:
    """A row for each item of the array, with its position.

    posexplode alone would have the optimizer filter empty arrays before, where
    it computes the whole array a second time, its steps multiplied out.
    """
    keep = [c for c in rows.columns if c != array]
    return rows.select(*keep, F.posexplode_outer(array).alias(pos, item)).where(F.col(pos).isNotNull())


def sentence_array(text: Column, lines: bool = False) -> Column:
    """Text split after . ! ? before white space (lines: and at line breaks)."""
    return F.split(_marked(text, lines), P.MARK)


def _marked(text: Column, lines: bool) -> Column:
    t = F.regexp_replace(text, r"\s*\n\s*", P.MARK) if lines else text
    return F.regexp_replace(t, P.SENTENCE_END, "$1" + P.MARK)


def sentences(notes: DataFrame, source: str = "audio", numbers: bool = True) -> DataFrame:
    """(job_id, sent, text, raw, negated): text has digits for number words, raw is the proof as dictated."""
    s = exploded(_cut(notes, source, numbers).select("job_id", "s", "digits"), "s", "sent", "s")
    text = F.when(F.col("sent") >= 0, F.get("digits", F.col("sent")))  # bare, a filter of it would have the optimizer ask of the digits, made a second time, whether they are null
    return s.select("job_id", "sent", text.alias("text"), F.trim("s").alias("raw"), F.coalesce(F.col("s").rlike(P.edged(P.NEGATION)), F.lit(False)).alias("negated"))


def _cut(notes: DataFrame, source: str, numbers: bool) -> DataFrame:
    """(job_id, text, s, digits): the sentences of a note as dictated and with digits for number words, as arrays."""
    gap = r"[ \t]+" if source == "image" else r"\s+"
    joined = F.regexp_replace("text", rf"([A-Za-z]+),{gap}((?:for\s+)?\d+\s*(?:mg|mcg|g|ml|U)\b)", "$1 $2")
    joined = F.when(F.contains("text", F.lit(",")), joined).otherwise(F.col("text"))
    # a run of number words never reaches over a sentence's end and holds no word of a negation: ends are marked once,
    # and the digits of all sentences, beside each, are made only where a query asks for text
    x = notes.select("job_id", "text", _marked(joined, source == "image").alias("m"))
    return x.select("job_id", "text", F.split("m", P.MARK).alias("s"), F.split(number_words("m") if numbers else F.col("m"), P.MARK).alias("digits"))


def noted(notes: DataFrame, source: str = "audio", numbers: bool = True, fuzzy: bool = True) -> DataFrame:
    """What the long tables hold, as arrays of the note's own row: nothing is regrouped, and sentences are cut once for all.

    (job_id, text, raws, symptoms, vitals, allergies, drugs, diagnosis,
    follow_up); arrays are in the order of the note, of the columns of symptoms(),
    vitals(), allergies() (with sent) and resolve_drugs(), job_id left out. Null
    text gives null arrays. What a query does not read is not computed.
    """
    x = _cut(notes, source, numbers)
    low = F.lower("text")
    has = lambda c, terms: reduce(or_, [F.contains(c, F.lit(a)) for a in terms])
    negated = F.transform("s", lambda s: F.coalesce(s.rlike(P.edged(P.NEGATION)), F.lit(False)))
    x = x.select("job_id", "text", F.transform("s", lambda s: F.trim(s)).alias("raws"), negated.alias("no"), "digits")

    def symptoms_of(s: Column, sent: Column) -> Column:
        kept = once(F.filter(F.array(*map(F.lit, L.SYMPTOMS)), lambda a: F.contains(s, a)), _outer)
        denied = lambda a: F.get("no", sent) & a.isin(*L.DENIABLE)
        return F.transform(kept, lambda a, k: F.struct(sent.alias("sent"), k.alias("ord"), a.alias("symptom"), denied(a).alias("negated")))

    said = F.flatten(F.array_compact(F.transform("raws", lambda s, i: once(F.lower(s), lambda v: F.when(has(v, L.SYMPTOMS), symptoms_of(v, i))))))

    def vitals_of(t: Column, sent: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(P.VITALS), F.lit(0)), lambda v, k: F.struct(sent.alias("sent"), k.alias("ord"), v.alias("vital"), _kind(v).alias("kind")))
        return F.when(t.rlike("[0-9]{2}"), found)

    def allergens_of(t: Column, sent: Column) -> Column:
        every = F.concat(*_allergens(t))
        here = F.get("no", sent) & has(F.lower(F.get("raws", sent)), ("allerg", *L.ALLERGENS))
        return F.when(here, F.transform(every, lambda e: F.struct(sent.alias("sent"), e["a"].alias("allergen"), F.lit(True).alias("negated"), e["c"].alias("confidence"))))

    every = F.flatten(F.array_compact(F.transform("digits", allergens_of)))
    first = once(every, lambda es: once(F.transform(es, lambda e: e["allergen"]), lambda names: F.filter(es, lambda e, i: F.array_position(names, e["allergen"]) == i + 1)))
    none = lambda kind: F.when(F.col("text").isNotNull(), F.array().cast(kind))
    allergic = F.when(has(low, ("allerg", *L.ALLERGENS)), first).otherwise(none("array<struct<sent:int,allergen:string,negated:boolean,confidence:double>>"))

    def drugs_of(t: Column, sent: Column) -> Column:
        of = lambda c, k: F.transform(F.regexp_extract_all(c, F.lit(P.DRUG), F.lit(0)), lambda m, o: once(F.array(*[F.regexp_extract(m, P.DRUG, i) for i in range(1, 7)]), lambda g: mention(g, k, o)))
        mention = lambda g, k, o: F.struct(sent.alias("sent"), k.alias("clause"), o.alias("ord"), *_said(*[F.get(g, F.lit(i)) for i in range(6)]), F.get("raws", sent).alias("raw"), F.get("no", sent).alias("negated"))
        return F.when(t.rlike(P.AMOUNT), F.flatten(F.array_compact(F.transform(F.split(t, P.CLAUSE), lambda c, k: F.when(c.rlike(P.AMOUNT), of(c, k))))))

    named = F.flatten(F.array_compact(F.transform("digits", drugs_of)))
    one = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    x = x.select("job_id", "text", "raws", said.alias("symptoms"), F.flatten(F.array_compact(F.transform("digits", vitals_of))).alias("vitals"), allergic.alias("allergies"), named.alias("m"),
                 one(P.DIAGNOSIS).alias("diagnosis"), one(P.FOLLOW_UP).alias("follow_up"))
    forms = F.create_map(*[F.lit(v) for d in L.DRUGS for a in (d[0], *d[1]) for v in (a, d[0])])
    known = F.transform("m", lambda m: F.try_element_at(forms, m["said"]))
    x = x.withColumn("known", known)
    unknown = F.zip_with("m", "known", lambda m, c: F.when(c.isNull(), m["said"]))
    x = x.withColumn("g", guessed_all(unknown) if fuzzy else F.lit(None).cast("array<struct<guess:string,score:double>>"))

    def resolved(m: Column, i: Column) -> Column:
        canonical, guess = F.get("known", i), F.get("g", i)
        cells = _resolved(canonical, guess["guess"], guess["score"], m["said"], m["dose"], m["unit"])
        keep = F.coalesce(canonical, guess["guess"]).isNotNull() & ~(m["negated"] & m["said"].isin(*L.ALLERGENS))
        head = [m[c].alias(c) for c in ("sent", "clause", "ord")]
        return F.when(keep, F.struct(*head, cells[0], *[m[c].alias(c) for c in ("dose", "unit", "frequency", "duration")], *cells[1:], m["raw"].alias("raw"), m["negated"].alias("negated")))

    return x.select("job_id", "text", "raws", "symptoms", "vitals", "allergies", F.array_compact(F.transform("m", resolved)).alias("drugs"), "diagnosis", "follow_up")


def rows_of(rows: DataFrame, array: str) -> DataFrame:
    """The long table of an array of noted()."""
    x = exploded(rows.select("job_id", array), array, "_at", "_x")
    return x.select("job_id", "_x.*")


def drug_mentions(sents: DataFrame) -> DataFrame:
    """(job_id, sent, clause, ord, said, dose, unit, frequency, duration, raw, negated) before name resolution."""
    numbered = sents.where(F.col("text").rlike(P.AMOUNT))
    c = exploded(numbered.select("job_id", "sent", "raw", "negated", F.split("text", P.CLAUSE).alias("c")), "c", "clause", "c")
    # the pattern searches a clause once; its groups are read from the short match
    m = c.where(F.col("c").rlike(P.AMOUNT)).select("job_id", "sent", "clause", "raw", "negated", F.regexp_extract_all("c", F.lit(P.DRUG), F.lit(0)).alias("m"))
    m = exploded(m, "m", "ord", "m").select("job_id", "sent", "clause", "raw", "negated", "ord", F.struct(*[F.regexp_extract("m", P.DRUG, i).alias(f"g{i}") for i in range(1, 7)]).alias("g"))
    return m.select("job_id", "sent", "clause", "ord", *_said(*[F.col(f"g.g{i}") for i in range(1, 7)]), "raw", "negated")


def _said(name: Column, dose: Column, unit: Column, frequency: Column, number: Column, period: Column) -> list[Column]:
    """said, dose, unit, frequency and duration of the groups of a match of DRUG."""
    units = F.create_map(*[F.lit(x) for kv in L.UNITS.items() for x in kv])
    u = F.when(F.trim(unit) != "", F.trim(unit))
    duration = F.when(number != "", F.concat_ws(" ", number, period)).otherwise("")
    return [F.lower(name).alias("said"), dose.try_cast("double").alias("dose"), F.coalesce(F.try_element_at(units, F.lower(u)), u).alias("unit"), F.trim(frequency).alias("frequency"), duration.alias("duration")]


@lru_cache(100_000)
def best_name(said: str) -> tuple[str, float] | None:
    """The canonical name of the dictionary form most like a word and their Gestalt similarity: 0.60 or more (0.55 from 8 letters); ties by name."""
    score, name = min((-SequenceMatcher(None, said, form).ratio(), d[0]) for d in L.DRUGS for form in (d[0], *d[1]))
    return (name, -score) if -score >= (0.55 if len(said) >= 8 else 0.6) else None


@F.pandas_udf(T.StructType().add("guess", "string").add("score", "double"))
def guessed(said: pd.Series) -> pd.DataFrame:
    """best_name of words that are not null; no built-in has the similarity. A worker looks a word up once."""
    return pd.DataFrame([(best_name(x) or (None, None)) if x is not None else (None, None) for x in said], columns=["guess", "score"])


@F.pandas_udf(T.ArrayType(T.StructType().add("guess", "string").add("score", "double")))
def guessed_all(said: pd.Series) -> pd.Series:
    """guessed() for arrays of words."""
    return said.map(lambda words: None if words is None else [None if x is None else dict(zip(("guess", "score"), best_name(x) or (None, None))) for x in words])


def _resolved(canonical: Column, guess: Column, score: Column, said: Column, dose: Column, unit: Column) -> list[Column]:
    """name, confidence, color and note."""
    unsure, whole = canonical.isNull(), (F.coalesce(dose, F.lit(0.0)) != 0) & unit.isNotNull()
    return [F.coalesce(canonical, guess).alias("name"), F.when(unsure, 0.88).when(whole, 0.96).otherwise(0.70).alias("confidence"), F.when(unsure, "YELLOW").when(whole, "GREEN").otherwise("RED").alias("color"),
            F.when(unsure, F.concat(F.lit("fuzzy "), said, F.lit("->"), guess, F.lit(" ("), F.format_number(score, 2), F.lit(")"))).alias("note")]


def resolve_drugs(mentions: DataFrame, aliases: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds name, confidence, color, note; unknown names go, negated allergens with a dose move to allergies()."""
    m = mentions.join(F.broadcast(aliases), F.col("said") == F.col("alias"), "left")
    if fuzzy:
        m = m.withColumn("g", guessed(F.when(F.col("canonical").isNull(), F.col("said")))).withColumns({"guess": F.col("g.guess"), "score": F.col("g.score")})
    else:
        m = m.withColumn("guess", F.lit(None).cast("string")).withColumn("score", F.lit(None).cast("double"))
    m = m.where("coalesce(canonical, guess) is not null").where(~(F.col("negated") & F.col("said").isin(*L.ALLERGENS)))
    name, *rest = _resolved(*map(F.col, ("canonical", "guess", "score", "said", "dose", "unit")))
    return m.select("job_id", "sent", "clause", "ord", name, "dose", "unit", "frequency", "duration", *rest, "raw", "negated")


def _outer(hits: Column) -> Column:
    """Of the terms found, those not inside a longer one that comes before."""
    return F.filter(hits, lambda s: ~F.exists(hits, lambda m: (m != s) & F.contains(m, s) & (F.array_position(hits, m) < F.array_position(hits, s))))


def symptoms(sents: DataFrame) -> DataFrame:
    """(job_id, sent, ord, symptom, negated, confidence, color): once a sentence, not inside a longer term found before."""
    found = F.filter(F.array(*map(F.lit, L.SYMPTOMS)), lambda s: F.contains("low", s))
    kept = _outer(F.col("hits"))
    some = reduce(or_, [F.contains(F.lower("raw"), F.lit(t)) for t in L.SYMPTOMS])  # most sentences have none; no term holds a number word
    x = sents.where(some).withColumn("low", F.lower("raw")).withColumn("hits", found)
    x = exploded(x.select("job_id", "sent", "raw", "negated", kept.alias("kept")), "kept", "ord", "symptom")
    neg = F.col("negated") & F.col("symptom").isin(*L.DENIABLE)
    return x.select("job_id", "sent", "ord", "symptom", neg.alias("negated"), F.when(neg, 0.91).otherwise(0.9).alias("confidence"), F.when(neg, "GREEN").otherwise("YELLOW").alias("color"), "raw")


def vitals(sents: DataFrame) -> DataFrame:
    """(job_id, sent, ord, vital, kind): leftmost matches of one alternation, so overlaps resolve as they are read."""
    v = sents.where(F.col("text").rlike("[0-9]{2}")).select("job_id", "sent", F.regexp_extract_all("text", F.lit(P.VITALS), F.lit(0)).alias("v"), "raw")  # each alternative has two digits
    v = exploded(v, "v", "ord", "vital")
    return v.withColumn("kind", _kind(F.col("vital")))


def _kind(vital: Column) -> Column:
    return F.when(vital.rlike(P.PAIR), "bp").when(vital.rlike("(?i)degree|temp|fahrenheit|°"), "temp").when(vital.rlike("(?i)spo2|o2|%|oxygen"), "spo2").otherwise("other")


def _allergens(text: Column) -> tuple[Column, Column]:
    """Named allergens of a sentence and those of 'allergy to X', as arrays of a (allergen) and c (confidence)."""
    as_ = lambda sure: lambda a: F.struct(F.lower(a).alias("a"), F.lit(sure).alias("c"))
    named = F.filter(F.array(*map(F.lit, L.ALLERGENS)), lambda a: F.contains(F.lower(text), a))
    return F.transform(named, as_(0.9)), F.transform(F.regexp_extract_all(text, F.lit(P.ALLERGY), F.lit(1)), as_(0.82))


def allergies(sents: DataFrame, active: bool = False) -> DataFrame:
    """(job_id, allergen, negated, confidence), the first of each allergen in a note.

    Named allergens and 'allergy to X' count in negated sentences; with active,
    'allergy to X' in other sentences is an active allergy.
    """
    named, generic = _allergens(F.col("text"))
    every = F.when(F.col("negated"), F.concat(named, generic))
    if active:
        every = F.when(F.col("negated"), every).otherwise(generic)
    x = (sents if active else sents.where("negated")).where(reduce(or_, [F.contains(F.lower("raw"), F.lit(a)) for a in ("allerg", *L.ALLERGENS)]))
    x = exploded(x.select("job_id", "sent", "negated", every.alias("e")), "e", "ord", "e")
    first = x.groupBy("job_id", F.col("e.a").alias("allergen")).agg(F.min(F.struct("sent", "ord", "negated", F.col("e.c").alias("c"))).alias("f"))
    return first.select("job_id", "allergen", F.col("f.sent").alias("sent"), F.col("f.negated").alias("negated"), F.col("f.c").alias("confidence"))


def findings(notes: DataFrame) -> DataFrame:
    """(job_id, diagnosis, follow_up), null where the note has none: the first of each."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract("text", p, 1)), F.lit(""))
    return notes.select("job_id", one(P.DIAGNOSIS).alias("diagnosis"), one(P.FOLLOW_UP).alias("follow_up"))


def image_labels(lines: DataFrame) -> DataFrame:
    """(job_id, line, patient, temp): labelled patient names and plausible labelled temperatures of scanned lines(job_id, line, text)."""
    name = F.nullif(F.trim(F.regexp_extract("text", P.PATIENT, 1)), F.lit(""))
    words = F.transform(F.split(name, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"^[.'\-]+|[.'\-]+$", "")))
    good = (F.length(F.regexp_replace(name, "[^A-Za-z]", "")) >= 2) & ~F.arrays_overlap(words, F.array(*map(F.lit, P.PATIENT_STOP)))
    value, unit = F.regexp_extract("text", P.LABELLED_TEMP, 1).try_cast("double"), F.upper(F.regexp_extract("text", P.LABELLED_TEMP, 2))
    fits = F.when(unit == "F", value.between(*P.TEMP_RANGE["F"])).when(unit == "C", value.between(*P.TEMP_RANGE["C"])).otherwise(False)
    temp = F.trim(F.regexp_replace(F.regexp_extract("text", P.LABELLED_TEMP, 0), r"\s+", " "))
    temp = F.when(F.length(temp) > 20, F.concat(F.lit("Temp "), F.regexp_extract("text", P.LABELLED_TEMP, 1), F.lit(" "), F.regexp_extract("text", P.LABELLED_TEMP, 2))).otherwise(temp)
    return lines.select("job_id", "line", F.when(good, name).alias("patient"), F.when(fits, temp).alias("temp"))
