"""Note fields: values with a GREEN, YELLOW or RED state, from the extracted long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import patterns as P
from .extract import exploded

# Most characters and overflow of each field.
GEOMETRY = [
    ("patient_name", 24, "truncate"), ("cc_blank", 60, "wrap"), ("hpi_inline_1", 22, "truncate"), ("hpi_inline_2", 22, "truncate"),
    ("drug_0_name", 20, "wrap"), ("drug_0_dose", 12, "shrink"), ("drug_0_unit", 8, "truncate"), ("drug_0_freq", 18, "truncate"), ("drug_0_duration", 12, "truncate"),
    ("drug_1_name", 20, "wrap"), ("drug_1_dose", 12, "shrink"), ("drug_1_unit", 8, "truncate"), ("drug_1_freq", 18, "truncate"), ("drug_1_duration", 12, "truncate"),
    ("vitals_bp_sys", 3, "truncate"), ("vitals_bp_dia", 3, "truncate"), ("vitals_temp", 24, "truncate"), ("vitals_spo2", 10, "truncate"),
    ("allergy_line", 60, "truncate"), ("dx_text", 50, "truncate"), ("dx_code_box", 22, "truncate"), ("fu_text", 60, "truncate"), ("date_box", 10, "truncate"), ("sign_line", 30, "truncate"),
]


def fit(text: Column, most: Column, overflow: Column) -> Column:
    """Text cut to its box: longer ones end in an ellipsis unless they wrap."""
    return F.when((F.length(text) > most) & overflow.isin("truncate", "shrink"), F.concat(F.substring(text, F.lit(1), most - 1), F.lit("…"))).otherwise(text)


def chief_complaint(symptoms: DataFrame) -> DataFrame:
    """(job_id, complaint, color): the first symptom that is not negated, by its canonical name."""
    canon = F.create_map(*[F.lit(x) for kv in L.SYMPTOM_CANON.items() for x in kv])
    s = symptoms.groupBy("job_id").agg(F.min(F.when(~F.col("negated"), F.struct("sent", "ord", "symptom"))).alias("f"))
    text = F.coalesce(canon[F.col("f.symptom")], F.col("f.symptom"))
    return s.select("job_id", F.coalesce(text, F.lit("NIL — not heard")).alias("complaint"), F.when(text.isNull(), "RED").otherwise("YELLOW").alias("color"))


def vitals_boxes(vitals: DataFrame) -> DataFrame:
    """(job_id, sys, dia, temp, spo2): of each kind the last vital of the note, NIL where none."""
    def last(kind: str) -> Column:
        return F.max(F.when(F.col("kind") == kind, F.struct("sent", "ord", "vital")))["vital"]

    v = vitals.groupBy("job_id").agg(last("bp").alias("bp"), last("temp").alias("t"), last("spo2").alias("o"))
    return v.select("job_id", *_boxes(F.col("bp"), F.col("t"), F.col("o")))


def _boxes(bp: Column, t: Column, o: Column) -> list[Column]:
    """sys, dia, temp and spo2 of a pressure, a temperature and a saturation."""
    nil = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("NIL"))
    temp = F.substring(F.coalesce(F.nullif(F.regexp_extract(t, f"(?i){P.TEMP}", 0), F.lit("")), t), 1, 20)
    spo2 = F.substring(F.coalesce(F.nullif(F.regexp_extract(o, r"\d{2,3}(?:\.\d{1,2})?\s*%?", 0), F.lit("")), o), 1, 20)
    return [nil(F.regexp_extract(bp, P.PAIR, 1)).alias("sys"), nil(F.regexp_extract(bp, P.PAIR, 3)).alias("dia"), nil(temp).alias("temp"), nil(spo2).alias("spo2")]


def note_boxes(rows: DataFrame) -> DataFrame:
    """Rows of extract.noted() with the columns of vitals_boxes; a note without vitals has NIL in each."""
    last = lambda kind: F.try_element_at(F.filter("vitals", lambda v: v["kind"] == kind), F.lit(-1))["vital"]
    x = rows.withColumns({"_bp": last("bp"), "_t": last("temp"), "_o": last("spo2")})
    return x.select("*", *_boxes(F.col("_bp"), F.col("_t"), F.col("_o"))).drop("_bp", "_t", "_o")


def allergy_line(notes: DataFrame, allergies: DataFrame) -> DataFrame:
    """(job_id, active, denied): allergens joined by '; ' in note order, negated ones apart."""
    pick_ = lambda flag: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("negated") == flag, F.struct("sent", "allergen")))), lambda x: x["allergen"]), "; ")
    a = allergies.groupBy("job_id").agg(pick_(False).alias("active"), pick_(True).alias("denied"))
    return notes.select("job_id").join(a, "job_id", "left").select("job_id", F.coalesce(F.nullif("active", F.lit("")), F.lit("NIL — none extracted")).alias("active"), F.coalesce("denied", F.lit("")).alias("denied"))


def dose_text(dose: Column) -> Column:
    """Whole doses without a fraction; null and 0 are NIL."""
    return F.when(F.coalesce(dose, F.lit(0.0)) == 0, "NIL").when(dose == F.floor(dose), dose.cast("bigint").cast("string")).otherwise(dose.cast("string"))


def _first_drugs(most: int = 2) -> Column:
    """The first drugs of a note, of extract.noted(); null where there is none."""
    place = lambda d: F.struct(*[d[c].alias(c) for c in ("sent", "clause", "ord", "name", "dose", "unit", "frequency", "duration", "color")])
    return F.when(F.size("drugs") > 0, F.transform(F.slice("drugs", 1, most), place))


def _cells(rows: Column) -> Column:
    """The cells (key, value, color) of a note's drug rows; of the first where there is none."""
    def row(d: Column, i: Column) -> Column:
        cells = [("name", F.coalesce(d["name"], F.lit("NIL — no drug heard"))), ("dose", dose_text(d["dose"])), ("unit", F.coalesce(d["unit"], F.lit("NIL"))), ("freq", F.coalesce(F.nullif(d["frequency"], F.lit("")), F.lit("NIL"))), ("duration", F.coalesce(F.nullif(d["duration"], F.lit("")), F.lit("NIL")))]
        color = lambda v: F.when(v.startswith("NIL"), "RED").otherwise(F.coalesce(d["color"], F.lit("RED")))
        return F.array(*[F.struct(F.concat(F.lit("drug_"), i.cast("string"), F.lit(f"_{k}")).alias("key"), v.alias("value"), color(v).alias("color")) for k, v in cells])

    return F.flatten(F.transform(F.coalesce(rows, F.array(F.lit(None).cast("struct<sent:int,clause:int,ord:int,name:string,dose:double,unit:string,frequency:string,duration:string,color:string>"))), row))


def drug_cells(rows: DataFrame) -> DataFrame:
    """(job_id, key, value, color) of the two drug rows of extract.noted(); the first row is NIL and RED where no drug was heard, later drugs have no box."""
    d = rows.select("job_id", _first_drugs().alias("rows"))
    return exploded(d.select("job_id", _cells(F.col("rows")).alias("c")), "c", "at", "c").select("job_id", "c.*")


def all_slots(rows: DataFrame, note_date: str, dealt: bool = False) -> DataFrame:
    """(job_id, key, text, color, truncated): every field of every note of extract.noted(), cut to its box; dealt by note for what regroups them, one row a note."""
    x = slot_arrays(rows, note_date)
    return exploded(x.repartition("job_id") if dealt else x, "slots", "at", "s").select("job_id", "s.*")


def slot_arrays(rows: DataFrame, note_date: str) -> DataFrame:
    """(job_id, slots): all_slots with a note's fields as an array of its row."""
    canon = F.create_map(*[F.lit(x) for kv in L.SYMPTOM_CANON.items() for x in kv])
    first = F.get(F.filter("symptoms", lambda s: ~s["negated"]), F.lit(0))["symptom"]
    active = F.array_sort(F.transform(F.filter("allergies", lambda a: ~a["negated"]), lambda a: F.struct(a["sent"].alias("sent"), a["allergen"].alias("allergen"))))
    x = note_boxes(rows).select("job_id", "sys", "dia", "temp", "spo2", "diagnosis", "follow_up", first.alias("complaint"), F.nullif(F.array_join(active["allergen"], "; "), F.lit("")).alias("active"), _first_drugs().alias("rows"))
    x = x.withColumn("complaint", F.coalesce(F.try_element_at(canon, F.col("complaint")), F.col("complaint"))).withColumn("cc_color", F.when(F.col("complaint").isNotNull(), "YELLOW"))
    nil = F.lit("NIL")
    one = lambda key, value, color: F.struct(F.lit(key).alias("key"), value.alias("value"), color.alias("color"))
    box = lambda c: F.coalesce(F.col(c), nil)
    green, red, yellow = map(F.lit, ("GREEN", "RED", "YELLOW"))
    active = F.coalesce("active", F.lit("NIL — none extracted"))
    single = F.array(
        one("cc_blank", F.coalesce("complaint", F.lit("NIL — not heard")), F.coalesce("cc_color", red)),
        *[one(f"vitals_{k}", box(c), F.when(box(c) == "NIL", red).otherwise(yellow)) for k, c in (("bp_sys", "sys"), ("bp_dia", "dia"), ("temp", "temp"), ("spo2", "spo2"))],
        one("allergy_line", active, F.when(active.startswith("NIL"), green).otherwise(yellow)),
        one("dx_text", F.coalesce("diagnosis", F.lit("NIL — [DR CONFIRM]")), F.when(F.col("diagnosis").isNull(), red).otherwise(yellow)),
        one("dx_code_box", nil, red),
        one("fu_text", F.coalesce("follow_up", F.lit("NIL — no follow-up heard")), F.when(F.col("follow_up").isNull(), green).otherwise(yellow)),
        one("date_box", F.lit(note_date), green),
        one("sign_line", F.lit("_" * 16), green),
    )
    most = F.create_map(*[F.lit(y) for k, n, _ in GEOMETRY for y in (k, n)])
    overflow = F.create_map(*[F.lit(y) for k, _, o in GEOMETRY for y in (k, o)])

    def cut(s: Column) -> Column:
        size = F.try_element_at(most, s["key"])
        return F.struct(s["key"].alias("key"), fit(s["value"], size, F.try_element_at(overflow, s["key"])).alias("text"), s["color"].alias("color"), (F.length(s["value"]) > size).alias("truncated"))

    return x.select("job_id", F.transform(F.concat(single, _cells(F.col("rows"))), cut).alias("slots"))


def gate(slots: DataFrame, audit: DataFrame, strict: bool = False) -> DataFrame:
    """(job_id, red, audited, may_verify): a note may be verified with no RED (strict: nor YELLOW) field and an audited edit."""
    bad = F.col("color").isin("RED", "YELLOW") if strict else F.col("color") == "RED"
    s = slots.groupBy("job_id").agg(F.count_if(bad).alias("red"))
    n = audit.groupBy("job_id").agg(F.count("*").alias("audited"))
    return s.join(n, "job_id", "left").select("job_id", "red", F.coalesce("audited", F.lit(0)).alias("audited"), ((F.col("red") == 0) & (F.coalesce("audited", F.lit(0)) > 0)).alias("may_verify"))


def render_html(slots: DataFrame) -> DataFrame:
    """(job_id, html): the fields of a note as an escaped list in key order."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.concat(F.lit('<li class="'), F.lower("color"), F.lit('">'), "key", F.lit(": "), esc(F.col("text")), F.lit("</li>"))
    s = slots.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("key", row.alias("r")))).alias("r"))
    return s.select("job_id", F.concat(F.lit("<ul>"), F.array_join("r.r", ""), F.lit("</ul>")).alias("html"))


def _last_edits(slots: DataFrame, edits: DataFrame) -> tuple[DataFrame, Column]:
    """Slots with the last edit of each field (e), and whether it changes something."""
    last = edits.groupBy("job_id", "key").agg(F.max(F.struct("ts", "value")).alias("e"))
    return slots.join(last, ["job_id", "key"], "left"), F.col("e").isNotNull() & ~F.col("e.value").eqNullSafe(F.col("text"))


def gate_edits(slots: DataFrame, edits: DataFrame, strict: bool = False) -> DataFrame:
    """gate of apply_edits(slots, edits), with the fields read once: an edit that changes something is one audit row and leaves its field GREEN."""
    x, changed = _last_edits(slots, edits)
    bad = F.col("color").isin("RED", "YELLOW") if strict else F.col("color") == "RED"
    s = x.select("job_id", bad.alias("bad"), changed.alias("changed")).groupBy("job_id").agg(F.count_if(F.col("bad") & ~F.col("changed")).alias("red"), F.count_if("changed").alias("audited"))
    return s.select("job_id", "red", "audited", ((F.col("red") == 0) & (F.col("audited") > 0)).alias("may_verify"))


def apply_edits(slots: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slots with the last edit of each field, GREEN; and the audit rows (job_id, key, original, corrected, ts) of edits that change something."""
    x, changed = _last_edits(slots, edits)
    new = x.select("job_id", "key", F.when(changed, F.col("e.value")).otherwise(F.col("text")).alias("text"), F.when(changed, "GREEN").otherwise(F.col("color")).alias("color"))
    return new, x.where(changed).select("job_id", "key", F.col("text").alias("original"), F.col("e.value").alias("corrected"), F.col("e.ts").alias("ts"))
