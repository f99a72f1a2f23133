"""Dictation made from the orders table by one expression that Spark and DuckDB both run.

The tables hold no clinical text, so notes are built from o_orderkey (the job
id, unique) and o_custkey, together with the values that they state.
"""

from __future__ import annotations


def pick(value: str, options: list[str]) -> str:
    rows = " ".join(f"when {i} then '{o}'" for i, o in enumerate(options))
    return f"(case ({value}) % {len(options)} {rows} end)"


K, C = "o_orderkey", "coalesce(o_custkey, 0)"
DRUG = pick(f"{K} + {C}", ["paracetamol", "azithral", "amoxicillin", "brufen", "insulin", "levothyroxine", "metformin", "sunshine", "asitromaisin", "warfarin", "paracitamol", "metfornin", "ibuprophen"])
DRUG2 = pick(f"{K} * 3", ["cetirizine", "omeprazole", "dolo"])
UNIT = pick(f"{K}", ["mg", "milligrams", "mcg", "mg", "mg"])
FREQ = pick(f"{C}", ["once daily", "twice daily", "TDS", "twice a day", "every 8 hours", ""])
PARTS = [
    pick(K, ["Patient ko fever hai, bukhar 101 degree. ", "Khansi hai, cough for 5 days. ", "Patient has headache and sore throat. ", "Severe chest pain and cold. ", "Thank you thank you thank you. ", ""]),
    f"(case when {C} % 3 = 0 then concat('BP ', cast(100 + {K} % 60 as varchar(9)), ' by ', cast(60 + {C} % 40 as varchar(9)), '. ') when {C} % 3 = 1 then concat('Blood pressure is around ', cast(100 + {K} % 60 as varchar(9)), ' of ', cast(60 + {C} % 40 as varchar(9)), '. ') else 'BPA 130 by AC. ' end)",
    f"concat('Give ', {DRUG}, ' ', cast(({K} % 20) * 50 as varchar(9)), {UNIT}, ' ', {FREQ}, ' for ', cast({C} % 9 + 1 as varchar(9)), ' days', case when {K} % 4 = 0 then concat(' along with ', {DRUG2}, ' 10 mg BD') else '' end, '. ')",
    pick(f"{K} + 1", ["No penicillin allergy. ", "Patient denies chest pain. ", "I do not have any known allergy to a moxasillin. ", "No allergy. ", "", "Allergy to peanuts. "]),
    pick(f"{C} + 2", ["S-P-O-two 97% on rhoomair. ", "SpO2 95%. ", "Temp is 100.4 degrees F. ", "pulse 88. ", ""]),
    pick(f"{K} + {C} * 2", ["Diagnosis: viral fever. ", "Diagnosis - acute bronchitis. ", ""]),
    pick(f"{K} + 3", ["Temp one hundred one degrees. ", "Advise rest for five days. ", "", "Oxygen saturation ninety-eight percent. ", "Take dolo six hundred fifty mg. "]),
    pick(f"{K} + {C}", ["बुखार aur खांसी hai. ", "", "Dose 500 मिलीग्राम. ", "", ""]),
    pick(f"{C}", ["Review after 5 days.", "Come back if worse.", "", "Follow-up in one week."]),
]
NOTES_SQL = f"select {K} as job_id, trim(concat({', '.join(PARTS)})) as text, {DRUG} as said, cast(({K} % 20) * 50 as double) as said_dose, cast({C} % 9 + 1 as int) as said_days, {pick(K, ['en', 'hi', 'ta'])} as lang from orders"

ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
#: Spoken numbers and their values: a hundred form, a tens form and the short hundred form.
SPOKEN_SQL = (
    f"select {K} as job_id, concat('give ', {pick(K, ONES)}, case when {K} % 2 = 0 then ' hundred ' else ' ' end, {pick(C, TENS)}, ' mg') as text, "
    f"cast(({K} % 9 + 1) * 100 + ({C} % 8 + 2) * 10 as bigint) as said from orders"
)
#: What a model might print about a note (whole, empty, broken, or without the keys), and what was found in it.
OUTPUTS_SQL = (
    "select job_id, text, case when job_id % 13 = 0 then 'no answer' when job_id % 17 = 0 then '{\"drugs\": [}' when job_id % 19 = 0 then 'so: {\"note\": 1}' else concat('so: {\"drugs\": [{\"name\": \"', substr(said, 1, length(said) - 1), "
    "'\", \"dose\": ', case when job_id % 6 = 0 then '\"some\"' else cast(job_id % 20 * 50 as varchar(9)) end, ', \"unit\": \"', case when job_id % 4 = 0 then 'spoon' else 'mg' end, '\", \"frequency\": \"twice daily\", \"duration\": \"3 days\", \"source_sentence\": \"', "
    "case when job_id % 3 = 0 then substr(text, 1, 50) when job_id % 3 = 1 then 'never said' else '' end, '\"}, {\"name\": \"newdrug\", \"dose\": \"ten\"}, 5, {\"dose\": 1}], \"vitals\": {\"sys\": \"', cast(100 + job_id % 60 as varchar(9)), '\", \"dia\": ', cast(60 + said_days as varchar(9)), "
    "', \"temp\": \"101 degree\"}, \"symptoms_denied\": [\"cough\"], \"diagnosis\": {\"text\": \"flu\"}} ok') end as raw, "
    "said, case when job_id % 2 = 0 then said_dose end as had_dose, case when job_id % 3 = 0 then 'mg' end as had_unit, case when job_id % 7 = 0 then 'daily' else '' end as had_frequency, job_id % 5 > 0 as had, "
    f"case when job_id % 2 = 0 then 'BP 120 by 80' else 'pulse 80' end as vital, case when job_id % 9 = 0 then 'fever' end as dx from ({NOTES_SQL}) n"
)


def outputs(spark, sf_dir: str):
    """A model's output on each note: job_id, text, raw, and had_ columns, vital and dx of what was found without it."""
    return _run(spark, sf_dir, OUTPUTS_SQL)


def notes(spark, sf_dir: str):
    """Synthetic notes: job_id, text, said, said_dose, said_days, lang."""
    return _run(spark, sf_dir, NOTES_SQL)


def spoken(spark, sf_dir: str):
    return _run(spark, sf_dir, SPOKEN_SQL)


def _run(spark, sf_dir: str, sql: str):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sql = sql.replace("{", "{{").replace("}", "}}")  # what is left in braces names a frame
    return spark.sql(sql.replace(" from orders", " from {orders}"), orders=orders)
