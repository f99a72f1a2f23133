"""Evidence gates, gap-fill and judging of candidate values against what the text says."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def proven(proof: Column, source: Column) -> Column:
    """The proof or its first 40 characters occur in the source."""
    return F.coalesce((proof != "") & (F.contains(source, proof) | F.contains(source, F.substring(proof, 1, 40))), F.lit(False))


def digits_supported(value: Column, source: Column) -> Column:
    """The first number of the value occurs in the source as a run of characters; values without a number pass."""
    n = F.regexp_extract(value, r"\d+(?:\.\d+)?", 0)
    return (n == "") | F.contains(source, n)


def value_supported(value: Column, line: Column) -> Column:
    """The line has the value, or all its numbers (one at least)."""
    nums = F.regexp_extract_all(value, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.contains(F.lower(line), F.lower(value)) | ((F.size(nums) > 0) & F.forall(nums, lambda n: F.contains(line, n)))


def gap_fill(found: DataFrame, candidates: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """What was found, its empty values filled from candidates with equal keys, and candidates with keys not found; from: found, filled or candidate."""
    a = found.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_a"))
    b = candidates.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_b"))
    x = a.join(b, keys, "full")
    filled = F.lit(False)
    for v in values:
        filled = filled | (F.col(f"_a_{v}").isNull() & F.col(f"_b_{v}").isNotNull())
    origin = F.when(F.col("_a").isNull(), "candidate").when(filled & F.col("_b").isNotNull(), "filled").otherwise("found")
    return x.select(*keys, *[F.coalesce(f"_a_{v}", f"_b_{v}").alias(v) for v in values], origin.alias("origin"))


def judge(fields: DataFrame, verdicts: DataFrame, lines: DataFrame) -> DataFrame:
    """(job_id, field, status, confidence): MISSING for NIL, PASS where a passing verdict's line has the value, else UNPROVEN."""
    x = fields.join(verdicts, ["job_id", "field"], "left").join(lines, ["job_id", "line_no"], "left")
    missing = F.coalesce(F.col("value"), F.lit("")).rlike("^(NIL.*)?$")
    good = (F.col("verdict") == "PASS") & F.col("line").isNotNull() & value_supported(F.col("value"), F.col("line"))
    status = F.when(missing, "MISSING").when(good, "PASS").otherwise("UNPROVEN")
    conf = F.when(missing, 1.0).when(good, F.least("confidence", F.lit(0.9))).otherwise(F.least(F.coalesce("confidence", F.lit(0.75)), F.lit(0.75)))
    return x.select("job_id", "field", status.alias("status"), conf.alias("confidence"))


def verdict_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("job_id").agg(*[F.count_if(F.col("status") == s.upper()).alias(s) for s in ("pass", "missing", "unproven")])


def valid_candidate(drugs: DataFrame) -> DataFrame:
    """Candidate drugs(name, dose text, unit) with a name: a number or null dose, a known unit or null, and their state."""
    d = drugs.where("trim(coalesce(name, '')) != ''").withColumn("dose", F.col("dose").try_cast("double")).withColumn("unit", F.when(F.col("unit").isin("mg", "mcg", "g", "ml", "U"), F.col("unit")))
    whole = F.col("dose").isNotNull() & F.col("unit").isNotNull()
    return d.withColumn("confidence", F.when(whole, 0.9).otherwise(0.7)).withColumn("color", F.when(whole, "YELLOW").otherwise("RED"))


_ERASE = re.compile(r"\x1b\[(\d+)D\x1b\[K")
_ESCAPE = re.compile(r"\x1b\[[0-9;?]*[A-Za-z]|[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _salvaged(raw: str | None) -> str | None:
    if raw is None:
        return None
    out, at = "", 0
    for m in _ERASE.finditer(raw):  # a terminal redraw takes back the last n characters
        out += raw[at : m.start()]
        out = out[: len(out) - int(m[1])] if int(m[1]) else out
        at = m.end()
    text, found, depth, begin, quoted, skip = _ESCAPE.sub("", out + raw[at:]), None, 0, 0, False, False
    for i, c in enumerate(text):
        if skip:
            skip = False
        elif depth and c == '"':
            quoted = not quoted
        elif quoted and c == "\\":
            skip = True
        elif not quoted and c == "{":
            begin, depth = (i if not depth else begin), depth + 1
        elif not quoted and c == "}" and depth:
            depth -= 1
            found = text[begin : i + 1] if not depth else found
    return found


@F.pandas_udf(T.StringType())
def salvage_json(raw: pd.Series) -> pd.Series:
    """The last balanced top-level object in a model's terminal output, null if there is none."""
    return raw.map(_salvaged)
