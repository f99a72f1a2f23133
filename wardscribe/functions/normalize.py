"""Normalization of dictated and scanned text: ordered rewrites with a log of those that fired."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .lexicon import LEXICON

# Rewrites in order (pattern, replacement with $n, log entry or None, for speech only).
BEFORE_NUMBERS = [
    *[(rf"(?i)\b{re.escape(a).replace(chr(92) + ' ', ' ')}\b", b, (a, b), False) for a, b in LEXICON],
    (r"(\d+)\s*(mg|mcg|ml|g)\b", "$1 $2", None, False),
    (r"\bB[\s-]*P\b", "BP", None, False),
    (r"(?i)\bBPA(\s*\d)", "BP$1", ("BPA", "BP"), True),
    (r"(?i)(\d\s*(?:by|/|over|of)\s*)AC\b", "$180", ("by AC", "by 80"), True),
    (r"(?i)rhoomair", "room air", ("Rhoomair", "room air"), True),
    (r"(?i)\bS[\s-]*P[\s-]*O[\s-]*(two|2)\b", "SpO2", ("S-P-O-two", "SpO2"), False),
    (r"(?i)\bq(\d+)h\b", "every $1 hours", ("qNh", "every N hours"), False),
    (r"\bBD\b", "twice daily", ("BD", "twice daily"), False),
    (r"\bTID\b", "thrice daily", ("TID", "thrice daily"), False),
]
AFTER_NUMBERS = [
    (r"(\d+(?:\.\d+)?)\s*(by|over)\s*(\d+(?:\.\d+)?)", "$1/$3", None, False),
    (r"(?i)((?:BP|blood pressure)[^.]{0,40}?\d+(?:\.\d+)?)\s+of\s+(\d+(?:\.\d+)?)", "$1/$2", None, False),
]

# Number words.
UNITS_ = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS_ = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
WORD_VALUE = {w: i for i, w in enumerate(UNITS_)} | {w: 10 * (i + 2) for i, w in enumerate(TENS_)}
_ANY = "|".join(sorted([*WORD_VALUE, "hundred", "and"], key=len, reverse=True))


def _any_of(words: list[str]) -> str:
    """A pattern of the words that shares their beginnings."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    some = [h + _any_of(rest) for h, rest in sorted(heads.items(), reverse=True) if h]
    return "" if not some else some[0] if len(some) == 1 and "" not in heads else f"(?:{'|'.join(some)}){'?' if '' in heads else ''}"


NUMBER_RUN = rf"(?i)\b(?:{_ANY})(?:[ -](?:{_ANY}))*\b"

_WORDS = _any_of([*WORD_VALUE, "hundred", "and"])
#: NUMBER_RUN for Java: as no word goes on as a letter, a run matches alike however the words are tried.
#: The first letters are looked at before the words are tried.
_RUN = rf"(?i)(?<!\w)(?=[{''.join(sorted({w[0] for w in [*WORD_VALUE, 'hundred', 'and']}))}])({_WORDS}(?:[ -]{_WORDS})*)(?!\w)"
#: Not the mark between sentences, which a text has that is cut later.
_MARK = "\u0002"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed a single time. Spark also ends a stage's generated method here."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_words(text: Column | str) -> Column:
    """Spoken numbers as digits: 'one thirty' is 130, 'five hundred' 500; runs that are worth nothing stay.

    One search marks the text's runs of number words (a text that has the mark
    itself is searched for the runs and for what is between them). A run's words
    become values: a unit that tens follow at once is worth hundreds, 'hundred'
    scales what is there (at least one), other words add. All in the JVM.
    """
    t = F.col(text) if isinstance(text, str) else text
    values = F.create_map(*[F.lit(x) for kv in {**WORD_VALUE, "hundred": -1}.items() for x in kv])

    def total(v: Column) -> Column:
        unit = F.coalesce(F.get(v, F.lit(0)), F.lit(0))
        lead = unit.between(1, 9) & (F.coalesce(F.get(v, F.lit(1)), F.lit(0)) >= 20)
        rest = F.aggregate(F.when(lead, F.slice(v, 2, F.size(v))).otherwise(v), F.lit(0), lambda x, y: F.when(y == -1, F.greatest(x, F.lit(1)) * 100).otherwise(x + y))
        return F.when(lead, unit * 100).otherwise(0) + rest

    def digits(run: Column) -> Column:
        worth = F.transform(F.filter(F.split(F.translate(F.lower(run), "-", " "), " "), lambda w: w != "and"), lambda w: values[w])
        return once(once(worth, total), lambda s: F.when(s > 0, s.cast("string")).otherwise(run))

    marked = F.split(F.regexp_replace(t, _RUN, f"{_MARK}$1{_MARK}"), _MARK)
    joined = F.array_join(F.transform(marked, lambda x, i: F.when(i % 2 == 1, digits(x)).otherwise(x)), "")
    between, runs = F.split(t, _RUN), F.regexp_extract_all(t, F.lit(_RUN), F.lit(1))
    apart = F.array_join(F.zip_with(between, F.transform(runs, digits), lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")
    return F.when(F.contains(t, F.lit(_MARK)), apart).otherwise(joined)


def lang_tag(text: Column) -> Column:
    """mix, ta-IN, hi-IN or en-IN by the scripts and Hinglish cues of the text."""
    hi, ta, latin = text.rlike(r"[ऀ-ॿ]"), text.rlike(r"[஀-௿]"), text.rlike("[A-Za-z]")
    cue = text.rlike(P.edged(P.HINGLISH))
    several = hi.cast("int") + ta.cast("int") + latin.cast("int") > 1
    return F.when(several | (cue & latin), "mix").when(ta, "ta-IN").when(hi, "hi-IN").otherwise("en-IN")


def _steps(speech: bool, numbers: bool) -> list:
    """The rewrites in order; None stands for number words."""
    keep = lambda steps: [x for x in steps if speech or not x[3]]
    return [*keep(BEFORE_NUMBERS), *([None] if numbers else []), *keep(AFTER_NUMBERS)]


#: What a text must have for a rewrite to change it: substrings of the small letters (one of them), or a shorter pattern.
_NEEDS = {
    r"\bB[\s-]*P\b": re.compile(r"B[\s-]+P"), r"(?i)\bBPA(\s*\d)": ["bpa"], r"(?i)(\d\s*(?:by|/|over|of)\s*)AC\b": re.compile("[yYrRfF/]\\s*[aA][cC]"), r"(?i)rhoomair": ["rhoomair"],
    r"(?i)\bS[\s-]*P[\s-]*O[\s-]*(two|2)\b": re.compile(r"[pP][\s-]*[oO][\s-]*[tT2]"), r"(?i)\bq(\d+)h\b": ["q"], r"\bBD\b": ["bd"], r"\bTID\b": ["tid"],
    r"(\d+(?:\.\d+)?)\s*(by|over)\s*(\d+(?:\.\d+)?)": ["by", "over"], r"(?i)((?:BP|blood pressure)[^.]{0,40}?\d+(?:\.\d+)?)\s+of\s+(\d+(?:\.\d+)?)": ["of"],
} | {rewrite[0]: [rewrite[2][0].lower()] for rewrite in BEFORE_NUMBERS[: len(LEXICON)]}


def _may_fire(pattern: str, t: Column) -> Column:
    """Whether a rewrite may change the text, by a look that costs less than the rewrite."""
    need = _NEEDS.get(pattern)
    if need is None:
        return F.lit(True)
    return t.rlike(need.pattern) if isinstance(need, re.Pattern) else reduce(or_, [F.contains(F.lower(t), F.lit(x)) for x in need])


def _apply(step, t: Column) -> tuple[Column, Column | None]:
    """The rewritten text and, if the step is logged, its entry where it fired."""
    if step is None:
        return number_words(t), None
    pattern, to, entry, _ = step
    may = _may_fire(pattern, t)
    new = F.when(may, F.regexp_replace(t, pattern, to)).otherwise(t)
    fired = (t != new) if entry and entry[1] == "SpO2" else may & t.rlike(pattern)
    return new, F.when(fired, F.struct(F.lit(entry[0]).alias("from"), F.lit(entry[1]).alias("to"))) if entry else None


def _line(step):
    """The step on a line (t, log)."""

    def one(line: Column) -> Column:
        new, entry = _apply(step, line["t"])
        log = line["log"] if entry is None else F.concat(line["log"], F.array_compact(F.array(entry)))
        return F.struct(new.alias("t"), log.alias("log"))

    return one


def normalize(notes: DataFrame, source: str = "audio", numbers: bool = True) -> DataFrame:
    """Adds normalized_en, normalizations (array of from, to in order) and lang_tag to notes(text).

    source 'image' skips the mishearing rules and normalizes line by line, inside
    an array of the row, so that repeated rows stay apart. Null text gives nulls.
    """
    if source == "image":
        none = F.array().cast("array<struct<from:string,to:string>>")
        out = notes.withColumn("_l", F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("t"), none.alias("log"))))
        for step in _steps(False, numbers):
            out = out.withColumn("_l", F.transform("_l", _line(step)))
        return out.select(*[F.col(f"`{c}`") for c in notes.columns], F.array_join("_l.t", "\n").alias("normalized_en"), F.flatten("_l.log").alias("normalizations"), lang_tag(F.col("text")).alias("lang_tag"))
    out, log = notes.withColumn("_t0", F.col("text")), []
    for k, step in enumerate(_steps(True, numbers)):
        t = F.col(f"_t{k}")
        new, entry = _apply(step, t)
        if k % 5 == 4:  # so that a stage's code stays short enough for the JVM to compile
            new = once(new, lambda x: x)
        out = out.withColumn(f"_t{k + 1}", new)
        if entry is not None:
            log.append(entry)
    return out.select(*[F.col(f"`{c}`") for c in notes.columns], F.col(f"_t{k + 1}").alias("normalized_en"), F.array_compact(F.array(*log)).alias("normalizations"), lang_tag(F.col("text")).alias("lang_tag"))
