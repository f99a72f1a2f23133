"""Word errors, sound-alikes and repetitions against plain versions."""

import random
from functools import lru_cache

from pyspark.sql import functions as F

from wardscribe.functions import lexicon as L
from wardscribe.functions import phonetic
from wardscribe.operators import evaluate


def plain_errors(ref, hyp, medical):
    """(errors, medical errors) of the best alignment, by recursion."""

    @lru_cache(None)
    def best(i, j):
        if not i or not j:
            rest = ref[:i] + hyp[:j]
            return len(rest), sum(w in medical for w in rest)
        add = lambda x, w: (x[0] + 1, x[1] + w)
        a, b = ref[i - 1], hyp[j - 1]
        same = best(i - 1, j - 1) if a == b else add(best(i - 1, j - 1), a in medical or b in medical)
        return min(same, add(best(i - 1, j), a in medical), add(best(i, j - 1), b in medical))

    return best(len(ref), len(hyp))


def test_word_errors(spark):
    rng = random.Random(2)
    words = ["give", "DOLO", "500", "mg", "for", "fever", "é"]
    some = lambda: [rng.choice(words) for _ in range(rng.randrange(0, 12))]
    pairs = [(some(), some()) for _ in range(300)] + [(["dolo"] * 400, ["mg"] * 3)]
    rows = [(i, "en" if i % 2 else None, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)] + [(900, "hi", None, "500 x"), (901, "hi", "", None)]
    got = {r.errors_of: tuple(r)[4:] for r in evaluate.word_errors(spark.createDataFrame(rows, "errors_of long, lang string, ref string, hyp string"), "ref", "hyp", ["dolo", "mg"]).collect()}
    medical = {"dolo", "mg", "500"}
    for i, (a, b) in enumerate(pairs):
        a, b = tuple(w.lower() for w in a), tuple(w.lower() for w in b)
        errors, touched = plain_errors(a, b, medical)
        assert got[i] == (errors, len(a), touched, sum(w in medical for w in a)), (a, b)
    assert got[900] == (2, 0, 1, 0) and got[901] == (0, 0, 0, 0)


def test_error_rates(spark):
    d = spark.createDataFrame([("en", "give dolo 500 mg", "give dolo 650 mg"), ("en", "once daily", "once"), (None, "a b", "a b")], "lang string, ref string, hyp string")
    got = {r.lang: tuple(r)[1:] for r in evaluate.error_rates(evaluate.word_errors(d, "ref", "hyp", ["dolo", "mg"])).collect()}
    assert got == {"en": (2, 6, 0.333333, 1, 3, 0.333333), "und": (0, 2, 0.0, 0, 0, None), "all": (2, 8, 0.25, 1, 3, 0.333333)}
    assert evaluate.error_rates(evaluate.word_errors(d.limit(0), "ref", "hyp", [])).where("lang != 'all'").count() == 0


def test_field_rates(spark):
    rows = [("en", "dose", "5", "50", "GREEN", "50"), ("en", "dose", "5", "50", "RED", "5"), ("en", "symptom", "a", "b", "GREEN", "a"), ("en", None, None, None, None, None)]
    r = {x.lang: x for x in evaluate.field_rates(spark.createDataFrame(rows, "lang string, kind string, value string, gold string, color string, final string")).collect()}["en"]
    assert (r.fields, r.accuracy, r.critical, r.critical_rate, r.review_rate, r.correction_rate) == (4, 0.25, 1, 0.25, 0.5, 0.25)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_all_pairs_within_two_edits_meet(spark):
    rng = random.Random(3)
    names = [d[0] for d in L.DRUGS]
    said = {a for d in L.DRUGS for a in d[1]} | {"celebrex", "पैरासिटामोल", "x", "aa"}
    for n in names:
        w = list(n)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice("aeioukstph")
            said.add("".join(w))
    frame = lambda xs, c: spark.createDataFrame([(x,) for x in xs] + [(None,)], f"{c} string")
    keys = {r.w: r.k for r in frame(said | set(names), "w").select("w", phonetic.key(F.col("w")).alias("k")).collect() if r.w}
    got = {(r.said, r.name): r.distance for r in phonetic.sound_alikes(frame(said, "said"), frame(names, "name"), 2, 100).collect()}
    want = {(s, n): edits(keys[s], keys[n]) for s in said for n in names if keys[s] and edits(keys[s], keys[n]) <= 2}
    assert got == want and keys["parasetamol"] == keys["paracetamol"] if "parasetamol" in keys else got == want


def test_ambiguous(spark):
    r = phonetic.sound_alikes(spark.createDataFrame([("celecoksib",), ("celexa",), ("celexa",)], "said string"), spark.createDataFrame([("celecoxib",), ("celexa",), ("insulin",)], "name string"))
    rows = {(x.said, x.name): (x.distance, x.rank, x.code) for x in r.collect()}
    assert rows["celexa", "celexa"] == (0, 1, None) and rows["celecoksib", "celecoxib"][1:] == (1, "AMBIGUOUS_DRUG")
    assert not any(n == "insulin" for _, n in rows)


def plain_repeats(words, longest):
    out = []
    for p in range(1, longest + 1):
        most = run = 0
        for i in range(len(words)):
            run = run + 1 if i >= p and words[i] == words[i - p] else 0
            most = max(most, run)
        out.append(0 if len(words) < p else most // p + 1)
    return out


def test_repeats(spark):
    rng = random.Random(4)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(0, 14))] for _ in range(400)] + [["thank", "you"] * 3000]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>").select("id", phonetic.repeats(F.col("words"), 4).alias("r")).collect()
    assert all(r.r == plain_repeats(texts[r.id], 4) for r in got)
    said = [("thank you Thank you, thank YOU",), ("thank you thank you",), ("no no no",), (None,), ("",)]
    assert [r[0] for r in spark.createDataFrame(said, "t string").coalesce(1).select(phonetic.is_stuck(F.col("t"))).collect()] == [True, False, True, False, False]


def test_guesses_are_those_of_the_standard_library():
    """The values that the SQL of fuzzy names takes as given, by difflib over the dictionary, for all words of the notes."""
    import re
    from difflib import SequenceMatcher

    from wardscribe.plans import synth
    from wardscribe.plans.queries import GUESSED

    forms = {a: d[0] for d in L.DRUGS for a in (d[0], *d[1])}
    want = {}
    for w in sorted({w.lower() for part in synth.PARTS for w in re.findall("[A-Za-z]+", part)} - set(forms)):
        score, name = min((-SequenceMatcher(None, w, form).ratio(), name) for form, name in forms.items())
        if -score >= (0.55 if len(w) >= 8 else 0.6):
            want[w] = (name, -score)
    assert want == GUESSED
