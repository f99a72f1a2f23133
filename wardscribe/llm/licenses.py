"""License scans with DataFrame functions only: MinHash bands over overlapping windows, then exact shingle containment.

A document is lower-cased and split into runs of a-z and 0-9. For a template of
L words every window of L words overlapping the previous one by L - 1 is a
candidate place, but only windows that hold one of the template's anchor words
can match: anchors are the words that lie in more than a fifth of its shingles
together, and a match needs four fifths of them. Each window's five-word
shingles give BANDS bands of ROWS minima; a window that shares a band with a
template is compared with it exactly. At the least similarity that a match can
have (0.8 contained of equally many: Jaccard 2/3) a pair shares a band with
probability 1 - (1 - (2/3) ** ROWS) ** BANDS, over 0.9999 for 2 and 16.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, ROWS, CONTAINED = 5, 16, 2, 0.8
#: Wordings of licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "all-rights-reserved": "All rights reserved",
}


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def shingles(words: list[str]) -> list[str]:
    """Distinct shingles of five words; all words if fewer."""
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))})


def anchors(words: list[str]) -> list[str]:
    """Fewest long words that lie in more than a fifth of the shingles: a window without them holds less than four fifths."""
    every, chosen = shingles(words), []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        chosen.append(w)
        if sum(any(c in s.split() for c in chosen) for s in every) > (1 - CONTAINED) * len(every) + 1e-9:
            return chosen
    return chosen


def _bands(sh: Column) -> Column:
    def least(k: int) -> Column:
        return F.array_min(F.transform(sh, lambda s: F.xxhash64(F.lit(k), s)))

    low = [least(k) for k in range(BANDS * ROWS)]
    return F.array(*[F.xxhash64(F.lit(b), *low[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])


def _starts(anchor_words: list[str], length: int) -> Column:
    """Windows of the length that hold an anchor word: their first words."""
    spots = F.filter("held", lambda s: s["word"].isin(anchor_words))
    firsts = F.array_distinct(F.flatten(F.transform(spots, lambda s: F.sequence(F.greatest(s["at"] - (length - 1), F.lit(0)), s["at"]))))
    return F.transform(firsts, lambda a: F.struct(a.alias("at"), F.lit(length).alias("length")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Licence notices of each document.

    docs: doc_id long, text string; other columns are ignored. Returns doc_id,
    license, contained (the largest share of the template's shingles that one
    window holds, 0.8 or more), first_word (where the first such window begins)
    and n_windows, one row for each doc_id and licence found. A text with fewer
    words than a template can't hold it unless it holds 0.8 of its shingles in
    the words that it has. Null and empty texts hold none; repeated rows (and
    repeated ids) are counted together under their doc_id, null too; an empty
    table gives an empty one.
    """
    spec = {name: words_of(t) for name, t in templates.items() if words_of(t)}
    some = sorted({a for w in spec.values() for a in anchors(w)})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text")).where(F.col("text").rlike("|".join(some)))
    d = d.select("doc_id", F.array_remove(F.split("text", "[^a-z0-9]+"), "").alias("w")).withColumn("n", F.size("w"))
    held = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("at"))), lambda s: s["word"].isin(some))
    d = d.withColumn("held", held).where(F.size("held") > 0)
    lengths = {len(w): sorted({a for t in spec.values() if len(t) == len(w) for a in anchors(t)}) for w in spec.values()}
    spots = F.flatten(F.array(*[_starts(mine, length) for length, mine in sorted(lengths.items())]))
    x = d.select("doc_id", "w", "n", F.explode(spots).alias("s")).select("doc_id", "w", "n", "s.*")
    x = x.where((F.col("at") + F.col("length") <= F.col("n")) | ((F.col("at") == 0) & (F.col("n") < F.col("length"))))
    x = x.select("doc_id", "at", "length", F.slice("w", F.col("at") + 1, F.col("length")).alias("part"))
    last = F.greatest(F.size("part") - SHINGLE, F.lit(0))
    x = x.withColumn("sh", F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("part", i + 1, SHINGLE), " ")))).withColumn("bands", _bands(F.col("sh")))
    known = F.array(*[F.struct(F.lit(t).alias("license"), F.lit(len(w)).alias("length"), F.array(*map(F.lit, shingles(w))).alias("sh")) for t, w in spec.items()])
    known = F.transform(known, lambda t: F.struct(t["license"].alias("license"), t["length"].alias("length"), t["sh"].alias("sh"), _bands(t["sh"]).alias("bands")))
    near = F.filter(known, lambda t: (t["length"] == F.col("length")) & F.arrays_overlap(t["bands"], F.col("bands")))
    hits = F.transform(near, lambda t: F.struct(t["license"].alias("license"), (F.size(F.array_intersect(F.col("sh"), t["sh"])) / F.size(t["sh"])).alias("contained")))
    found = x.select("doc_id", "at", F.explode(hits).alias("hit")).select("doc_id", "at", "hit.*").where(F.col("contained") >= CONTAINED - 1e-9)
    return found.groupBy("doc_id", "license").agg(F.max("contained").alias("contained"), F.min("at").cast("long").alias("first_word"), F.count("*").alias("n_windows"))
