"""Operators of the llm subpackage against brute force on small tables, and their edge cases."""

import hashlib
import re
import sys
import zlib
from collections import defaultdict
from datetime import date
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wardscribe.llm.queries")
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from wardscribe.llm import html, licenses, urlfilter  # noqa: E402
from wardscribe.llm.covertree import top_k  # noqa: E402
from wardscribe.llm.components import components  # noqa: E402
from wardscribe.llm.hnsw import near_duplicates  # noqa: E402
from wardscribe.llm.jaccard import jaccard_components  # noqa: E402
from wardscribe.llm.mixing import mix  # noqa: E402
from wardscribe.llm.packing import Bins, pack  # noqa: E402
from wardscribe.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from wardscribe.llm.stages import cut_repeats, drop_near_copies, drop_toxic, mix_sources, pack_sequences  # noqa: E402
from wardscribe.llm.substrings import dedup_substrings  # noqa: E402
from wardscribe.llm.toxicity import restore, score, toxicity, train, trigrams  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
DOC = "doc_id long, text string, lang string, source string, n_chars long, chunk string, size string, row string"


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with the operators' own names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (2, base), (2, base), (3, base + " end"), (4, None), (5, ""), (6, " \t\n "), (7, "one two"), (8, "ONE two"), (9, "x " * 30000), (None, base), (10, "é ß 漢字 " + base), (11, base.replace("w3 ", "q ")), (12, "a b c")]
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", 0, "c", "z", "r") for i, t in rows], DOC)


def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def windows_removed(rows):
    first, words, out = {}, [(i, re.findall(WORD, t or "")) for i, t in rows], []
    big = 2**63 - 1
    for i, w in words:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, big), big if i is None else i)
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (big if i is None else i):
                gone[k : k + 13] = [True] * 13
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("which", ["odd", "real"])
def test_substrings(spark, sf, which):
    d = odd_docs(spark) if which == "odd" else real_docs(spark, sf)
    got = sorted(map(tuple, dedup_substrings(d, chunk_docs=40).collect()), key=str)
    assert got == sorted(windows_removed(pairs_of(d)), key=str)


def jaccard_brute(rows, words, percent):
    sets, out = [], {}
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(parent, i), find(parent, j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(parent, i)) for i, s in sets), key=str)


@pytest.mark.parametrize(("which", "words", "percent"), [("odd", 4, 85), ("real", 4, 85), ("real", 5, 80)])
def test_jaccard(spark, sf, which, words, percent):
    d = odd_docs(spark) if which == "odd" else real_docs(spark, sf)
    got = sorted(map(tuple, jaccard_components(d, words, percent, chunk_docs=40).collect()), key=str)
    assert got == jaccard_brute(pairs_of(d), words, percent)


def test_jaccard_chains(spark):
    """Near copies around a base whose copies are too far from each other, and rings of single changes."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for g in range(6):
        base = [f"g{g}x{i}" for i in range(120)]
        for _ in range(25):
            t = list(base)
            for at in rng.choice(120, rng.integers(0, 6), replace=False):
                t[at] = f"n{rng.integers(10**9)}"
            rows.append((n, " ".join(t)))
            n += 1
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(d, chunk_docs=20).collect()), key=str) == jaccard_brute(rows, 4, 85)


def test_components(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {i: i for i in range(400)}
    for a, b in e:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert all(c == find(parent, n) for n, c in got.items())
    assert {n for a, b in e if a != b for n in (a, b)} >= set(got) and all(find(parent, n) == n for n in parent if n not in got)


def vectors(spark):
    rng = np.random.default_rng(2)
    c = rng.normal(size=(12, 8))
    x = [(c[i % 12] + rng.normal(size=8) * 0.06).astype(np.float32).tolist() for i in range(300)]
    rows = [(i, v, i % 12 % 3, "x", 1) for i, v in enumerate(x)] + [(i + 1000, x[0], 0, "x", 1) for i in range(40)]
    rows += [(2000, None, 0, "x", 1), (2020, [1.0, None], 0, "x", 1), (2040, [float("nan")] * 8, 0, "x", 1), (2060, [0.0] * 8, 0, "x", 1), (2080, x[0], None, "x", 1), (None, x[0], 0, "x", 1), (2100, [], 1, "x", 1), (3, x[3], 0, "x", 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id string, part long")


def test_top_k(spark):
    d = vectors(spark)
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, float))) for r in d.collect() if r.vec_id is not None and r.embedding is not None and all(v is not None and np.isfinite(v) for v in r.embedding)]
    want = set()
    for i, q in {i: q for i, q in rows if i % 20 == 0}.items():
        s = sorted((-int(sum(a * b for a, b in zip(q, v))), j) for j, v in rows if j != i)[:20]
        want |= {(i, k + 1, j, -v) for k, (v, j) in enumerate(s)}
    assert {tuple(r) for r in top_k(d, lambda c: c % 20 == 0, shard=60).collect()} == want


def test_near_duplicates(spark):
    d = vectors(spark)
    rows = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in d.collect() if r.vec_id is not None and r.label is not None and r.embedding and all(v is not None and np.isfinite(v) for v in r.embedding) and any(r.embedding)]
    links, parent = defaultdict(int), {r.vec_id: r.vec_id for r in d.collect()}
    for a in range(len(rows)):
        for b in range(a):
            (i, k, x), (j, m, y) = rows[a], rows[b]
            if k == m and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[i] += 1
                links[j] += 1
                p, q = find(parent, i), find(parent, j)
                parent[max(p, q)] = min(p, q)
    got = [r for r in near_duplicates(d, shard=50).collect()]
    assert len(got) == d.count()
    found = sum(r.n_links for r in got if r.vec_id not in (3, None))
    true = sum(v for i, v in links.items() if i != 3)
    assert 0.9 * true <= found <= true
    for r in got:
        if r.vec_id is not None:
            assert r.component_id == find(parent, r.vec_id) and r.kept == (r.vec_id == r.component_id)


def test_mix(spark, sf):
    for d in (real_docs(spark, sf), odd_docs(spark)):
        m = mix(d).collect()
        assert sorted(map(tuple, m), key=str) == sorted(map(tuple, mix(d).collect()), key=str)
        size = lambda t: len(re.findall(WORD, t or ""))
        assert sorted((r.size for r in m)) == sorted(size(t) for _, t in pairs_of(d))
        assert all(r.taken <= 2 * r.size for r in m)
        src = {r.doc_id: r.source for r in d.collect()}
        by = defaultdict(lambda: [0, 0, 0, 0])
        for r in m:
            b = by[src[r.doc_id]]
            b[0], b[1], b[2], b[3] = b[0] + r.size, b[1] + r.taken, r.target, max(b[3], r.size)
        for b in by.values():
            assert abs(b[1] - b[2]) <= b[3] / 2 + 1
        # water filling by repeated sharing of the excess
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
        w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        total, capped = 1.5 * sum(b[0] for b in by.values()), {}
        while True:
            rest = [s for s in names if s not in capped]
            left = total - sum(capped.values())
            t = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
            over = [s for s in rest if t[s] > 2 * by[s][0]]
            if not over:
                break
            capped |= {s: 2 * by[s][0] for s in over}
        for s in names:
            assert abs(by[s][2] - (capped | t)[s]) < 1e-6 * max(total, 1)


def test_pack(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    hard = [(50, "Don't STOP, <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>"), (51, "é́ ΑΣ Σ İ ǅ a̸, ≠ ﬁ ½ 12.5%. ''s |a|"), (52, "\x1c a\x85b c")]
    d = real_docs(spark, sf).select("doc_id", "text").where("doc_id < 50").union(spark.createDataFrame(hard, "doc_id long, text string")).union(odd_docs(spark).where("doc_id != 2").selectExpr("doc_id + 100", "text"))
    by, bins = defaultdict(list), defaultdict(list)
    for r in pack(d, path).collect():
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for i, t in pairs_of(d):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        p = sorted(by[i], key=lambda r: r.piece)
        assert [r.start for r in p] == list(range(0, len(ids), 2048)) and sum(r.length for r in p) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in p)
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048


def test_bins_keep_their_bound():
    rng = np.random.default_rng(0)
    b, used = Bins(100, 4), defaultdict(int)
    for n in rng.integers(1, 100, 500):
        k, at = b.place(int(n))
        assert at == used[k]
        used[k] += int(n)
        assert used[k] <= 100 and b.open <= 4


def test_toxicity(spark, sf):
    d, y = real_docs(spark, sf.replace("0.001", "0.1")), spark.read.parquet(sf.replace("0.001", "0.1") + "/labels.parquet")
    r = toxicity(d, y).join(y, "doc_id").where("held_out").collect()
    hit = sum(x.predicted and x.toxic for x in r)
    assert hit >= 0.9 * sum(x.toxic for x in r) and hit >= 0.97 * sum(x.predicted for x in r)
    assert {x.held_out for x in toxicity(d, y).select("doc_id", "held_out").collect() if zlib.crc32(str(x.doc_id).encode()) % 4 == 2} == {True}
    m = train(d, y)
    assert [restore(w, m.lm) for w in ("l0ser", "m0r0n", "idiooot", "tr@sh")] == ["loser", "moron", "idiot", "trash"]
    assert restore("i d i o t", m.lm, True).startswith("idiot")
    base = ["Thereof " * 30, None, "", "you l0ser and m0r0n"]
    s = [x._toxicity for x in score(spark.createDataFrame(list(enumerate(base)), "doc_id long, text string").coalesce(1), m).orderBy("doc_id").collect()]
    assert s[3] > 0.3 > max(s[:3]) and s[1] == s[2]


def _plain_insults(spark):
    """A model of documents with an insult in the clear."""
    bad = ["stupid", "idiot", "rubbish"]
    rows = [(i, f"there you are said number {i} to the {bad[i % 3] if i % 2 else 'other'} one in the stupor of idioms at hand", i % 2) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return train(d.drop("toxic"), d.drop("text"))


def _scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [x._toxicity for x in score(rows, model).orderBy("doc_id").collect()]


def test_disguises_reach_the_lattice(spark):
    """Look-alikes at a word's edges, with a letter or none beside them, and words of 64 bytes or more."""
    m = _plain_insults(spark)
    words = ["stupid", "$tupid", "!diot", "$tup!d", "st" + "u" * 80 + "pid", "st" + "u" * 300 + "pid", "rubbi$#"]
    s = _scores(spark, m, ["there you are"] + ["said the " + w for w in words])
    assert s[0] < 0.3 < min(s[1:]), dict(zip(words, s[1:]))
    from wardscribe.llm.toxicity import _Features

    import pyarrow as pa

    seen = []
    maker = _Features(m.lm)
    maker._restored = lambda word, gaps=False: seen.append(word) or np.zeros(0, np.uint64)
    odd = ["a$$", "$h!7", "@$$", "455", "x" + "-abc0" * 40]
    maker.of(pa.array([" ".join(odd + ["plain", "words", "--", "!!!"])]))
    assert seen and set(seen) == set(odd)


def test_spaced_words_end_with_their_text(spark):
    """The row that follows does not change a score, and two distinct letters are enough."""
    m = _plain_insults(spark)
    alone = _scores(spark, m, ["said the i d i o t"])[0]
    assert alone > 0.3 and all(_scores(spark, m, ["said the i d i o t", after])[0] == alone for after in ("A one", "1", "* # I a"))
    import pyarrow as pa

    from wardscribe.llm.toxicity import _Features

    seen = []
    maker = _Features(m.lm)
    maker._restored = lambda word, gaps=False: seen.append(word) or np.zeros(0, np.uint64)
    maker.of(pa.array(["p o o p", "a s s", "1 1 1", "no", "i d"]))
    assert seen == ["p o o p", "a s s", "1 1 1"]
    seen.clear()
    maker.of(pa.array(["x id io t y", "to be or", "of it", "a" + " b" * 200]))
    assert seen == ["x id io t y", "a" + " b" * 200]


def _every_reading(word, model, gaps):
    """All readings of a word with their costs, one by one."""
    from itertools import groupby, product

    from wardscribe.llm import toxicity as t

    choices = []
    for c, run in groupby(word):
        n = len(list(run))
        if "a" <= c <= "z":
            choices.append([(0.0 if n == 1 else t.COLLAPSE, c)] + ([(0.0 if n == 2 else t.KEEP_TWO, c * 2)] if n > 1 else []))
        elif gaps and c == " ":
            choices.append([(t.CLOSE_GAP, ""), (0.0, " ")])
        else:
            choices.append([(t.SUBSTITUTE * n, x * min(n, 2)) for x in t.LOOKALIKES.get(c, "")] + ([] if c.isalnum() else [(t.DROP, "")]) + [(0.0, c * n)])
    for way in product(*choices):
        text = "".join(x for _, x in way)
        codes = [t.EDGE, t.EDGE, *(ord(c) - 97 if "a" <= c <= "z" else t.EDGE if c == " " else t.OTHER for c in text), t.EDGE]
        yield sum(p for p, _ in way) - sum(model[x, y, z] for x, y, z in zip(codes, codes[1:], codes[2:])), text


def test_restore_against_every_reading():
    rng = np.random.default_rng(11)
    model = np.log(rng.dirichlet(np.ones(28) * 0.3, (28, 28)) + 1e-6)
    letters = list("abcdist") + list("013$!*@+") + ["aaa", "ss", "!!"]
    for k in range(60):
        gaps = k % 3 == 0
        word = (" " if gaps else "").join(rng.choice(letters, rng.integers(1, 7)))
        every = list(_every_reading(word, model, gaps))
        least = min(c for c, _ in every)
        got = restore(word, model, gaps)
        assert min(c for c, x in every if x == got) <= least + 1e-9


def test_scores_do_not_depend_on_the_layout(spark):
    """Long words differ by what follows their 16th byte, and slices or partitions change neither model nor score."""
    rows = [(i, f"some words number {i} abcdefghijklmnop{'xxyy' if i % 2 else 'zzww'}yes and no", i % 2) for i in range(120)] + [(500, "A", 0), (501, "1 i d", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    one, many = (x.drop("toxic") for x in (d.coalesce(1), d.repartition(5, "text")))
    assert np.array_equal(trigrams(one), trigrams(many))
    y = d.drop("text")
    a, b = ({r.doc_id: r._toxicity for r in score(x, train(x, y)).collect()} for x in (one, many))
    assert a == b and min(a[i] for i in range(1, 120, 2)) > 0.5 > max(a[i] for i in range(0, 120, 2))


def test_short_words_count_twice(spark):
    import pyarrow as pa

    from wardscribe.llm.toxicity import _Features

    maker = _Features(np.full((28, 28, 28), np.log(1 / 28)))
    found = lambda t: set(maker.of(pa.array([t]))[1].tolist())
    assert len(found("scum")) == 2 and len(found("ab")) == 2 and len(found("scums")) == 2 and len(found("scum") & found("scums")) == 1
    assert found("") == set() and found("a") == set()


def test_toxicity_edges(spark):
    y = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    d = odd_docs(spark)
    assert toxicity(d, y).count() == d.count()
    assert toxicity(d.limit(0), y).count() == 0 and toxicity(d, y.limit(0)).count() == d.count()
    assert np.isfinite(trigrams(d.limit(0))).all()


PAGE = '<html><head><title>T</title></head><body><header>Top</header><nav><ul><li><a>Menu one</a></ul></nav><div class="cookie-notice">Accept</div>%s<aside>side</aside><form>search</form><div id="comments"><p>reader</div><footer>end</footer></body></html>'


def test_html(spark):
    art = '<article><h1>Head</h1><p>One <b>b</b>old &amp; 1 &lt; 2<p>Two\n  lines<script>var x = "<p>no</p>"</script><style>p{}</style><div class="ad">buy</div><ul><li>i<li>j</ul><!-- c --></article>'
    rows = [(1, "http://h.org/a", PAGE % art), (2, "http://h.org/b", None), (3, None, ""), (4, "http://h.org/c", "<article>cut <p>here &am"), (5, "http://h.org/d", "<main>x<br>y</main><p>out"), (5, "http://h.org/d", "<main>x<br>y</main><p>out")]
    shared = "<p>Read our terms and the policy of this site before going on today</p>"
    rows += [(10 + i, f"http://g.org/{i}", f"<body>{shared}<div>{i} page{i} has{i} words{i} alone {'abc' * i}</div>") for i in range(3)]
    got = sorted(map(tuple, html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    want = {1: "Head One bold & 1 < 2 Two lines i j", 2: "", 3: "", 4: "cut here &am", 5: "x y"} | {10 + i: f"{i} page{i} has{i} words{i} alone {'abc' * i}".strip() for i in range(3)}
    assert len(got) == len(rows) and all(t == want[i] and n == len(t) for i, _, t, n in got)


def test_html_shards_share_evidence(spark):
    """Boilerplate on two pages of a large host goes as it does without shards, wherever the pages fall."""
    page = lambda i, run: f"<p>{run}</p><div>own{i} text{i} of{i} page{i}</div>"
    run = lambda k: " ".join(f"r{k}w{j}" for j in range(12))
    rows = [(i, f"http://big.org/{i}", page(i, run(i // 2))) for i in range(60)] + [(60 + i, f"http://big.org/{60 + i}", f"<article>a{i}</article>" + page(60 + i, run(i))) for i in range(20)]
    rows += [(100, "http://small.org/", page(100, run(0))), (2, "http://big.org/2", page(2, run(1)))]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda **k: sorted(map(tuple, html.main_text(d, **k).collect()))
    assert texts(shard=8) == texts()
    got = {r[0]: r[2] for r in texts(shard=8)}
    assert all(got[i] == f"own{i} text{i} of{i} page{i}" for i in range(60)) and got[60] == "a0" and got[100].startswith("r0w0")


def test_suffix_array():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50):
        s = rng.integers(0, 3, n)
        sa = html.SuffixArray(s)
        want = sorted(range(n), key=lambda i: s[i:].tolist())
        assert sa.order.tolist() == want
        for k in range(1, n):
            a, b = s[want[k - 1] :].tolist(), s[want[k] :].tolist()
            assert sa.shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_licenses(spark):
    rows = [(1, "Intro. Licensed under the Apache License, Version 2.0. More"), (2, "no licence here, reserved seats"), (3, "ALL RIGHTS RESERVED"), (4, None), (5, ""), (1, "Released under the MIT license"), (6, "Permission is hereby granted, free of charge, to any PERSON obtaining a copy of this program and associated documentation files")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n long")
    want = set()
    for i, t in rows:
        w = licenses.words_of(t or "")
        for name, text in licenses.TEMPLATES.items():
            own = set(licenses.shingles(licenses.words_of(text)))
            size = len(licenses.words_of(text))
            hits = [(len(own & set(licenses.shingles(w[k : k + size]))) / len(own), k) for k in range(max(1, len(w) - size + 1)) if w]
            hits = [h for h in hits if h[0] >= 0.8]
            if hits:
                want.add((i, name, max(h[0] for h in hits), min(h[1] for h in hits), len(hits)))
    assert {tuple(r) for r in licenses.scan(d).collect()} == want
    assert licenses.scan(d.limit(0)).count() == 0


def test_url_filter(spark):
    e = spark.createDataFrame([("a.b.org", "x", "add", date(2024, 1, 5)), ("a.b.org", "x", "remove", date(2024, 2, 1)), ("b.org", "y", "add", date(2024, 1, 20)), ("a.b.org/p", "z", "add", date(2024, 1, 1)), (None, "x", "add", date(2024, 1, 1)), ("a.b.org", "x", "add", date(2024, 3, 1))], "key string, list string, action string, at date")
    rows = [("http://A.b.org/p/q", date(2024, 1, 4)), ("http://a.b.org/", date(2024, 1, 5)), ("http://a.b.org:80/z", date(2024, 1, 31)), ("http://a.b.org", date(2024, 2, 1)), (None, date(2024, 2, 1)), ("http://a.b.org", None), ("http://a.b.org/x", date(2024, 3, 2)), ("http://c.org", date(2024, 3, 2))]
    c = spark.createDataFrame([(u, f, "k") for u, f in rows], "url string, fetched date, key string")
    got = [(r.url, r.fetched, r._lists) for r in urlfilter.filter_captures(c, e).collect()]
    want = [["z"], ["x"], ["x", "y"], ["y"], [], [], ["x", "y"], []]
    assert sorted(got, key=str) == sorted(((u, f, w) for (u, f), w in zip(rows, want)), key=str)


def test_empty_tables(spark):
    d, v = odd_docs(spark).limit(0), vectors(spark).limit(0)
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for out in (dedup_substrings(d), jaccard_components(d), mix(d), pack(d, path), top_k(v, lambda c: c % 20 == 0), near_duplicates(v), html.main_text(pages)):
        assert out.count() == 0


def test_stages_keep_columns(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 0), (2, 0), (None, 1)], "doc_id long, toxic int").write.parquet(sf + "/labels.parquet")
    d = odd_docs(spark).selectExpr("*", "1 as _toxicity", "2 as _copies", "3 as _copy", "4 as `a.b`", "5 as n_removed", "6 as token")
    for stage in (drop_toxic, drop_near_copies, cut_repeats, mix_sources):
        out = stage(spark, d, sf)
        assert out.columns == d.columns and out.count() > 0
        assert {tuple(r) for r in out.select("_toxicity", "_copies", "_copy", "`a.b`", "n_removed", "token").collect()} == {(1, 2, 3, 4, 5, 6)}
        empty = stage(spark, d.limit(0), sf)
        assert empty.columns == d.columns and empty.count() == 0
    assert pack_sequences(spark, d, sf).count() >= d.count() and pack_sequences(spark, d.limit(0), sf).count() == 0
    kept = {r.doc_id: r.text for r in cut_repeats(spark, d, "").collect()}
    assert kept[3] == "end" and 2 not in kept and kept[12] == "a\u00a0b c" and kept[5] == ""
    assert {r.doc_id for r in drop_near_copies(spark, d, "").collect()} >= {1, 4, 5, 6, 9, None}
    assert {r.doc_id for r in drop_toxic(spark, d, sf).collect()} == {r.doc_id for r in d.collect()}
    twins = spark.createDataFrame([(1, "one text of its own here", "s"), (1, "quite another text with the id", "s"), (1, "one text of its own here", "s")], "doc_id long, text string, source string")
    assert sorted(r.text for r in drop_near_copies(spark, twins, "").collect()) == ["one text of its own here", "quite another text with the id"]


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "substring dedup", "mixing", "packing"]
    out = corpus_pipeline.run(spark, sf)
    total = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert total[0] <= 2048 and total[1] > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    rows = lambda df: sorted(tuple(f"{v:.9f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
