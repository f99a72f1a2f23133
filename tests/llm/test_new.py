"""Collocations, archives and prefix tries against brute force, and their edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

pytest.importorskip("wardscribe.llm.queries")

from wardscribe.llm import phrases, warc  # noqa: E402
from wardscribe.llm.phrases import Bitmaps, best_phrases, collocations  # noqa: E402
from wardscribe.llm.prefixes import conversations, prefix_trie, rebuilt  # noqa: E402
from wardscribe.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from wardscribe.llm.warc import payloads_of, read_archives, write_archives  # noqa: E402


def plain(df):
    show = lambda v: "null" if pd.isna(v) else repr(v).removesuffix(".0") if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["op11_collocations", "op12_warc", "op13_prefix_trie"])
def test_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(c.execute(ORACLE_SQL[name]).df())


def pieces(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def collocations_brute(rows, words, support, covered):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for p in pieces(text):
            n[lang or "und"] += len(p)
            for k in range(1, words + 1):
                f[lang or "und"].update(tuple(p[i : i + k]) for i in range(len(p) - k + 1))
    out = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= support}
        for p, a in cand.items():
            if any(100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            out.append((lang, " ".join(p), a, count[p[:k]], count[p[k:]], k, n[lang], score))
    return sorted(out)


@pytest.mark.parametrize(("words", "shard"), [(3, 1_500_000), (3, 300), (5, 500), (2, 200)])
def test_collocations(spark, monkeypatch, words, shard):
    rng = np.random.default_rng(3)
    alphabet = ["the", "The", "of", "sea", "é", "漢字", "a"]
    rows = []
    for i in range(120):
        t = rng.choice(alphabet, int(rng.integers(1, 60)))
        ends = rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!? "], len(t))
        rows.append((["en", "fr", None][i % 3], "".join(a + b for a, b in zip(t, ends)), 1))
    rows += [("en", None, 1), ("en", "", 1), ("en", " . ,", 1), ("de", "a " * 5000, 1), ("de", "x" * 9000, 1), ("und", "of the sea " * 12, 1)]
    d = spark.createDataFrame(rows, "lang string, text string, n int").withColumnRenamed("n", "shard")
    monkeypatch.setattr(phrases, "SHARD", shard)
    got = collocations(d, words, 4, 50)
    assert sorted(tuple(r) for r in got.select("lang", "phrase", "a", "l", "r", "k", "n", "score").collect()) == collocations_brute([r[:2] for r in rows], words, 4, 50)
    top = best_phrases(got, 3).collect()
    for lang in {r.lang for r in top}:
        mine = sorted((r for r in top if r.lang == lang), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1))
        every = sorted(((-x[7], -x[2], x[1].encode()) for x in collocations_brute([r[:2] for r in rows], words, 4, 50) if x[0] == lang))[:3]
        assert [(-r.score, -r.a, r.phrase.encode()) for r in mine] == every


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


def test_bitmaps_cross_blocks_and_stop_at_blanks():
    rng = np.random.default_rng(4)
    items = rng.integers(-1, 3, 5000)
    want = Counter()
    for k in (2, 3, 4):
        for i in range(len(items) - k + 1):
            if (items[i : i + k] >= 0).all():
                want[tuple(map(int, items[i : i + k]))] += 1
    got = {tuple(map(int, p)): int(n) for found, times in Bitmaps(items, 3).walk(4) for p, n in zip(found, times)}
    assert got == dict(want)
    assert len(Bitmaps(items, 3).block) <= 3 * (5000 // 64 + 1)


def digest(text):
    return hashlib.sha1((text or "").encode()).hexdigest()


PAGES = "page_id long, url string, html string, digest string, bytes long, type string"


def odd_pages():
    big, magic = "<p>" + "long " * 400, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.0\r\n tail " * 3
    rows = [(1, "http://a/", big), (2, "http://b/", big), (9, None, big), (9, "http://again/", big), (3, "http://c/\r\nX: y", "short"), (4, "http://c/", "short"), (5, "u", None), (6, "u", ""), (7, "u", magic), (8, "u", magic + big), (None, "u", big), (None, "u", "no id"), (10, "é", "WARC/1.1\r\n" + big), (11, "u", "WARC/1."), (12, "u", "漢字 \r\n\r\n" * 300)]
    return [(*r, "z", 1, "w") for r in rows]


def archived(rows, least=1000):
    """(page_id, bytes, digest, type, refers_to) by definition."""
    last = {}
    for i, _, html, *_ in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html, *_ in rows:
        n, first = len((html or "").encode()), last.get(html or "")
        other = n >= least and first is not None and i != first
        out.append((i, n, digest(html), "revisit" if other else "response", first if other else None))
    return sorted(out, key=str)


def back(spark, folder):
    rows = payloads_of(read_archives(spark, str(folder))).collect()
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:null>" else None
    return sorted(((number(r.record_id), r.payload_bytes, r.payload_digest, r.type, number(r.refers_to)) for r in rows), key=str)


@pytest.mark.parametrize("split", ["128m", "700b", "97b"])
def test_archives(spark, tmp_path, split):
    """Splits inside magics, headers and payloads, and payloads that hold whole records."""
    d = spark.createDataFrame(odd_pages(), PAGES).repartition(2)
    write_archives(d, f"{tmp_path}/w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        assert back(spark, tmp_path / "w") == archived(odd_pages())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archives_without_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEVERAL", 0)
    write_archives(spark.createDataFrame(odd_pages(), PAGES), f"{tmp_path}/w", least=3)
    assert back(spark, tmp_path / "w") == archived(odd_pages(), 3)


def test_archives_are_records(spark, tmp_path):
    """A plain reader that follows the declared lengths finds the same records and payloads."""
    write_archives(spark.createDataFrame(odd_pages(), PAGES).coalesce(1), f"{tmp_path}/w")
    raw = next((tmp_path / "w").glob("part-*")).read_bytes()
    at, heads = 0, []
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in raw[at:end].decode().split("\r\n")[1:])
        heads.append((at, head["WARC-Record-ID"]))
        at = end + 8 + int(head["Content-Length"])
    got = read_archives(spark, f"{tmp_path}/w", payload=True)
    assert sorted((r.offset, r.record_id) for r in got.collect()) == heads
    assert all(hashlib.sha1(r.payload).hexdigest() == r.digest and f"sha1:{r.digest}" == r.declared for r in got.where("type = 'response'").collect())


def test_archives_broken(spark, tmp_path):
    """The chain ends at a cut record and at bytes of no record; compressed files and empty folders are read."""
    import gzip

    rec = lambda k, body: f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    for name, raw in {"cut": rec(1, "a") + rec(2, "b" * 50)[:-40], "noise": rec(3, "c") + b"noise" + rec(4, "d"), "start": b"x" + rec(5, "e")}.items():
        (tmp_path / f"{name}.warc").write_bytes(raw)
    (tmp_path / "packed.warc.gz").write_bytes(gzip.compress(rec(6, "f")) + gzip.compress(rec(7, "g")))
    assert sorted(r.record_id[10:-1] for r in read_archives(spark, str(tmp_path)).collect()) == ["1", "3", "6", "7"]
    write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").count() == 0


def test_pointer_jumping(spark):
    """Chains of all lengths, and side chains that no start comes to."""
    rows = [("f", k, k + 1) for k in range(37)] + [("g", 0, 5), ("g", 5, 6), ("g", 3, 6), ("h", 1, 2)]
    got = {tuple(r) for r in warc._entries(spark.createDataFrame(rows, "file string, place long, next long")).collect()}
    assert got == {("f", k) for k in range(38)} | {("g", 0), ("g", 5), ("g", 6)}


def trie_brute(paths):
    """paths: conv_id -> list of (role, text)."""
    nodes = defaultdict(list)
    for c, p in paths.items():
        for k in range(len(p) + 1):
            nodes[tuple(p[:k])].append(c)
    out = []
    for k, m in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        kids = {x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k}
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below) for x in below)
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids), leaves, sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(np.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_prefix_trie(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 9), *range(100, 160), *range(201, 215), -3, -100, 300]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, None if t == 3 else t, ["user", "assistant", None][t % 3], ["yes", "no", "é漢", None, ""][int(rng.integers(0, 5))], "k", 1, 2))
    rows += [(300, t, "user", "long", "k", 1, 2) for t in range(150)] + [rows[0], rows[5], (None, 1, "user", "x", "k", 1, 2)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth string, k1 long, members long")
    want = trie_brute(rebuilt_brute(rows))
    got = prefix_trie(rebuilt(d))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.select(cols).collect()), key=str) == want
    assert prefix_trie(rebuilt(d.limit(0))).count() == 0


def test_prefix_trie_merges(spark, monkeypatch):
    """Many partial tries, a first turn that all share, equal conversations in several blocks; texts come with the nodes."""
    from wardscribe.llm import prefixes

    monkeypatch.setattr(prefixes, "FAN", 2)
    monkeypatch.setattr(prefixes, "BLOCK", 7)
    rows = [(c, t, "user", "hello" if t == 0 else f"t{c % (t + 1) if c % 3 else 0}") for c in range(300) for t in range(1 + c % 4)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(13)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = prefix_trie(conversations(d), texts=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    paths = defaultdict(list)
    for c, _, role, text in rows:
        paths[c].append((role, text))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=str) == trie_brute(paths)
    assert all((r.role, r.text) == (paths[r.conv_id][r.depth - 1] if r.depth else (None, None)) for r in got)
