"""Findings of round 3."""

import io
import re
import zipfile
from unittest import mock
from xml.sax.saxutils import escape

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardscribe.functions import lexicon as L
from wardscribe.functions import patterns as P
from wardscribe.operators import extract
from wardscribe.sources import files


@pytest.mark.parametrize("text, negated", [("añóno se", True), ("él,no", True), ("niñno x", True), ("nodo", False), ("no", True), ("_no", False), ("noſ noKnown", True), ("cánot", True), ("unKnown", False)])
def test_negation_takes_ascii_words_as_the_sql_does(spark, text, negated):
    import duckdb

    got = spark.createDataFrame([(text,)], "text string").select(F.col("text").rlike(P.edged(P.NEGATION))).first()[0]
    assert got == negated == duckdb.execute("select regexp_matches(?, ?)", [text, P.NEGATION]).fetchone()[0]


@pytest.mark.parametrize("text", ["dinámica", "dináká", "koté", "éko", "taK hai", "Kan"])
def test_cues_take_ascii_words_as_the_sql_does(spark, text):
    import duckdb

    got = spark.createDataFrame([(text,)], "text string").select(F.col("text").rlike(P.edged(P.HINGLISH))).first()[0]
    assert got == duckdb.execute("select regexp_matches(?, ?)", [text, P.HINGLISH]).fetchone()[0]


@pytest.mark.parametrize("name", ["normalization_log", "note_sentences", "vitals", "symptoms", "drug_mentions", "allergies"])
def test_arrays_are_computed_once_before_they_become_rows(spark, sf, name):
    from wardscribe.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter (size(" in line or "Filter ((size(" in line]


@pytest.mark.parametrize("text, digits", [("Six two and one thirty.", "39."), ("two hundred and five-six", "211"), ("zero and sixteenth", "zero and sixteenth"), ("a\u0001one\u0001 hundred", "a\u00011\u0001 100"), ("forty-one one forty hundred", "8200"), ("_one éone", "_one é1")])
def test_number_words(spark, text, digits):
    from wardscribe.functions.normalize import number_words

    assert spark.createDataFrame([(text,)], "text string").select(number_words(F.col("text"))).first()[0] == digits


def test_gate_of_edits_reads_the_fields_once(spark):
    from wardscribe.operators import slots

    s = spark.createDataFrame([(1, "a", "x", "RED"), (1, "b", "y", "YELLOW"), (2, "a", None, "RED"), (3, "a", "v", "GREEN"), (4, "a", "v", "RED")], "job_id long, key string, text string, color string")
    e = spark.createDataFrame([(1, "a", "z", 1), (1, "a", "x2", 2), (2, "a", None, 1), (3, "a", "v", 1), (4, "a", "w", 1), (9, "a", "w", 1)], "job_id long, key string, value string, ts int")
    for strict in (False, True):
        got, want = slots.gate_edits(s, e, strict), slots.gate(*slots.apply_edits(s, e), strict)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_gate_query_scans_the_sentences_four_times_at_most(spark, sf):
    from wardscribe.plans.queries import QUERIES

    plan = QUERIES["verify_gate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Generate posexplode" in line and "arrays_zip" in line for line in plan.splitlines()) <= 4


def test_clicks_find_the_words_that_the_interval_join_finds(spark):
    from wardscribe.operators import provenance

    seg = spark.createDataFrame([(1, 0, " one two  three", 0.2), (1, 1, "four", 1.5), (1, 2, "", 2.0), (2, 0, "five six", 0.21)], "job_id long, id int, text string, start double")
    c = spark.createDataFrame([(j, k, k * 0.04) for j in (1, 2, 3) for k in range(60)], "job_id long, click int, at double")
    rows = lambda df: sorted(map(tuple, df.select("job_id", "click", "word", "id", "pos").collect()))
    got = provenance.clicked(c, seg)
    assert rows(got) == rows(provenance.word_at(c, provenance.words(seg))) and got.count() > 40
    assert "second" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["sentence_segments", "clicked_words"])
def test_segments_are_not_broadcast(spark, sf, name):
    from wardscribe.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("share", [0.2, 0.45, 0.55])
def test_what_articles_have_is_judged_over_the_host_whatever_the_shards(spark, share):
    """a line in just more or less than half of the host's articles, or in four of few, next to copies of an article without it."""
    from wardscribe.llm import html

    own = lambda i: " ".join(f"own{i}x{j}" for j in range(12))
    page = lambda i, line: f"<article><p>{own(i)}</p>{line}</article>"
    line = "<p>Join our list today and never miss a single word of ours</p>"
    rows = [(i, f"http://h.org/{i}", page(i, line if i < share * 60 else "")) for i in range(60)]
    rows += [(100 + i, f"http://h.org/{100 + i}", page(59, "")) for i in range(40)]
    rows += [(200 + i, f"http://few.org/{i}", page(i, line if i < 4 else "")) for i in range(6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda **k: {r.page_id: r.text for r in html.main_text(d, **k).collect()}
    whole = texts()
    kept = " Join our list today and never miss a single word of ours"
    assert all(whole[i] == own(i) + (kept if share < 0.5 and i < share * 60 else "") for i in range(60))
    assert all(whole[200 + i] == own(i) + (kept if i < 4 else "") for i in range(6))
    assert texts(shard=2) == texts(shard=7) == texts(shard=30) == whole


def test_pages_of_all_shards_are_parsed_once(spark, sf):
    from wardscribe.llm import html

    d = html.main_text(spark.read.parquet(f"{sf}/pages.parquet"), shard=5)
    d.collect()
    text = d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert text.count("MapInArrow parse") == 1 and text.count("ReusedExchange") >= 3


def inner_join_rows(df):
    """Rows that each inner join of a collected query made."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if kind.endswith("JoinExec") and p.joinType().toString() == "Inner":
                found.append(p.metrics().get("numOutputRows").get().value())
            todo.extend(p.children().apply(k) for k in range(p.children().size()))
    return found


def test_pairs_that_do_not_link_are_not_multiplied_by_their_tokens(spark):
    """op10, pipeline: sets that share 140 of 200 tokens, below the limit, each met at its first tokens only."""
    import numpy as np

    from wardscribe.llm import jaccard as J
    from wardscribe.llm.textkit import pack48

    rng, k = np.random.default_rng(5), 60
    token = lambda n: rng.integers(0, 2**48, n, dtype=np.uint64)
    pair, ring = [token(140) for _ in range(k)], [token(60) for _ in range(2 * k)]
    sets = [(d, 200, bytearray(pack48(np.concatenate((pair[d // 2], ring[(d + 1) // 2 * 2 % (2 * k)]))))) for d in range(2 * k)]
    got = J._group_pairs(spark.createDataFrame(sets, "doc long, n long, tokens binary"), spark.createDataFrame([], "node long, component long"), 85)
    n = len({(r.a, r.b) for r in got.collect()} & {(2 * i, 2 * i + 1) for i in range(k)})
    assert n > k // 2
    assert max(inner_join_rows(got)) <= 25 * n


def test_anchors_are_short_and_one_too_many_removes_nothing():
    """op7: anchors travel as 40 bits; windows that a chance hit adds are compared in full."""
    import numpy as np
    import pyarrow as pa

    from wardscribe.llm import substrings as S

    texts = [" ".join(f"w{(i * 7 + d * 3) % 50}" for i in range(60)) for d in range(6)]
    rows = {"doc_id": pa.array(range(6), pa.int64()), "text": pa.array(texts), "chunk": pa.array([0] * 6, pa.int64())}
    sent = pa.Table.from_batches(S._anchors(iter([pa.RecordBatch.from_pydict(rows)])))["a"].to_numpy()
    assert len(sent) and sent.min() >= 0 and sent.max() < 2**40
    few, every = S._Chunk(pa.table(rows)), S._Chunk(pa.table(rows))
    few.candidates()
    every.candidates(anchors=every.anchors)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert (few.removed(none) == every.removed(none)).all() and set(sent) == set(every.anchors)


def test_texts_are_shuffled_once_for_near_copies(spark, sf, monkeypatch):
    """pipeline, op10: prefixes are sent and kept from one shuffle of the texts, and the distinct adds none."""
    from wardscribe.llm import jaccard as J
    from wardscribe.llm import stages

    plans = []
    real = J.cut

    def seen(df):
        out = real(df)
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(J, "cut", seen)
    out = stages.drop_near_copies(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    out.collect()
    assert max(p.count("FlatMapCoGroupsInArrow") for p in plans) == 2
    assert "hashpartitioning(row" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text", ["One, two. Give five hundred! ok? and six\u0001seven. Eight", "Give dolo, 500 mg. Ten. ", "No one. and. x"])
def test_digits_beside_sentences_are_those_of_the_whole_text(spark, text):
    """ends are marked once; the sentences of the digits and of the dictated text agree in number and place, and only queries that ask for text make digits."""
    from wardscribe.functions.normalize import number_words
    from wardscribe.operators import extract

    notes = spark.createDataFrame([(1, text)], "job_id long, text string")
    joined = notes.select(F.regexp_replace("text", "dolo, 500", "dolo 500").alias("t"))
    want = joined.select(extract.sentence_array(number_words("t"))).first()[0]
    s = extract.sentences(notes)
    assert [r.text for r in s.orderBy("sent").collect()] == want
    assert "hundred" not in s.select("raw", "negated")._jdf.queryExecution().optimizedPlan().toString()
    assert str(s.where("text rlike '[0-9]'")._jdf.queryExecution().optimizedPlan()).count("aggregate(") <= 4


def test_documents_are_what_zipfile_writes():
    """the shared parts of a document are made once; its bytes are those of a zip file written part by part."""
    lines = [["a: one\x07\x00", None, "", "x < y & z", "%s"], [], None, ["बुखार\nb"], ["x" * 70_000]]
    with mock.patch.object(files.zipfile, "ZipFile", side_effect=AssertionError("a document packs its parts by itself")):
        got = [bytes(b) for b in files.docx.func(pd.Series(lines))]
    for some, one in zip(lines, got):
        clean = [re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x or "") for x in some or []]
        body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in clean)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in {**files._DOCX, "word/document.xml": files._DOCUMENT % body}.items():
                z.writestr(zipfile.ZipInfo(name), content)
        assert one == out.getvalue()


ODD = [
    (-1, None), (-2, ""), (-4, "Denies chest pain. chest pain, pain; breathlessness not present! no penicillin 5 mg. not to eggs allergy to eggs and allergy to eggs"),
    (-3, "No penicillin or sulfa allergy. Allergy to penicillin, denies allergy to eggs. Give dolo, 650 mg TDS plus crocin 5 ml along with xyzzy 4 g. Give dolo five hundred mg."),
]


def test_a_row_of_a_note_holds_what_the_long_tables_hold(spark, sf):
    """F7, F8, F12, F13, F15, F17."""
    from wardscribe.plans import synth

    notes = synth.notes(spark, sf).where("job_id < 400").select("job_id", "text").unionByName(spark.createDataFrame(ODD, "job_id long, text string"))
    rows, sents = extract.noted(notes).cache(), extract.sentences(notes)
    long = {
        "symptoms": extract.symptoms(sents).drop("raw", "confidence", "color"), "vitals": extract.vitals(sents).drop("raw"), "allergies": extract.allergies(sents),
        "drugs": extract.resolve_drugs(extract.drug_mentions(sents), L.aliases(spark)),
    }
    for name, table in long.items():
        want = sorted(map(repr, table.collect()))
        assert want and sorted(map(repr, extract.rows_of(rows, name).select(*table.columns).collect())) == want


@pytest.mark.parametrize("name", ["note_documents", "note_slots", "proof_strips", "fhir_bundles", "inline_words", "denied_lines", "drug_cells"])
def test_a_note_stays_one_row_until_its_lines_are_whole(spark, sf, name):
    from wardscribe.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("FileScan") == 1
