"""op7 and op10: rows that chunks exchange are in proportion to the text, whatever the number of chunks; groups are opened by their bound."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("wardscribe.llm.queries")

from wardscribe.llm import jaccard, substrings  # noqa: E402


def texts(spark, n):
    """n documents of 40 words of their own, as a shared passage in each third one."""
    own = F.expr("transform(sequence(1, 40), k -> concat('d', id, 'w', k))")
    passage = F.array(*[F.lit(f"p{k}") for k in range(20)])
    words = F.concat(own, F.when(F.col("id") % 3 == 0, passage).otherwise(F.array().cast("array<string>")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))


def test_anchor_rows_grow_in_proportion(spark):
    def sent(n, chunks):
        d = texts(spark, n).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
        return d.select("chunk", "text").mapInArrow(substrings._anchors, "chunk long, a long").count()

    few, many = sent(100, 10), sent(10_000, 1000)
    assert 90 * few <= many <= 110 * few
    assert sent(100, 1000) <= 100 * 25  # never over the anchors that there are


def test_chunks_are_bounded_by_bytes_too(spark):
    d = texts(spark, 300)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0]
    assert substrings.chunks(d, 2000, 8_000_000) == 1 and substrings.chunks(d, 100, 8_000_000) == 3
    assert substrings.chunks(d, 2000, size // 10) >= 10 and substrings.chunks(d.limit(0), 10, 10) == 1


def test_only_qualifying_groups_are_opened(spark):
    """Pairs that are compared: none inside a group, none of groups whose union holds too little of a set."""
    rng = np.random.default_rng(8)
    rows, groups = [], []
    for g in range(30):
        base = rng.integers(0, 2**48, 100).astype(np.uint64)
        for k in range(20):
            t = base.copy()
            at = rng.choice(100, 3, replace=False)
            t[at] = rng.integers(0, 2**48, 3).astype(np.uint64)
            if k == 0 and g % 2:
                t[:96] = last[:96]  # a link over to the group before
            rows.append((g * 20 + k, 100, bytearray(jaccard.pack48(np.sort(t)))))
            groups.append((g * 20 + k, g * 20))
        last = base
    sets = spark.createDataFrame(rows, "doc long, n long, tokens binary")
    named = spark.createDataFrame(groups, "node long, component long")
    pairs = {tuple(r) for r in jaccard._group_pairs(sets, named, 85).collect()}
    value = {r[0]: set(jaccard.unpack48(bytes(r[2])).tolist()) for r in rows}
    near = {(a, b) for a in value for b in value if a // 20 < b // 20 and 100 * len(value[a] & value[b]) >= 85 * len(value[a] | value[b])}
    assert near <= pairs and all(a // 20 != b // 20 for a, b in pairs)
    assert near and len(pairs) <= 15 * 20


def test_template_documents_do_not_meet(spark):
    """Documents of 120 shared and 12 own words, each a group: what the joins make grows with their number, not with its square."""

    def made(n):
        shared = F.transform(F.sequence(F.lit(1), F.lit(120)), lambda k: F.concat(F.lit("s"), k))
        own = F.expr("transform(sequence(1, 12), k -> concat('d', id, 'w', k))")
        d = spark.range(n).select(F.col("id").alias("doc"), F.array_join(F.concat(shared, own), " ").alias("text")).toPandas()
        s = jaccard._Sets(pa.chunked_array([d["text"].tolist()], pa.string()), 4)
        rows = [(int(i), int(s.n[i]), bytearray(jaccard.pack48(s.tokens[s.at[i] : s.at[i + 1]]))) for i in range(n)]
        sets = spark.createDataFrame(rows, "doc long, n long, tokens binary")
        t = jaccard._prefix_rows(sets, 85).withColumn("grp", F.col("doc")).where("pos <= n - ceil(n * 85 / 100)")
        sizes = jaccard._rooms(t, 85).groupBy("token", "own", "partner").agg(F.count("*").alias("c"))
        meets = sizes.select("token", F.col("own").alias("partner"), F.col("partner").alias("own"), F.col("c").alias("other")).join(sizes, ["token", "own", "partner"])
        return meets.agg(F.sum(F.col("c") * F.col("other"))).first()[0] or 0, jaccard._group_pairs(sets, spark.createDataFrame([], "node long, component long"), 85).count()

    few, many = made(100), made(1600)
    assert many[0] <= 20 * max(few[0], 100) and few[1] == many[1] == 0
