"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of docs.

docs has doc_id, text and source, and any other columns, whatever their names:
the operators' own columns are kept apart from them. Every stage returns the
columns of docs, but the last, which returns the pieces of sequences. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under its threshold; labels are read from sf_dir.

    Null and empty texts score as a text without any feature and stay, unless
    nearly all labels are toxic. Repeated rows stay or go together. Rows without
    a doc_id are scored like others. Without labels of both kinds nothing is
    learned: all stay where no toxic label is known.
    """
    from .toxicity import THRESHOLD, held_out, scored, train

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    clean = scored(docs, train(docs, labels)).where(F.col("_toxicity") < THRESHOLD)
    return clean.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more: the smallest doc_id.

    Rows without a doc_id stay. Of rows that are equal in all columns one stays;
    rows of one doc_id with other texts or columns all stay with it. Null and
    empty texts link with nothing and stay.
    """
    from .jaccard import jaccard_components

    c = jaccard_components(docs.select("doc_id", "text"), words=5, percent=80)
    kept = c.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.where("doc_id is not null").select(F.struct(*_columns(docs)).alias("row"), F.col("doc_id").alias("_id"))
    # equal rows have one id, by which the join has dealt them: with the id among its keys the distinct shuffles no row again
    one = rows.join(kept, F.col("_id") == F.col("_kept"), "left_semi").select("_id", "row").distinct().select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a 13-word window of an earlier document has already; n_chars, if there, follows.

    Documents that lose all words go; null and empty texts have none to lose and
    stay as they are. Rows with equal doc_id do not cut each other. A null
    doc_id counts as the latest.
    """
    from .substrings import dedup_substrings

    d = dedup_substrings(docs, texts=True).where("n_removed < n_words or n_removed = 0")
    cols = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return d.select(*[cols[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated as often as the mix takes them: twice, once or not at all.

    Null sources are one source; null and empty texts have no words and are
    taken while budget is left; repeated rows are drawn each.
    """
    from .mixing import mix

    m = mix(docs, keep=True)
    return m.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows of docs, packed into sequences of 2,048 tokens.

    Null and empty texts are one token, a document's end. Repeated rows are
    packed each; a null doc_id stays null.
    """
    import public_tokenizers

    from .packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]
