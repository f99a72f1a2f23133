"""The training-data pipeline over documents: five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wardscribe.llm.session import drop, scratch, shared_folder
from wardscribe.llm.stages import cut_repeats, drop_near_copies, drop_toxic, mix_sources, pack_sequences

STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: A learned score decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the last one's rows. What a stage wrote on the way goes once its rows are stored, its rows once the next stage's are."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            drop(spark, f"{folder}/{k - 1}")
    return docs
