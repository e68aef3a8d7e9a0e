"""A corpus pipeline of five operators; every stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.byte_bpe import encode_stage
from quillon.llm.common import new_path
from quillon.llm.decontaminate import decontaminate_stage
from quillon.llm.simhash import simhash_stage
from quillon.llm.substring_dedup import substring_stage
from quillon.llm.toxicity import toxicity_stage


#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("substring_dedup", substring_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", encode_stage),
]

#: SQL can express neither the classifier nor the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
