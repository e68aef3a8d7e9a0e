"""Queries by name, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import vec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, features, label) of all embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), vec.vector("embedding").alias("features"), "label")


#: The same in SQL, and in entries.
VECTORS = "(SELECT vec_id AS row_id, embedding::DOUBLE[] AS features, label FROM embeddings)"
ENTRIES = f"(SELECT row_id AS i, (generate_subscripts(features, 1) - 1)::INTEGER AS j, unnest(features) AS v FROM {VECTORS})"
#: The hash uniform of a text key.
UNIFORM = "(('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT / 4294967295.0::DOUBLE)"


def uniform(key: str, seed, low: float = 0.0, high: float = 1.0) -> str:
    u = UNIFORM.format(f"({key})::VARCHAR", seed)
    return u if (low, high) == (0.0, 1.0) else f"({low}::DOUBLE + {u} * {high - low}::DOUBLE)"


def r6(c) -> object:
    """To six places, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


DIM = 64
