"""Permutations, splits, folds and batches, all by hashes of ids: equal on every run and partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import rng

from .frame import number_rows


def shuffled(df: DataFrame, row_id: str = "row_id", seed: int = 0, name: str = "pos") -> DataFrame:
    """Each row's place in a random permutation."""
    return number_rows(df.withColumn("_key", rng.key(F.col(row_id), seed)), F.col("_key"), F.col(row_id), name=name).drop("_key")


def shuffle_between_groups(df: DataFrame, group: int, row_id: str = "row_id", seed: int = 0, name: str = "pos") -> DataFrame:
    """Rows of the same offset in their group of `group` change places at random."""
    offset = F.col(row_id) % group
    placed = number_rows(df.withColumn("_offset", offset).withColumn("_key", rng.key(F.col(row_id), seed)), F.col("_offset"), F.col("_key"), F.col(row_id), name="_n")
    n = df.count()
    # rows with smaller offsets, when ids are 0 .. n - 1
    before = F.col("_offset") * F.lit(n // group) + F.least(F.col("_offset"), F.lit(n % group))
    return placed.withColumn(name, (F.col("_n") - before) * group + F.col("_offset")).drop("_offset", "_key", "_n")


def split(df: DataFrame, train: float | int, position: str = "pos", total: int | None = None) -> DataFrame:
    """is_train for the first `train` rows (or share of them, rounded down, one at least)."""
    if isinstance(train, float):
        total = df.count() if total is None else total
        train = max(1, int(total * train))
    return df.withColumn("is_train", F.col(position) < train)


def train_test(df: DataFrame, train: float | int, position: str = "pos", total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows to train with and those to test with."""
    both = split(df, train, position, total)
    return both.where("is_train").drop("is_train"), both.where("NOT is_train").drop("is_train")


def k_fold(df: DataFrame, k: int, position: str = "pos", total: int | None = None) -> DataFrame:
    """fold in which a row is tested; the rows beyond k equal folds are never tested (-1)."""
    total = df.count() if total is None else total
    size = total // k
    if size < 1:
        raise ValueError(f"{total} rows are too few for {k} folds")
    fold = F.floor(F.col(position) / size)
    return df.withColumn("fold", F.when(fold < k, fold).otherwise(-1))


def mini_batches(df: DataFrame, size: int, position: str = "pos", total: int | None = None) -> DataFrame:
    """batch of each row; what is left over joins the last."""
    total = df.count() if total is None else total
    return df.withColumn("batch", F.least(F.floor(F.col(position) / size), F.lit(max(1, total // size) - 1)))


def epoch_order(df: DataFrame, strategy: str, epoch: int, row_id: str = "row_id", seed: int = 48) -> DataFrame:
    """pos by strategy: none, deterministic (the same permutation each epoch) or stochastic."""
    if strategy == "none":
        return df.withColumn("pos", F.col(row_id).cast("long"))
    if strategy not in ("deterministic", "stochastic"):
        raise ValueError(strategy)
    return shuffled(df, row_id, seed if strategy == "deterministic" else seed + 1 + epoch)
