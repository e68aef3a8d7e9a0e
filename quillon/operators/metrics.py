"""Evaluation: confusion matrix, accuracy, precision, recall, F1, regression errors, silhouette."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(actual, predicted, n) over the union of labels, with the cells that are zero."""
    cells = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n")).where("actual is not null and predicted is not null")
    labels = cells.select(F.col("actual").alias("label")).union(cells.select("predicted")).distinct()
    # classes by classes: the shape of the result itself
    grid = labels.select(F.col("label").alias("actual")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def wide(conf: DataFrame, labels: list) -> DataFrame:
    return conf.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))


def multilabel_accuracy(actual: Column, predicted: Column, novalue: float = 0.0) -> Column:
    """Of two arrays of labels: those that agree and are not `novalue`, over the sum of the real ones."""
    a, p = vec.vector(actual), vec.vector(predicted)
    return F.try_divide(vec.count_equal(a, p, novalue).cast("double"), vec.total(a))


def scores(conf: DataFrame, mode: str = "macro", positive=None) -> DataFrame:
    """(precision, recall, f1). Modes: binary (of `positive`, else the lowest label), macro, micro, and
    below_above: hits over hits and the cells below (precision) or above (recall) the diagonal."""
    hit, n = F.col("actual") == F.col("predicted"), F.col("n")
    if mode in ("micro", "below_above"):
        wrong = {"micro": (~hit, ~hit), "below_above": (F.col("actual") > F.col("predicted"), F.col("actual") < F.col("predicted"))}[mode]
        tp = F.sum(F.when(hit, n).otherwise(0))
        out = conf.agg(*(F.try_divide(tp.cast("double"), tp + F.sum(F.when(w, n).otherwise(0))).alias(name) for w, name in zip(wrong, ("precision", "recall"), strict=True)))
    else:
        by = conf.groupBy("predicted").agg(F.sum("n").alias("p")).withColumnRenamed("predicted", "label").join(conf.groupBy("actual").agg(F.sum("n").alias("a")).withColumnRenamed("actual", "label"), "label").join(conf.where(hit).select(F.col("actual").alias("label"), F.col("n").cast("double").alias("tp")), "label")
        each = by.select("label", F.try_divide("tp", "p").alias("precision"), F.try_divide("tp", "a").alias("recall"))
        if mode == "binary":
            if positive is None:
                out = each.agg(F.min_by("precision", "label").alias("precision"), F.min_by("recall", "label").alias("recall"))
            else:
                out = each.where(F.col("label") == positive).select("precision", "recall")
        elif mode == "macro":
            out = each.agg(F.when(F.count("precision") == F.count("*"), F.avg("precision")).alias("precision"), F.when(F.count("recall") == F.count("*"), F.avg("recall")).alias("recall"))
        else:
            raise ValueError(mode)
    p, r = F.col("precision"), F.col("recall")
    return out.select(p, r, F.try_divide(2 * p * r, p + r).alias("f1"))


def errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    d = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def matrix_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """(mse, rmse, mae) over all elements of two columns of vectors."""
    z = F.zip_with(vec.vector(actual), vec.vector(predicted), lambda a, p: a - p)
    sums = df.select(z.alias("d")).where("d is not null").select(F.size("d").alias("n"), vec.sum_squared(F.col("d")).alias("s"), F.aggregate("d", F.lit(0.0), lambda t, x: t + F.abs(x)).alias("a"))
    n = F.sum("n")
    return sums.agg(F.try_divide(F.sum("s"), n).alias("mse"), F.sqrt(F.try_divide(F.sum("s"), n)).alias("rmse"), F.try_divide(F.sum("a"), n).alias("mae"))


def silhouette(df: DataFrame, dim: int, row_id: str = "row_id", features: str = "features", cluster: str = "cluster", block: int = 1024) -> DataFrame:
    """(row_id, s): Euclidean silhouette over all pairs, in numpy blocks. A cluster of one has 0, one cluster null;
    rows without a vector or a cluster are left out.

    Rows are dealt to blocks; each pair of blocks gives every row its sum of distances to each cluster, so what is
    shuffled is rows times clusters, not pairs."""
    df = df.where(F.col(features).isNotNull() & F.col(cluster).isNotNull())
    n = df.count()
    blocks = max(1, -(-n // block))
    data = df.select(F.col(row_id).cast("long").alias("r"), F.col(cluster).cast("int").alias("c"), vec.vector(features).alias("x"), F.pmod(F.xxhash64(row_id), F.lit(blocks)).cast("int").alias("b"))
    left = data.select(F.lit(0).alias("side"), "r", "c", "x", F.col("b").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"))
    right = data.select(F.lit(1).alias("side"), "r", "c", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("i"), F.col("b").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        side, r, c = (table.column(k).to_numpy() for k in ("side", "r", "c"))
        x = np.array(table.column("x").to_pylist(), float).reshape(-1, dim)
        a, b = side == 0, side == 1
        d = np.sqrt(np.maximum(0, ((x[a][:, None, :] - x[b][None, :, :]) ** 2).sum(2))) if a.sum() * b.sum() * dim < 2e7 else np.stack([np.sqrt(((q - x[b]) ** 2).sum(1)) for q in x[a]])
        known = np.unique(c[b])
        sums = np.stack([d[:, c[b] == k].sum(1) for k in known], 1) if len(known) else np.zeros((a.sum(), 0))
        size = [int((c[b] == k).sum()) for k in known]
        m = len(known)
        return pa.table({"r": np.repeat(r[a], m), "own": np.repeat(c[a], m).astype(np.int32), "c": np.tile(known, a.sum()).astype(np.int32), "d": sums.ravel(), "n": np.tile(np.array(size, np.int64), a.sum())})

    parts = left.unionByName(right).groupBy("i", "j").applyInArrow(run, "r long, own int, c int, d double, n long")
    by = parts.groupBy("r", "own", "c").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    same = F.col("own") == F.col("c")
    agg = by.groupBy("r").agg(F.max(F.when(same, F.try_divide("d", F.col("n") - 1))).alias("a"), F.max(F.when(same, F.col("n"))).alias("size"), F.min(F.when(~same, F.col("d") / F.col("n"))).alias("b"))
    s = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("size") == 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return agg.select(F.col("r").alias(row_id), s.alias("s"))
