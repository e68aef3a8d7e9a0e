"""Descriptive statistics; aggregates combine before their shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import vec

from .frame import matrix


def summary(df: DataFrame, columns: list[str], alpha: float = 0.0) -> DataFrame:
    """(name, n, total, squares, mean, least, most, var_pop, var_samp, dev_pop, dev_samp), one row for each column."""
    one = lambda c: F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.sum(F.col(c).cast("double")).alias("total"), F.sum(F.pow(F.col(c) + alpha, F.lit(2))).alias("squares"), F.avg(c).alias("mean"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("most"), F.var_pop(c).alias("var_pop"), F.var_samp(c).alias("var_samp"), F.stddev_pop(c).alias("dev_pop"), F.stddev_samp(c).alias("dev_samp"))
    return df.agg(F.array(*(one(c) for c in columns)).alias("all")).select(F.explode("all").alias("s")).select("s.*")


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """(bin, n, low, high): equal widths, the largest value in the last bin, empty bins kept; constant data in bin 0."""
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col("x") - F.col("lo"), width)))).cast("int")
    counts = x.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # ends: one row
    grid = ends.select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"))


def graphic(hist: DataFrame, width: int = 40) -> DataFrame:
    """A text bar for each bin."""
    most = hist.agg(F.max("n").alias("most"))
    return hist.crossJoin(F.broadcast(most)).select("bin", "n", F.expr(f"repeat('█', cast(coalesce(try_divide(n * {width}, most), 0) as int))").alias("bar"))


def _moments(df: DataFrame, dim: int, features: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and centred products in one pass: each task has its own, which meet in a tree."""
    data = df.select(vec.vector(features).alias("x")).where("x is not null")
    schema = "k long, n long, mean binary, products binary"

    def out(n, mean, products, k=0):
        return {"k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary()), "products": pa.array([products.tobytes()], pa.binary())}

    def together(parts):
        n, mean, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for m, mean_, products_ in parts:
            d, all_ = mean_ - mean, n + m
            products += products_ + np.outer(d, d) * (n * m / all_)
            mean, n = mean + d * (m / all_), all_
        return n, mean, products

    def run(arrow):
        def parts():
            for b in arrow:
                if b.num_rows:
                    x = matrix(b.column(0), dim)
                    mean = x.mean(0)
                    yield len(x), mean, (x - mean).T @ (x - mean)

        n, mean, products = together(parts())
        if n:
            yield pa.RecordBatch.from_pydict(out(n, mean, products, TaskContext.get().partitionId()))

    def add(table: pa.Table) -> pa.Table:
        rows = zip(table.column("n").to_pylist(), table.column("mean").to_pylist(), table.column("products").to_pylist(), strict=True)
        return pa.table(out(*together((n, np.frombuffer(m), np.frombuffer(p).reshape(dim, dim)) for n, m, p in rows)))

    sums = data.mapInArrow(run, schema).groupBy(F.pmod("k", F.lit(256))).applyInArrow(add, schema)
    r = sums.groupBy(F.lit(0).alias("all")).applyInArrow(add, schema).first()
    if r is None:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    return r.n, np.frombuffer(r.mean), np.frombuffer(r.products).reshape(dim, dim)


def moments(df: DataFrame, dim: int, features: str = "features") -> tuple[np.ndarray, np.ndarray]:
    """Means and the sample's covariance, of one pass; zeros for no rows, and covariances of one row are NaN."""
    n, mean, products = _moments(df, dim, features)
    return mean, products / (n - 1) if n > 1 else np.full((dim, dim), np.nan if n else 0.0)


def covariance(df: DataFrame, dim: int, features: str = "features") -> DataFrame:
    """(i, j, cov), of the sample; null where there are fewer than two rows."""
    s = moments(df, dim, features)[1]
    rows = [(i, j, None if np.isnan(x) else float(x)) for (i, j), x in np.ndenumerate(s)]
    return df.sparkSession.createDataFrame(rows, "i long, j long, cov double")


def column_means(df: DataFrame, dim: int, features: str = "features") -> list[float]:
    """The means of `dim` features."""
    v = vec.vector(features)
    row = df.agg(*(F.avg(F.element_at(v, j + 1)).alias(f"m{j}") for j in range(dim))).first()
    return [float(x) if x is not None else 0.0 for x in row]


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def population(df: DataFrame, fitness: str = "fitness") -> DataFrame:
    return df.agg(F.min(fitness).alias("worst"), F.avg(fitness).alias("mean"), F.max(fitness).alias("best"))
