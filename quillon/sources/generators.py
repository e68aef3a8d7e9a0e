"""Synthetic tables: every value is a function of its row's number and a seed."""

from __future__ import annotations

import hashlib
import math
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import rng
from quillon.functions.scalar import SURFACES
from quillon.operators.frame import number_rows

ID = F.col


def _noise(seed, scale: float) -> Column:
    return rng.uniform(F.col("row_id"), seed, -scale, scale) if scale else F.lit(0.0)


def _rows(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "row_id")


def moons(spark: SparkSession, n: int, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """Two interleaved half circles, labels in turn; n is made even."""
    n += n % 2
    i, y = F.floor(F.col("row_id") / 2), (F.col("row_id") % 2).cast("int")
    t = i * (math.pi / max(1, n // 2 - 1))
    x0, x1 = F.when(y == 0, F.cos(t)).otherwise(1 - F.cos(t)), F.when(y == 0, F.sin(t)).otherwise(0.5 - F.sin(t))
    return _rows(spark, n).select("row_id", (x0 + _noise(f"{seed}x", noise)).alias("x0"), (x1 + _noise(f"{seed}y", noise)).alias("x1"), y.alias("label"))


def circles(spark: SparkSession, n: int, noise: float = 0.0, factor: float = 0.75, seed: int = 0) -> DataFrame:
    n += n % 2
    i, y = F.floor(F.col("row_id") / 2), (F.col("row_id") % 2).cast("int")
    t, r = i * (2 * math.pi / max(1, n // 2)), F.when(y == 0, F.lit(1.0)).otherwise(F.lit(factor))
    return _rows(spark, n).select("row_id", (r * F.cos(t) + _noise(f"{seed}x", noise)).alias("x0"), (r * F.sin(t) + _noise(f"{seed}y", noise)).alias("x1"), y.alias("label"))


def blobs(spark: SparkSession, n: int, blobs_: int, dim: int, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """Uniform noise around a centre for each blob; n rounded up to a multiple."""
    n = -(-n // blobs_) * blobs_
    k = (F.col("row_id") % blobs_).cast("int")
    centre = lambda j: rng.uniform(F.concat_ws("/", k.cast("string"), j.cast("string")), f"{seed}c") * blobs_
    x = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: centre(j) + rng.uniform(F.concat_ws("/", F.col("row_id").cast("string"), j.cast("string")), seed, -noise / 2, noise / 2))
    return _rows(spark, n).select("row_id", x.alias("features"), k.alias("label"))


def regression(spark: SparkSession, n: int, surface: str, low: float, high: float, seed: int = 0) -> DataFrame:
    x, y = rng.uniform(F.col("row_id"), f"{seed}x", low, high), rng.uniform(F.col("row_id"), f"{seed}y", low, high)
    return _rows(spark, n).select("row_id", x.alias("x0"), y.alias("x1")).withColumn("y", SURFACES[surface](F.col("x0"), F.col("x1")))


def swiss_roll(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    t = 1.5 * math.pi * (1 + 2 * rng.uniform(F.col("row_id"), f"{seed}t"))
    return _rows(spark, n).withColumn("t", t).select("row_id", "t", (F.col("t") * F.cos("t")).alias("x0"), (21 * rng.uniform(F.col("row_id"), f"{seed}u")).alias("x1"), (F.col("t") * F.sin("t")).alias("x2"))


def s_curve(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    t = 3 * math.pi * (rng.uniform(F.col("row_id"), f"{seed}t") - 0.5)
    return _rows(spark, n).withColumn("t", t).select("row_id", "t", F.sin("t").alias("x0"), (2 * rng.uniform(F.col("row_id"), f"{seed}u")).alias("x1"), (F.signum("t") * (F.cos("t") - 1)).alias("x2"))


def binary_series(spark: SparkSession, n: int, t1: int = 3, t2: int = 8, seed: int = 0) -> DataFrame:
    """Each bit depends on those t1 and t2 before it: one pass that remembers the last of them."""

    def run(arrow):
        for _ in arrow:
            past = deque([0] * max(t1, t2), max(t1, t2))
            for a in range(0, n, 1 << 16):
                bits = []
                for t in range(a, min(n, a + (1 << 16))):
                    u = int(hashlib.md5(f"{t}:{seed}".encode()).hexdigest()[:8], 16) / rng.MOST
                    bits.append(int(u < 0.5 + 0.5 * past[-t1] - 0.25 * past[-t2]))
                    past.append(bits[-1])
                yield pa.RecordBatch.from_pydict({"t": pa.array(range(a, a + len(bits)), pa.int32()), "x": pa.array(bits, pa.int32())})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "t int, x int")


def wave(spark: SparkSession, n: int, noise: float = 0.0, resolution: float = 10.0, seed: int = 0) -> DataFrame:
    return _rows(spark, n).select("row_id", (F.sin((F.col("row_id") + 1) / resolution) + rng.uniform(F.col("row_id"), seed, 0, noise)).alias("v"))


def sequence(spark: SparkSession, n: int, start: float, step: float) -> DataFrame:
    return _rows(spark, n).select("row_id", (start + step * F.col("row_id")).alias("v"))


def overwrite(x: Column, row_id: Column, low: float, high: float, ratio: float, seed: int = 0) -> Column:
    """A share of values replaced by uniform ones."""
    return F.when(rng.uniform(row_id, f"{seed}r") < ratio, rng.uniform(row_id, seed, low, high)).otherwise(x)


def label_noise(df: DataFrame, label: str, classes: int, ratio: float, one_target: bool = False, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """noisy: the first `ratio` of each class's rows get a wrong label, one for the class or one for each row. Rows are
    numbered by class and id in a distributed sort; a class is nowhere gathered."""
    placed = number_rows(df, F.col(label), F.col(row_id), name="_pos")
    ends = placed.groupBy(F.col(label).alias("_class")).agg(F.min("_pos").alias("_first"), F.floor(F.count("*") * ratio).alias("_some"))  # one row a class
    shift = rng.integer(F.col(label) if one_target else F.col(row_id), 1, classes - 1, seed)
    noisy = F.when(F.col("_pos") - F.col("_first") < F.col("_some"), (F.col(label) + shift) % classes).otherwise(F.col(label)).cast("int")
    return placed.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("_class"))).select(*df.columns, noisy.alias("noisy"))


def ascii_art(spark: SparkSession, art: str, marks: dict[str, int]) -> DataFrame:
    """(x, y, label) of the marks in a drawing."""
    lines = spark.createDataFrame([(art,)], "art string").select(F.posexplode(F.split("art", "\n")).alias("y", "line"))
    cells = lines.select("y", F.posexplode(F.split("line", "")).alias("x", "mark")).where(F.col("mark").isin(*marks))
    label = F.coalesce(*(F.when(F.col("mark") == m, v) for m, v in marks.items()))
    return cells.select("x", "y", label.alias("label"))


def truth_table(spark: SparkSession, kind: str) -> DataFrame:
    f = {"or": lambda a, b: a | b, "xor": lambda a, b: a ^ b}[kind]
    return spark.createDataFrame([(float(a), float(b), f(a, b)) for a in (0, 1) for b in (0, 1)], "x0 double, x1 double, y int")


def linear_set(spark: SparkSession, margin: int = 1, side: int = 10) -> DataFrame:
    """(x, y, label) of a square grid on both sides of its diagonal, but for cells within the margin of it."""
    cells = spark.range(side * side).select((F.col("id") % side).cast("int").alias("x"), F.floor(F.col("id") / side).cast("int").alias("y"))
    return cells.where(F.abs(F.col("x") - F.col("y")) >= margin).select("x", "y", (F.col("x") > F.col("y")).cast("int").alias("label"))


# Monthly sales of a shampoo over three years, a published series.
SHAMPOO = [
    266.0, 145.9, 183.1, 119.3, 180.3, 168.5, 231.8, 224.5, 192.8, 122.9, 336.5, 185.9,
    194.3, 149.5, 210.1, 273.3, 191.4, 287.0, 226.0, 303.6, 289.9, 421.6, 264.5, 342.3,
    339.7, 440.4, 315.9, 439.3, 401.3, 437.4, 575.5, 407.6, 682.0, 475.3, 581.3, 646.9,
]


def shampoo(spark: SparkSession) -> DataFrame:
    """(t, v)"""
    return spark.createDataFrame(list(enumerate(SHAMPOO)), "t int, v double")
