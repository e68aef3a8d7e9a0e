"""Rows and matrices: selection, stacking, gathering and dense algebra on (row_id, features) DataFrames.

Rows have no order of their own: every operator takes the id column that stands for the position. Matrices have
two forms, rows (row_id, features ARRAY<DOUBLE>) and entries (i, j, v).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vec


def number_rows(df: DataFrame, *order: Column, name: str = "row_id") -> DataFrame:
    """Consecutive numbers from 0 in the given order, without a single-partition sort: a range-partitioned sort,
    the sizes of its partitions (as many rows as partitions), and each row's place in its own."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    out = placed.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


# ---------------------------------------------------------------- selection


def select_value(df: DataFrame, column: str, value, row_id: str = "row_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(value)).select(row_id)


def select_equal(df: DataFrame, a: str, b: str, row_id: str = "row_id") -> DataFrame:
    return df.where(F.col(a) == F.col(b)).select(row_id)


def select_not_equal(df: DataFrame, a: str, b: str, row_id: str = "row_id") -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(row_id)


def slice_rows(df: DataFrame, start: int, n: int, row_id: str = "row_id", total: int | None = None) -> DataFrame:
    """Rows start .. start + n - 1, numbered from 0. A negative start counts from the end of `total` rows."""
    if start < 0:
        if total is None:
            total = df.count()
        start += total
    if start < 0 or n < 0:
        raise ValueError(f"no such rows: {start}, {n}")
    return df.where(F.col(row_id).between(start, start + n - 1)).withColumn(row_id, F.col(row_id) - start)


def gather(df: DataFrame, index: DataFrame, row_id: str = "row_id", pos: str = "pos") -> DataFrame:
    """index (pos, row_id): those rows, duplicates kept, numbered by pos."""
    return index.join(df, row_id).drop(row_id).withColumnRenamed(pos, row_id)


def mask_rows(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def exclude_rows(df: DataFrame, index: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.join(index.select(row_id), row_id, "left_anti")


def group_select(df: DataFrame, chain: DataFrame, group: int, row_id: str = "row_id") -> DataFrame:
    """chain (g, bit): the rows g * group .. g * group + group - 1 of each g whose bit is set."""
    return df.withColumn("g", F.floor(F.col(row_id) / group)).join(chain.where("bit = 1").select(F.col("g").cast("long").alias("g")), "g").drop("g")


def create_mask(df: DataFrame, index: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(row_id, mask) of all rows."""
    marked = index.select(row_id).distinct().withColumn("mask", F.lit(True))
    return df.select(row_id).join(marked, row_id, "left").select(row_id, F.coalesce("mask", F.lit(False)).alias("mask"))


def window_select(df: DataFrame, points: DataFrame, width: float, label: str = "label", value: str = "value") -> DataFrame:
    """Rows whose value is within `width` of a point (label, p) of their class: a band semi-join by class and bins,
    twice as wide, of which a point is in its own and both neighbours."""
    bin_of = lambda c: F.rint(c / (2 * width)) if width > 0 else c
    near = points.select(F.col("label").alias("_label"), F.col("p").alias("_p"), F.explode(F.array(*(bin_of(F.col("p")) + k for k in ((-1.0, 0.0, 1.0) if width > 0 else (0.0,))))).alias("_bin"))
    cond = (df[label] == near["_label"]) & (bin_of(df[value]) == near["_bin"]) & (F.abs(df[value] - near["_p"]) <= width)
    return df.join(near, cond, "left_semi")


# ---------------------------------------------------------------- stacking


def append(a: DataFrame, b: DataFrame, row_id: str = "row_id", n: int | None = None) -> DataFrame:
    """Rows of b after the n rows of a."""
    n = a.count() if n is None else n
    return a.unionByName(b.withColumn(row_id, F.col(row_id) + n))


vstack = append


def hstack(a: DataFrame, b: DataFrame, row_id: str = "row_id", features: str = "features") -> DataFrame:
    right = b.select(F.col(row_id), F.col(features).alias("_right"))
    return a.join(right, row_id).withColumn(features, F.concat(features, "_right")).drop("_right")


def drop_columns(df: DataFrame, positions: list[int]) -> DataFrame:
    """Columns by place, from the end if negative; every place must be there."""
    names = df.columns
    if bad := [p for p in positions if not -len(names) <= p < len(names)]:
        raise ValueError(f"no such columns: {bad}")
    gone = {p % len(names) for p in positions}
    return df.select(*(c for i, c in enumerate(names) if i not in gone))


def swap_rows(df: DataFrame, r1: int, r2: int, row_id: str = "row_id") -> DataFrame:
    return df.withColumn(row_id, F.when(F.col(row_id) == r1, r2).when(F.col(row_id) == r2, r1).otherwise(F.col(row_id)))


def uniques(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """(value, first): distinct values with the row that has them first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.min(row_id).alias("first"))


def find_first(df: DataFrame, cond: Column, row_id: str = "row_id", start: int = 0) -> DataFrame:
    return df.agg(F.coalesce(F.min(F.when(cond & (F.col(row_id) >= start), F.col(row_id))), F.lit(-1)).alias("first"))


def find_last(df: DataFrame, cond: Column, row_id: str = "row_id") -> DataFrame:
    return df.agg(F.coalesce(F.max(F.when(cond, F.col(row_id))), F.lit(-1)).alias("last"))


def find_random(df: DataFrame, cond: Column, n: int, row_id: str = "row_id", seed: int = 0) -> DataFrame:
    """found: the first match at or after a random row of n, else the last before it; -1 if none."""
    k = int(hashlib.md5(f"0:{seed}".encode()).hexdigest()[:8], 16) % max(1, n)
    after, before = F.min(F.when(cond & (F.col(row_id) >= k), F.col(row_id))), F.max(F.when(cond & (F.col(row_id) < k), F.col(row_id)))
    return df.agg(F.coalesce(after, before, F.lit(-1)).alias("found"))


def rearrange(df: DataFrame, index: DataFrame, row_id: str = "row_id") -> DataFrame:
    """index (part, pos, row_id): the rows of part after part, each in its order of pos."""
    placed = number_rows(index, F.col("part"), F.col("pos"), name="_new").select(F.col("_new").alias("pos"), row_id)
    return gather(df, placed, row_id)


def cube_sum(e: DataFrame) -> DataFrame:
    """(y, x, v): slices (z, y, x, v) added up."""
    return e.groupBy("y", "x").agg(F.sum("v").alias("v"))


# ---------------------------------------------------------------- matrices


def entries(df: DataFrame, row_id: str = "row_id", features: str = "features") -> DataFrame:
    """(i, j, v) of a matrix in rows."""
    return df.select(F.col(row_id).cast("long").alias("i"), F.posexplode(vec.vector(features)).alias("j", "v"))


def rows(e: DataFrame) -> DataFrame:
    """Rows of a matrix in entries; a row is gathered whole."""
    return e.groupBy(F.col("i").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("features"))


def transpose(e: DataFrame) -> DataFrame:
    return e.select(F.col("j").cast("long").alias("i"), F.col("i").alias("j"), "v")


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two matrices in entries; sums combine before their shuffle."""
    x, y = a.select(F.col("i"), F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), F.col("j"), F.col("v").alias("y"))
    return x.join(y, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def outer(u: DataFrame, v: DataFrame) -> DataFrame:
    """(i, j, v) of u (i, u) times v (j, v): every element with every other, which is the result itself."""
    return u.select("i", "u").crossJoin(v.select("j", "v")).select("i", "j", (F.col("u") * F.col("v")).alias("v"))


def outer_rows(df: DataFrame, a: str, b: str, row_id: str = "row_id") -> DataFrame:
    """(row_id, i, j, v): the outer product of two vectors of each row."""
    one = df.select(row_id, b, F.posexplode(vec.vector(a)).alias("i", "_x"))
    return one.select(row_id, "i", "_x", F.posexplode(vec.vector(b)).alias("j", "_y")).select(row_id, "i", "j", (F.col("_x") * F.col("_y")).alias("v"))


def gemv(df: DataFrame, u: list[float], row_id: str = "row_id", features: str = "features") -> DataFrame:
    """(row_id, v): each row times a vector."""
    return df.select(row_id, vec.dot(vec.vector(features), F.lit([float(x) for x in u])).alias("v"))


def gram(df: DataFrame, dim: int, features: str = "features") -> DataFrame:
    """(i, j, v) of the matrix's transpose times itself: each task sums a dim x dim matrix of its rows."""

    def run(arrow):
        total = np.zeros((dim, dim))
        for b in arrow:
            x = matrix(b.column(0), dim)
            total += x.T @ x
        i, j = np.indices((dim, dim))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return df.select(vec.vector(features).alias("x")).where("x is not null").mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(x) != len(column) * dim:
        raise ValueError(f"every row must have {dim} features")
    return x.reshape(-1, dim)


def broadcast_rows(df: DataFrame, v: list[float], op: str, features: str = "features") -> DataFrame:
    """Every row plus, times or divided by one vector."""
    f = {"add": lambda a, b: vec.axpby(a, b), "mul": vec.hadamard, "div": vec.divided}[op]
    return df.withColumn(features, f(vec.vector(features), F.lit([float(x) for x in v])))


def broadcast_columns(df: DataFrame, scalars: DataFrame, op: str, row_id: str = "row_id", features: str = "features") -> DataFrame:
    """Every row plus, times or divided by its own scalar (row_id, s)."""
    s = F.col("s")
    f = {"add": lambda x: x + s, "mul": lambda x: x * s, "div": lambda x: F.try_divide(x, s)}[op]
    return df.join(scalars.select(row_id, "s"), row_id).withColumn(features, F.transform(vec.vector(features), f)).drop("s")


def reduce_rows(df: DataFrame, features: str = "features") -> DataFrame:
    """(j, total, least, most) over rows."""
    return df.select(F.posexplode(vec.vector(features)).alias("j", "v")).groupBy("j").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))


def reshape(e: DataFrame, width: int, new_width: int) -> DataFrame:
    """The same entries in row-major order with another width."""
    k = F.col("i") * width + F.col("j")
    return e.select(F.floor(k / new_width).alias("i"), (k % new_width).alias("j"), "v")


def resize_bilinear(e: DataFrame, height: int, width: int, new_height: int, new_width: int, image: str | None = None) -> DataFrame:
    """(i, j, v) of an image in entries at another size, weighting its four neighbours; of every image where
    `image` names a column that tells them apart, which then comes first."""
    spark = e.sparkSession
    fy, fx = (height - 1) / max(1, new_height - 1), (width - 1) / max(1, new_width - 1)
    grid = spark.range(new_height * new_width).select(F.floor(F.col("id") / new_width).alias("i"), (F.col("id") % new_width).alias("j"))
    grid = grid.withColumn("y", F.col("i") * fy).withColumn("x", F.col("j") * fx)
    grid = grid.withColumn("y0", F.floor("y")).withColumn("x0", F.floor("x"))
    corner = lambda dy, dx: F.struct(F.least(F.col("y0") + dy, F.lit(height - 1)).alias("py"), F.least(F.col("x0") + dx, F.lit(width - 1)).alias("px"), ((F.col("y") - F.col("y0")) if dy else (1 - (F.col("y") - F.col("y0")))).alias("wy"), ((F.col("x") - F.col("x0")) if dx else (1 - (F.col("x") - F.col("x0")))).alias("wx"))
    four = grid.select("i", "j", F.explode(F.array(*(corner(dy, dx) for dy in (0, 1) for dx in (0, 1)))).alias("c")).select("i", "j", "c.*")
    key = [] if image is None else [image]
    source = e.select(*key, F.col("i").alias("py"), F.col("j").alias("px"), "v")
    # four rows a cell of the new size, however many images there are
    return source.join(F.broadcast(four), ["py", "px"]).groupBy(*key, "i", "j").agg(F.sum(F.col("v") * F.col("wy") * F.col("wx")).alias("v"))
