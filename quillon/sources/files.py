"""Files: separated text with comments, raw matrices, and fixed-record image sets. All bytes come through Spark's
readers, so a path may be in any store that Spark reads."""

from __future__ import annotations

import logging
import re
import struct
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.frame import number_rows


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, comment: str = "#") -> DataFrame:
    """Names trimmed, empty cells null, numbers where a column has nothing else."""
    df = spark.read.csv(path, sep=sep, header=header, comment=comment, inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.strip() for c in df.columns))


def read_coded(spark: SparkSession, path: str, sep: str = ",", header: bool = True, comment: str = "#", nanval: float = float("nan")) -> tuple[DataFrame, list[str]]:
    """(row_id, features) of separated text by the rules of numeric tables, and the columns' names, trimmed.

    Comment and blank lines go. Every line must have as many cells as the first. An empty cell is `nanval`, a cell that
    begins with a number is that number, and any other is a code: texts of a column count up from 0 as they first come.
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^[ \t]*(" + re.escape(comment) + r".*)?\r?$")).withColumn("row_id", F.monotonically_increasing_id())
    cells = lines.select("row_id", F.transform(F.split("value", f"\\Q{sep}\\E", -1), lambda x: F.trim(x)).alias("c"))
    first = cells.orderBy("row_id").first()
    if first is None:
        return spark.createDataFrame([], "row_id long, features array<double>"), []
    names = list(first.c) if header else [f"c{i}" for i in range(len(first.c))]
    if header:
        cells = cells.where(F.col("row_id") > first.row_id)
    width = len(names)
    wrong = cells.where(F.size("c") != width).count()
    if wrong:
        raise ValueError(f"{path}: {wrong} lines don't have {width} cells")
    cells = number_rows(cells.withColumnRenamed("row_id", "_line"), F.col("_line"), name="row_id").drop("_line")
    number = F.transform("c", lambda x: F.regexp_extract(x, r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", 0).try_cast("double"))
    out = cells.select("row_id", "c", number.alias("x"))
    texts = out.agg(*(F.max(F.expr(f"c[{i}] <> '' AND x[{i}] IS NULL")).alias(f"t{i}") for i in range(width))).first()
    coded = [i for i in range(width) if texts[i]]
    for i in coded:  # a column that has text: its distinct texts, in order of their first rows
        known = out.where(F.expr(f"c[{i}] <> '' AND x[{i}] IS NULL")).groupBy(F.col("c")[i].alias("_t")).agg(F.min("row_id").alias("_first"))
        known = number_rows(known, F.col("_first"), name=f"_code{i}").select(F.col("_t").alias(f"_t{i}"), f"_code{i}")
        out = out.join(known, (F.col("c")[i] == F.col(f"_t{i}")) & F.col("x")[i].isNull(), "left").drop(f"_t{i}")
    value = lambda i: F.coalesce(F.col("x")[i], *([F.col(f"_code{i}").cast("double")] if i in coded else []), F.lit(float(nanval)))
    return out.select("row_id", F.array(*map(value, range(width))).alias("features")), names


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file in any store that Spark writes."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def _pieces(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """One task a file; parse(bytes) yields record batches."""

    def run(arrow):
        for b in arrow:
            for data in b.column("content").to_pylist():
                yield from parse(data)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _rows(x: np.ndarray, first: int = 0, step: int = 4096, **more):
    for a in range(0, len(x), step):
        part = x[a : a + step]
        ids = np.arange(first + a, first + a + len(part))
        yield pa.RecordBatch.from_pydict({"row_id": pa.array(ids), **{k: pa.array(v[a : a + step], pa.int32()) for k, v in more.items()}, "features": pa.array(list(part.astype(float)), pa.list_(pa.float64()))})


def read_matrix(spark: SparkSession, path: str, height: int, width: int, dtype: str = "<f4", header: int = 0) -> DataFrame:
    """Row-major values after `header` bytes."""

    def parse(data):
        x = np.frombuffer(data, dtype, height * width, header).reshape(height, width)
        yield from _rows(x)

    return _pieces(spark, path, parse, "row_id long, features array<double>")


def matrix_bytes(x: np.ndarray, dtype: str = "<f4") -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


def write_matrix(x: np.ndarray, path: str, dtype: str = "<f4") -> None:
    """For small matrices on the driver; tables go to Parquet."""
    with open(path, "wb") as f:
        f.write(matrix_bytes(x, dtype))


IMAGES, LABELS = 2051, 2049  # fixed values: the formats' magic numbers


def read_idx_images(spark: SparkSession, path: str) -> DataFrame:
    def parse(data):
        magic, n, h, w = struct.unpack(">4i", data[:16])
        if magic != IMAGES:
            raise ValueError(f"not an image file: {magic}")
        yield from _rows(np.frombuffer(data, np.uint8, n * h * w, 16).reshape(n, h * w))

    return _pieces(spark, path, parse, "row_id long, features array<double>")


def read_idx_labels(spark: SparkSession, path: str) -> DataFrame:
    def parse(data):
        magic, n = struct.unpack(">2i", data[:8])
        if magic != LABELS:
            raise ValueError(f"not a label file: {magic}")
        yield pa.RecordBatch.from_pydict({"row_id": pa.array(np.arange(n)), "label": pa.array(np.frombuffer(data, np.uint8, n, 8).astype(np.int32))})

    return _pieces(spark, path, parse, "row_id long, label int")


def idx_images(x: np.ndarray, height: int, width: int) -> bytes:
    return struct.pack(">4i", IMAGES, len(x), height, width) + x.astype(np.uint8).tobytes()


def idx_labels(y: np.ndarray) -> bytes:
    return struct.pack(">2i", LABELS, len(y)) + y.astype(np.uint8).tobytes()


def read_records(spark: SparkSession, path: str, pixels: int = 3072) -> DataFrame:
    """(row_id, label, features) of records of one label byte and `pixels` bytes. Of several files the ids go on in
    order of their names."""
    size = pixels + 1
    files = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").collect()
    starts, at = {}, 0
    for f in files:
        if f.length % size:
            raise ValueError(f"{f.path}: {f.length} bytes are no records of {size}")
        starts[f.path] = at
        at += f.length // size

    def run(arrow):
        for b in arrow:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(-1, size)
                yield from _rows(x[:, 1:], starts[name], label=x[:, 0].astype(np.int32))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "row_id long, label int, features array<double>")


def read_posters(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, id, features): a header of n, h, w (big-endian), then an id and three planes for each."""

    def parse(data):
        n, h, w = struct.unpack(">3i", data[:12])
        x = np.frombuffer(data, np.uint8, n * (4 + 3 * h * w), 12).reshape(n, -1)
        ids = x[:, :4].copy().view(">i4").ravel().astype(np.int32)
        yield from _rows(x[:, 4:], id=ids)

    return _pieces(spark, path, parse, "row_id long, id int, features array<double>")


def read_poster_labels(spark: SparkSession, path: str, classes: int = 14) -> DataFrame:
    """(row_id, id, labels): a header of n (big-endian), then an id and as many bytes of 0 or 1 as there are classes."""

    def parse(data):
        (n,) = struct.unpack(">i", data[:4])
        x = np.frombuffer(data, np.uint8, n * (4 + classes), 4).reshape(n, -1)
        ids = x[:, :4].copy().view(">i4").ravel().astype(np.int32)
        yield pa.RecordBatch.from_pydict({"row_id": pa.array(np.arange(n)), "id": pa.array(ids), "labels": pa.array(list(x[:, 4:].astype(np.int32)), pa.list_(pa.int32()))})

    return _pieces(spark, path, parse, "row_id long, id int, labels array<int>")


def tee(name: str, path: str) -> logging.Logger:
    """A logger of the driver that writes to standard output and to a file, flushed at every line."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    log.propagate = False
    for old in log.handlers[:]:
        log.removeHandler(old)
        old.close()
    for handler in (logging.StreamHandler(sys.stdout), logging.FileHandler(path, encoding="utf-8")):
        handler.setFormatter(logging.Formatter("%(message)s"))
        log.addHandler(handler)
    return log


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_seen_codes(df: DataFrame, column: str, row_id: str = "row_id") -> DataFrame:
    """A text column as integer codes in order of first appearance; null stays."""
    from quillon.operators.preproc import StringEncoder

    return StringEncoder.fit(df, column, row_id).encode(df, column, "_code").withColumn(column, F.col("_code").cast("int")).drop("_code")
