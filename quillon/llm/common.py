"""What the operators of this folder share: hold-out rule, cut tables, connected components, text batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def held_out(doc_id, mod: int, remainder: int) -> bool:
    """The contracts' hold-out rule: crc32 of the id as text; a null id is never held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == remainder


def held_out_column(doc_id: Column, mod: int, remainder: int) -> Column:
    """held_out() as an expression."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- tables that cut lineage

_kept: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def cut(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write a table to the shared folder and read it again: no lineage, exact sizes for AQE, one computation. With
    columns `by` their values are folders of their own, which drop() can delete apart."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quillon_path = path
    return out


def drop(df: DataFrame, part: str = "") -> None:
    """Delete a table made by cut(), or the folder `part` of it, which no later plan reads."""
    if path := getattr(df, "quillon_path", None):
        _delete(df.sparkSession, f"{path}/{part}" if part else path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _kept:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may be gone; its owner then clears the shared folder
            return


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node of an edge with the smallest node that links reach.

    Alternates large-star and small-star contraction. Each round is a min per node (combined before its
    shuffle) and a join, cut to a table; the number of rounds grows with the logarithm of a component's
    diameter. Nothing but two totals of a round reaches the driver.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("m")).distinct()
    current, seen = cut(e, "edges"), None
    while True:
        both = current.unionByName(current.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.where("m > v").join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        large = cut(large, "large")
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.when(F.col("m") == F.col("low"), F.array(F.struct("v", F.col("low").alias("m")))).otherwise(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m"))))).alias("x")).select("x.*").distinct()
        small = cut(small, "small")
        drop(current)
        drop(large)
        total = small.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)"))).first()
        current = small
        if tuple(total) == seen:
            return current.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(current.select(F.col("m").alias("node"), F.col("m").alias("root"))).distinct()
        seen = tuple(total)


# ---------------------------------------------------------------- caches of worker processes

_caches: dict[str, tuple[dict, ...]] = {}


def register(owner: str, *caches: dict) -> None:
    """Dictionaries that an operator keeps in a worker process from task to task."""
    _caches[owner] = caches


def enter(owner: str) -> None:
    """Called where an operator uses its caches: those of all others are emptied, as workers serve one operator
    after another."""
    for name, caches in _caches.items():
        if name != owner:
            for c in caches:
                c.clear()


# ---------------------------------------------------------------- batches


def batches(arrow, most: int = 16 << 20):
    """Arrow record batches cut to about `most` bytes of their buffers, never within a row."""
    for b in arrow:
        step = max(1, int(b.num_rows * most / max(most, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def texts(b: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A column of strings as UTF-8; null as empty."""
    return [x or b"" for x in b.column(name).cast(pa.binary()).to_pylist()]


def with_rows(b: pa.RecordBatch, names: list[str], columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """Columns `names` of b beside new columns, as `schema`."""
    return pa.RecordBatch.from_arrays([b.column(n).cast(schema.field(n).type) for n in names] + [pa.array(c, type=schema.field(i + len(names)).type) for i, c in enumerate(columns)], schema=schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
