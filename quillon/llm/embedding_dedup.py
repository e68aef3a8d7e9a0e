"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosines.

Vectors of equal bytes are one node with a multiplicity. A table hashes a normalised vector by `k` random
projections, each shifted and cut into steps of `w` (five times the distance at the threshold). For n distinct
vectors, k keeps about LOAD unrelated vectors to a bucket and the number of tables finds a pair at the threshold
itself with probability RECALL, a closer one with more; both follow from n by the formulas of p-stable hashing,
so recall is the same at every size.

Vectors meet in their buckets, where cosines are exact products in double precision. A link that several tables
find is counted in the first of them: rows bring the hashes of all tables with them. Of a bucket come sums of
links and a spanning forest, never pairs. A bucket beyond `most` vectors is dealt out in chunks, each pair of
chunks to a group of its own; nothing is capped. Components are contracted without a driver.

Defined results: a vector that is null, zero, of another length than most, or has null or non-finite components
links with nothing (n_links 0, its own component); copies link with one another; rows that share a vec_id are
vectors of their own; a null vec_id shares what its copies with ids have, and else links with its copies alone.
"""

from __future__ import annotations

import hashlib
from functools import reduce
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut

THRESHOLD, RECALL, LOAD = 0.9, 0.98, 64


def collision(distance: float, width: float) -> float:
    """Probability that one projection puts two vectors at a distance into one step."""
    t = width / distance
    return math.erf(t / math.sqrt(2)) - math.sqrt(2 / math.pi) / t * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int, float]:
    """(tables, projections of each, step) for n distinct vectors."""
    near = math.sqrt(2 - 2 * threshold)
    width = 5 * near
    p1, p2 = collision(near, width), collision(math.sqrt(2), width)
    k = max(2, math.ceil(math.log(max(2, n) / LOAD) / -math.log(p2)))
    return math.ceil(math.log(1 - recall) / math.log(1 - p1**k)), k, width


def hashes(x: np.ndarray, tables: int, k: int, width: float) -> np.ndarray:
    """(vectors, tables) unsigned 64-bit hashes of normalised vectors."""
    r = np.random.default_rng(5)
    a, b = r.normal(size=(x.shape[1], tables * k)), r.uniform(0, width, tables * k)
    steps = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), (len(x), tables)).copy()
    for i in range(k):
        h = (h ^ (h >> np.uint64(31)) ^ steps[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def read_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector that can link, and those vectors, in double precision."""
    rows = column.to_pylist()
    good = np.array([v is not None and len(v) == dim and None not in v for v in rows], bool)
    x = np.array([v for v, g in zip(rows, good, strict=True) if g], float).reshape(-1, dim)
    fine = np.isfinite(x).all(1)
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum(1))
        extreme = fine & ~((norm > 1e-150) & (norm < 1e150))  # squares that don't fit a double: the direction is all that counts
        x[extreme] /= np.maximum(np.abs(x[extreme]).max(1, keepdims=True, initial=0), 5e-324)
    fine &= x.any(1)
    good[np.flatnonzero(good)[~fine]] = False
    return good, x[fine]


def found_in(x: np.ndarray, h: np.ndarray, table: int, split: int | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) of a group of normalised vectors that no table before `table` finds; split: only between the
    first `split` and the rest."""
    out: list = [(np.empty(0, np.int64),) * 2]
    for a in range(0, len(x) if split is None else split, 1024):
        rows = slice(a, min(a + 1024, len(x) if split is None else split))
        first = a if split is None else split
        i, j = np.nonzero(x[rows] @ x[first:].T >= threshold)
        i, j = i + a, j + first
        if split is None:
            i, j = i[i < j], j[i < j]
        fresh = np.ones(len(i), bool)
        for s in range(table):
            fresh &= h[i, s] != h[j, s]
        out.append((i[fresh], j[fresh]))
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def least_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n vectors each one's smallest index that links reach."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def links(nodes: DataFrame, dim: int, most: int = 2048, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """nodes: (node, copies, vector as double bytes), all distinct. Rows (node, n, root): links counted, with
    copies, and edges of spanning forests (n = 0)."""
    tables, k, width = plan(nodes.count(), threshold, recall)

    def hashed(arrow):
        for whole in arrow:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                x = np.frombuffer(b"".join(b.column("vector").to_pylist()), float).reshape(-1, dim)
                h = hashes(x / np.sqrt((x * x).sum(1))[:, None], tables, k, width)
                small = [r.tobytes() for r in h.astype("<u4")]
                rows = np.repeat(np.arange(len(x)), tables)
                part = b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64).ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(x))), part.column("node"), part.column("copies"), part.column("vector"), pa.array([small[r] for r in rows], pa.binary())], ["key", "table", "node", "copies", "vector", "hashes"])

    rows = nodes.mapInArrow(hashed, "key long, table int, node long, copies long, vector binary, hashes binary")

    def keys(arrow):
        for b in arrow:
            x = np.frombuffer(b"".join(b.column("vector").to_pylist()), float).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array(hashes(x / np.sqrt((x * x).sum(1))[:, None], tables, k, width).view(np.int64).ravel())], ["key"])

    sizes = nodes.select("vector").mapInArrow(keys, "key long").groupBy("key").agg(F.count("*").alias("size"))
    large = cut(sizes.where(F.col("size") > most), "large")
    rows = rows.join(large, "key", "left")
    chunks = F.ceil(F.col("size") / most).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(own, c).alias("i"), F.greatest(own, c).alias("j"), own.alias("own")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("own")))
    dealt = rows.select("key", "table", "node", "copies", "vector", "hashes", F.explode(F.when(F.col("size").isNull(), one).otherwise(pairs)).alias("p")).select("key", "table", "node", "copies", "vector", "hashes", "p.*")

    def out(node, n, root):
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(root, pa.int64())], ["node", "n", "root"])

    def group(at, held):
        held.sort()
        node = np.array([r[1] for r in held])
        copies = np.array([r[2] for r in held])
        x = np.frombuffer(b"".join(r[3] for r in held), float).reshape(-1, dim)
        x = x / np.sqrt((x * x).sum(1))[:, None]
        h = np.frombuffer(b"".join(r[4] for r in held), "<u4").reshape(len(held), -1)
        split = None if at[1] == at[2] else sum(r[0] == at[1] for r in held)
        i, j = found_in(x, h, at[3], split, threshold)
        if not len(i):
            return None
        n = np.bincount(i, copies[j], len(held)) + np.bincount(j, copies[i], len(held))
        root = least_linked(len(held), i, j)
        some = n > 0
        moved = root != np.arange(len(held))
        return np.concatenate((node[some], node[moved])), np.concatenate((n[some].astype(np.int64), np.zeros(moved.sum(), np.int64))), np.concatenate((node[some], node[root[moved]]))

    def compared(arrow):
        now, held = None, []
        for b in arrow:
            done = []
            for key, table, node, copies, vector, small, i, j, own in zip(*(b.column(c).to_pylist() for c in ("key", "table", "node", "copies", "vector", "hashes", "i", "j", "own")), strict=True):
                if (key, i, j, table) != now:
                    if len(held) > 1:
                        done.append(group(now, held))
                    now, held = (key, i, j, table), []
                held.append((own, node, copies, vector, small))
            if done := [d for d in done if d is not None]:
                yield out(*map(np.concatenate, zip(*done, strict=True)))
        if len(held) > 1 and (d := group(now, held)) is not None:
            yield out(*d)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "table").mapInArrow(compared, "node long, n long, root long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, most: int = 2048) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    # one number for each length that occurs
    dims = sorted(r.dim for r in source.where("size(embedding) > 0").select(F.size("embedding").alias("dim")).distinct().collect())

    def run(arrow):
        for b in arrow:
            data = [None] * b.num_rows
            for dim in dims:
                good, x = read_vectors(b.column("embedding"), dim)
                for i, r in zip(np.flatnonzero(good).tolist(), x, strict=True):
                    data[i] = r.tobytes()
            digest = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], ["vec_id", "digest", "vector"])

    rows = cut(source.mapInArrow(run, "vec_id long, digest binary, vector binary"), "vectors")
    classes = cut(rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "classes")
    nodes = classes.where("node is not null").select("node", "copies", "vector")
    # vectors of one length are compared with each other
    of = [links(nodes.where(F.octet_length("vector") == 8 * dim), dim, most, threshold, recall) for dim in dims or [1]]
    found = cut(reduce(DataFrame.unionByName, of), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(found.where("n = 0"), "node", "root")
    known = classes.select("digest", "node", "copies").join(counts, "node", "left").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    out = rows.select("vec_id", "digest").join(known, "digest", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for every embedding."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
