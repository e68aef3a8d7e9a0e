"""Exact nearest neighbours in blocks, votes, nearest centroids, top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import vec


def top_k(df: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Best k rows of each group; Spark limits the groups before their shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def k_nearest(queries: DataFrame, train: DataFrame, k: int, dim: int, metric: str = "euclidean", row_id: str = "row_id", features: str = "features", exclude_self: bool = True, block: int = 4096) -> DataFrame:
    """(q, id, d, rank): the k nearest rows of train for every query, ordered by distance and id.

    d is the squared Euclidean or the Manhattan distance. Both sides are dealt to blocks of about `block` rows by
    hash; each pair of blocks is compared in numpy and keeps k rows a query, so what is shuffled after that is
    queries times blocks times k. Exact for any k; fewer rows than k give as many as there are; rows without a vector
    are neither queries nor neighbours.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(metric)
    queries, train = (t.where(F.col(features).isNotNull()) for t in (queries, train))
    nq, nt = queries.count(), train.count()
    bq, bt = max(1, -(-nq // block)), max(1, -(-nt // block))
    cols = [F.col(row_id).cast("long").alias("id"), vec.vector(features).alias("x")]
    own = F.xxhash64(row_id)
    left = queries.select(F.lit(0).alias("side"), *cols, F.pmod(own, F.lit(bq)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(bt - 1))).alias("j"))
    right = train.select(F.lit(1).alias("side"), *cols, F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("i"), F.pmod(own, F.lit(bt)).cast("int").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        order = np.argsort(ids[side == 1], kind="stable")
        q, t, qid, tid = x[side == 0], x[side == 1][order], ids[side == 0], ids[side == 1][order]
        out = [[], [], []]
        step = max(1, 4_000_000 // max(1, len(t) * (dim if metric == "manhattan" else 8)))
        for a in range(0, len(q) if len(t) else 0, step):
            part, pid = q[a : a + step], qid[a : a + step]
            if metric == "manhattan":
                d = np.abs(part[:, None, :] - t[None, :, :]).sum(2)
            else:
                d = np.zeros((len(part), len(t)))
                for c in range(dim):  # differences first: no loss for near rows
                    d += (part[:, c][:, None] - t[:, c][None, :]) ** 2
            if exclude_self:
                d[pid[:, None] == tid[None, :]] = np.inf
            m = min(k, len(t))
            edge = np.partition(d, m - 1, 1)[:, m - 1]
            for row, e, i in zip(d, edge, pid, strict=True):
                near = np.flatnonzero(row <= e)
                near = near[np.argsort(row[near], kind="stable")][:m]
                near = near[np.isfinite(row[near])]
                out[0] += [i] * len(near)
                out[1] += tid[near].tolist()
                out[2] += row[near].tolist()
        return pa.table({"q": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "d": pa.array(out[2], pa.float64())})

    near = left.unionByName(right).groupBy("i", "j").applyInArrow(run, "q long, id long, d double")
    return top_k(near, k, ["q"], F.col("d"), F.col("id"))


def classify(near: DataFrame, labels: DataFrame, row_id: str = "row_id", label: str = "label") -> DataFrame:
    """(q, predicted): majority of the neighbours' labels, the smallest on a tie."""
    votes = near.join(labels.select(F.col(row_id).alias("id"), F.col(label).alias("label")), "id").groupBy("q", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("q").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("predicted"))


def find_row(df: DataFrame, point: list[float], row_id: str = "row_id", features: str = "features") -> DataFrame:
    """(row_id): rows equal to a point."""
    return df.where(vec.vector(features) == F.lit([float(x) for x in point])).select(row_id)


def centroid_vote(v: Column, centroids: list[list[float]], labels: list[int], k: int, metric: str = "euclidean") -> Column:
    """Majority label of the k nearest of a few labelled centroids, the smallest label on a tie."""
    d = vec.distance_squared if metric == "euclidean" else vec.manhattan
    near = F.array_sort(F.array(*(F.struct(d(v, F.lit([float(x) for x in c])).alias("d"), F.lit(i).alias("i"), F.lit(y).alias("y")) for i, (c, y) in enumerate(zip(centroids, labels, strict=True)))))
    classes = sorted(set(labels))
    count = lambda y, c: F.size(F.filter(y, lambda x: x == c))
    votes = lambda y: F.array(*(count(y, c) for c in classes))
    return vec.let(F.transform(F.slice(near, 1, k), lambda x: x["y"]), lambda y: F.element_at(F.lit(classes), vec.argmax(votes(y)) + 1))


def nearest_centroid(v: Column, centroids: list[list[float]], metric: str = "euclidean") -> Column:
    """(d, k) of the nearest of a few centroids, the first on a tie: one expression, no join."""
    d = vec.distance_squared if metric == "euclidean" else vec.manhattan
    return F.array_min(F.array(*(F.struct(d(v, F.lit([float(x) for x in c])).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centroids))))


def most_similar(genes: DataFrame, block: int = 4096) -> DataFrame:
    """genes (layer, gene, weights): for each the gene of the same layer of the largest cosine, the first on a tie.

    A layer is dealt to blocks of about `block` genes, each pair of blocks is compared in numpy and keeps one row a
    gene. Genes without weights are left out; a gene of zero weights has cosine 0 with all others."""
    genes = genes.select(F.col("layer").cast("int").alias("layer"), F.col("gene").cast("long").alias("gene"), vec.vector("weights").alias("weights")).where("weights is not null")
    blocks = genes.groupBy("layer").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))  # one row a layer
    own = genes.join(F.broadcast(blocks), "layer").withColumn("own", F.pmod(F.xxhash64("gene"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = own.select("layer", "gene", "weights", F.lit(0).alias("side"), F.col("own").alias("i"), every.alias("j"))
    right = own.select("layer", "gene", "weights", F.lit(1).alias("side"), every.alias("i"), F.col("own").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("gene")
        side, gene = table.column("side").to_numpy(), table.column("gene").to_numpy()
        x = np.array(table.column("weights").to_pylist(), float).reshape(len(gene), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        a, b = side == 0, side == 1
        s = x[a] @ x[b].T
        s[gene[a][:, None] == gene[b][None, :]] = -np.inf
        at = s.argmax(1) if b.any() else np.empty(0, np.int64)
        best = s[np.arange(len(at)), at]
        keep = np.isfinite(best)
        rows = {"layer": pa.array(np.repeat(table.column("layer")[0].as_py(), keep.sum()), pa.int32()), "gene": pa.array(gene[a][: len(at)][keep], pa.int64())}
        return pa.table({**rows, "similar": pa.array(gene[b][at][keep], pa.int64()), "cosine": pa.array(best[keep])})

    found = left.unionByName(right).groupBy("layer", "i", "j").applyInArrow(run, "layer int, gene long, similar long, cosine double")
    best = F.max_by(F.struct("similar", "cosine"), F.struct("cosine", -F.col("similar")))
    return found.groupBy("layer", "gene").agg(best.alias("b")).select("layer", "gene", "b.similar", "b.cosine")


def prune(filters: DataFrame, n: int, largest: bool = True) -> DataFrame:
    """filters (layer, j, weights): the n of each layer of the largest (or smallest) norm."""
    norm = vec.norm(vec.vector("weights"))
    return top_k(filters.withColumn("norm", norm), n, ["layer"], F.desc("norm") if largest else F.asc("norm"), F.col("j"))
