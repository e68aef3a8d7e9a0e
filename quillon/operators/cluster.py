"""k-means with explicit seeds, cluster-to-label maps, and one-vs-rest."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import rng, vec

from .neighbors import centroid_vote, nearest_centroid


@dataclass
class KMeans:
    """Lloyd's iterations. Each task sums its rows by nearest centroid (k x d numbers), the sums meet in one small
    aggregation and only centroids come to the driver. An empty cluster keeps its centroid. Rows without a vector are
    left out; a table without rows gives no centroids, and then no row has a cluster."""

    k: int
    tolerance: float = 1e-4
    max_iterations: int = 100
    seed: int = 0
    centroids: np.ndarray | None = None
    inertia: list[float] = field(default_factory=list)

    def seeded(self, centroids) -> KMeans:
        self.centroids = np.array(centroids, float)
        return self

    def fit(self, df: DataFrame, row_id: str = "row_id", features: str = "features") -> KMeans:
        data = df.select(F.col(row_id).alias("r"), vec.vector(features).alias("x")).where("x is not null")
        if self.centroids is None:
            self.centroids = np.array([r.x for r in data.orderBy(rng.key(F.col("r"), self.seed), "r").limit(self.k).collect()], float)
        if not len(self.centroids):
            return self
        data = data.select("x").persist()
        try:
            for _ in range(self.max_iterations):
                moved = self._step(data)
                if moved <= self.tolerance:
                    break
        finally:
            data.unpersist()
        return self

    def _step(self, data: DataFrame) -> float:
        c = self.centroids

        def run(arrow):
            total, n, cost = np.zeros_like(c), np.zeros(len(c), np.int64), np.zeros(len(c))
            for b in arrow:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, c.shape[1])
                d = np.stack([((x - m) ** 2).sum(1) for m in c], 1)
                k = d.argmin(1)
                np.add.at(total, k, x)
                n += np.bincount(k, minlength=len(c))
                cost += np.bincount(k, d[np.arange(len(x)), k], len(c))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(n), pa.array(cost), pa.array(list(total), pa.list_(pa.float64()))], ["k", "n", "cost", "total"])

        parts = data.mapInArrow(run, "k long, n long, cost double, total array<double>")
        by = parts.select("k", "n", "cost", F.posexplode("total").alias("j", "v")).groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("v").alias("v"))
        new, cost = c.copy(), 0.0
        for r in by.collect():  # k x d rows
            cost += r.cost if r.j == 0 else 0.0
            if r.n:
                new[r.k, r.j] = r.v / r.n
        moved = float(np.sqrt(((new - c) ** 2).sum(1)).sum())
        self.centroids = new
        self.inertia.append(cost)
        return moved

    def cluster(self, v: Column) -> Column:
        return nearest_centroid(v, self.centroids.tolist())["k"] if len(self.centroids) else F.lit(None).cast("int")

    def info(self, df: DataFrame, features: str = "features") -> DataFrame:
        """(cluster, n)"""
        return df.groupBy(self.cluster(vec.vector(features)).alias("cluster")).agg(F.count("*").alias("n"))

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(self.centroids)], "k int, centroid array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        meta = json.dumps({"k": self.k, "tolerance": self.tolerance, "max_iterations": self.max_iterations, "seed": self.seed})
        self.to_df(spark).withColumn("meta", F.lit(meta)).coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> KMeans:
        rows = spark.read.parquet(path).orderBy("k").collect()
        return KMeans(**json.loads(rows[0].meta)).seeded([r.centroid for r in rows])


@dataclass
class ClusterMap:
    """Majority class of the rows nearest to each prototype; the smallest class on a tie."""

    prototypes: list[list[float]]
    metric: str = "euclidean"
    mapping: dict[int, int] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str = "label", features: str = "features") -> ClusterMap:
        k = nearest_centroid(vec.vector(features), self.prototypes, self.metric)["k"]
        counts = df.groupBy(k.alias("k"), F.col(label).alias("label")).agg(F.count("*").alias("n"))
        self.mapping = {r.k: r.label for r in counts.groupBy("k").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")).collect()}
        return self

    def classify(self, v: Column) -> Column:
        k = nearest_centroid(v, self.prototypes, self.metric)["k"]
        return F.element_at(F.lit([self.mapping.get(i) for i in range(len(self.prototypes))]).cast("array<int>"), k + 1)

    def vote(self, v: Column, k: int) -> Column:
        """Majority class of the k nearest prototypes that have one."""
        known = sorted(self.mapping)
        return centroid_vote(v, [self.prototypes[i] for i in known], [self.mapping[i] for i in known], k, self.metric)


@dataclass
class InClass:
    """k-means within each class: prototypes (class, centroid), which label by themselves or vote."""

    k: int
    tolerance: float = 1e-4
    max_iterations: int = 100
    seed: int = 0
    models: dict[int, KMeans] = field(default_factory=dict)

    def fit(self, df: DataFrame, label: str = "label", row_id: str = "row_id", features: str = "features", seeds: dict | None = None) -> InClass:
        classes = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())  # one row a class
        for c in classes:
            model = KMeans(self.k, self.tolerance, self.max_iterations, self.seed)
            if seeds is not None:
                model.seeded(seeds[c])
            self.models[c] = model.fit(df.where(F.col(label) == c), row_id, features)
        return self

    def info(self, df: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
        """(label, cluster, n): rows of each class by its own clusters."""
        v = vec.vector(features)
        at = F.coalesce(*(F.when(F.col(label) == c, m.cluster(v)) for c, m in self.models.items()), F.lit(None).cast("int"))
        return df.groupBy(label, at.alias("cluster")).agg(F.count("*").alias("n"))

    def prototypes(self) -> ClusterMap:
        pairs = [(c, m.tolist()) for c, model in self.models.items() for m in model.centroids]
        out = ClusterMap([m for _, m in pairs])
        out.mapping = {i: c for i, (c, _) in enumerate(pairs)}
        return out


def one_vs_rest(margins: list[Column]) -> Column:
    """Class of the largest margin, the first on a tie."""
    return vec.argmax(F.array(*margins))


def fit_one_vs_rest(df: DataFrame, classes: list, fit: Callable[[DataFrame, str], Callable[[Column], Column]], label: str = "label") -> list[Callable[[Column], Column]]:
    """fit(df, target) for each class against the rest; its scorers."""
    return [fit(df.withColumn("_target", F.when(F.col(label) == c, 1).otherwise(-1)), "_target") for c in classes]
