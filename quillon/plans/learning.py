"""Queries of neighbours, clusters, networks, evolution and generators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import rng, scalar, vec
from quillon.operators import evo, frame, neighbors, nn
from quillon.operators.cluster import ClusterMap, KMeans, one_vs_rest
from quillon.operators.decomp import Pca
from quillon.operators.stats import column_means
from quillon.sources import generators
from quillon.streaming.windows import windowed_stats

from .registry import DIM, ENTRIES, VECTORS, query, r6, table, uniform, vectors

# ---------------------------------------------------------------- neighbours (queries: ids divisible by 20)


def _near(spark, d, k, metric="euclidean"):
    v = vectors(spark, d)
    return neighbors.k_nearest(v.where("row_id % 20 = 0"), v, k, DIM, metric)


_KNN = f"(SELECT a.row_id AS q, b.row_id AS id, b.label, {{0}} AS d, row_number() OVER (PARTITION BY a.row_id ORDER BY {{0}}, b.row_id)::INTEGER AS rank FROM {VECTORS} a JOIN {VECTORS} b ON a.row_id <> b.row_id WHERE a.row_id % 20 = 0)"
_D2 = "list_sum(list_transform(list_zip(a.features, b.features), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_L1 = "list_sum(list_transform(list_zip(a.features, b.features), lambda x: abs(x[1] - x[2])))"


@query(f"SELECT q, id, round(d, 6) AS d, rank FROM {_KNN.format(_D2)} WHERE rank <= 5")
def knn_topk(spark, d):
    return _near(spark, d, 5).select("q", "id", F.round("d", 6).alias("d"), "rank")


@query(f"SELECT q, id, round(d, 6) AS d, rank FROM {_KNN.format(_L1)} WHERE rank <= 5")
def manhattan_topk(spark, d):
    return _near(spark, d, 5, "manhattan").select("q", "id", F.round("d", 6).alias("d"), "rank")


@query(f"SELECT q, arg_min(label, (-n, label)) AS predicted FROM (SELECT q, label, count(*) AS n FROM {_KNN.format(_D2)} WHERE rank <= 5 GROUP BY 1, 2) GROUP BY q")
def knn_classify(spark, d):
    return neighbors.classify(_near(spark, d, 5), vectors(spark, d))


_SEEDS = f"(SELECT label AS k, arg_min(features, row_id) AS c FROM {VECTORS} GROUP BY label)"


def _seeds(spark, d):
    rows = vectors(spark, d).groupBy("label").agg(F.min_by("features", "row_id").alias("c")).orderBy("label").collect()  # one row a label
    return [r.c for r in rows]


_ASSIGN = "SELECT row_id, label, arg_min(k, (list_distance(features, c), k)) AS k, features FROM {0}, {1} GROUP BY row_id, label, features"


@query("SELECT row_id, k::INTEGER AS k FROM (" + _ASSIGN.format(VECTORS, _SEEDS) + ")")
def nearest_centroid(spark, d):
    return vectors(spark, d).select("row_id", neighbors.nearest_centroid(F.col("features"), _seeds(spark, d))["k"].alias("k"))


@query("WITH a AS (" + _ASSIGN.format(VECTORS, _SEEDS) + "), m AS (SELECT k, arg_min(label, (-n, label)) AS p FROM (SELECT k, label, count(*) AS n FROM a GROUP BY 1, 2) GROUP BY k) SELECT row_id, p AS predicted FROM a JOIN m USING (k)")
def clustermap(spark, d):
    v = vectors(spark, d)
    return v.select("row_id", ClusterMap(_seeds(spark, d)).fit(v).classify(F.col("features")).alias("predicted"))


def _lloyd(t: int) -> str:
    out = [f"c0 AS {_SEEDS}"]
    for i in range(t):
        out.append(f"a{i} AS (" + _ASSIGN.format(VECTORS, f"c{i}") + ")")
        out.append(f"m{i} AS (SELECT k, list(m ORDER BY j) AS c FROM (SELECT k, j, avg(v) AS m FROM (SELECT k, generate_subscripts(features, 1) AS j, unnest(features) AS v FROM a{i}) GROUP BY 1, 2) GROUP BY k)")
        out.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    return "WITH " + ", ".join(out) + f" SELECT k::INTEGER AS k, (generate_subscripts(c, 1) - 1)::INTEGER AS j, round(unnest(c), 6) + 0.0 AS v FROM c{t}"


@query(_lloyd(3))
def kmeans_3iter(spark, d):
    seeds = _seeds(spark, d)
    model = KMeans(len(seeds), tolerance=-1, max_iterations=3).seeded(seeds).fit(vectors(spark, d))
    return model.to_df(spark).select("k", F.posexplode("centroid").alias("j", "v")).withColumn("v", r6("v"))


@query()
def kmeans_fit(spark, d):
    v = vectors(spark, d)
    model = KMeans(10, max_iterations=20).fit(v)
    return model.info(v)


@query(f"SELECT label AS layer, row_id AS j, round(sqrt(list_dot_product(features, features)), 9) AS norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY list_sum(features) DESC, row_id)::INTEGER AS rank FROM {VECTORS}) WHERE rank <= 5")
def top_per_class(spark, d):
    f = F.col("features")
    v = vectors(spark, d).select(F.col("label").alias("layer"), F.col("row_id").alias("j"), vec.total(f).alias("t"), F.round(vec.norm(f), 9).alias("norm"))
    return neighbors.top_k(v, 5, ["layer"], F.desc("t"), F.col("j")).select("layer", "j", "norm", "rank")


@query(f"SELECT layer, j, round(norm, 6) AS norm, rank FROM (SELECT label AS layer, row_id AS j, sqrt(list_dot_product(f, f)) AS norm, row_number() OVER (PARTITION BY label ORDER BY sqrt(list_dot_product(f, f)) DESC, row_id)::INTEGER AS rank FROM (SELECT *, features[:16] AS f FROM {VECTORS})) WHERE rank <= 5")
def prune_top_norm(spark, d):
    """Norms of filters of 16 weights: the first 16 of each row."""
    v = vectors(spark, d).select(F.col("label").alias("layer"), F.col("row_id").alias("j"), vec.copy_range(F.col("features"), 0, 16).alias("weights"))
    return neighbors.prune(v, 5).select("layer", "j", F.round("norm", 6).alias("norm"), "rank")


@query(f"SELECT a.label AS layer, a.row_id AS gene, arg_max(b.row_id, list_cosine_similarity(a.features, b.features)) AS similar, round(max(list_cosine_similarity(a.features, b.features)), 6) AS cosine FROM {VECTORS} a JOIN {VECTORS} b ON a.label = b.label AND a.row_id <> b.row_id GROUP BY 1, 2")
def similar_gene(spark, d):
    g = vectors(spark, d).select(F.col("label").alias("layer"), F.col("row_id").alias("gene"), F.col("features").alias("weights"))
    return neighbors.most_similar(g).select("layer", "gene", "similar", F.round("cosine", 6).alias("cosine"))


# ---------------------------------------------------------------- components


@query(f"SELECT round(sum(s), 6) AS total FROM (SELECT var_samp(v) AS s FROM {ENTRIES} GROUP BY j)")
def pca_total_variance(spark, d):
    p = Pca.fit(vectors(spark, d), DIM, DIM)
    return spark.createDataFrame([(float(p.values.sum()),)], "total double").select(F.round("total", 6).alias("total"))


@query(f"WITH e AS {ENTRIES}, m AS (SELECT j, avg(v) AS m FROM e GROUP BY j) SELECT i AS row_id, round(sum((v - m) * sin(j)), 6) + 0.0 AS z FROM e JOIN m USING (j) GROUP BY i")
def pca_project_given(spark, d):
    v = vectors(spark, d)
    p = Pca(np.array(column_means(v, DIM)), np.ones(1), np.array([[math.sin(j)] for j in range(DIM)]))
    return v.select("row_id", r6(p.transform(F.col("features"))[0]).alias("z"))


@query()
def pca_fit_transform(spark, d):
    v = vectors(spark, d)
    p = Pca.fit(v, 3, DIM)
    return v.select("row_id", p.transform(F.col("features")).alias("z"))


# ---------------------------------------------------------------- networks

_W = [[math.sin(i * DIM + j) for j in range(DIM)] for i in range(10)]
_Z = "list_transform(range(10), lambda i: list_sum(list_transform(range(64), lambda j: features[j + 1] * sin(i * 64 + j))) + i / 10.0::DOUBLE)"
_SOFT = f"(SELECT row_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p, z FROM (SELECT row_id, label, z, list_transform(z, lambda x: exp((x - list_max(z)) / 2.0)) AS e FROM (SELECT row_id, label, {_Z} AS z FROM {VECTORS})))"


def _scores(spark, d, activation="linear"):
    return vectors(spark, d).select("row_id", "label", nn.dense(F.col("features"), _W, [i / 10 for i in range(10)], activation).alias("z"))


@query(f"SELECT row_id, (generate_subscripts(z, 1) - 1)::INTEGER AS j, round((exp(2 * unnest(z)) - 1) / (exp(2 * unnest(z)) + 1), 6) + 0.0 AS v FROM (SELECT row_id, {_Z} AS z FROM {VECTORS})")
def dense_forward(spark, d):
    return _scores(spark, d, "tanh").select("row_id", F.posexplode("z").alias("j", "v")).withColumn("v", r6("v"))


@query(f"SELECT row_id, (generate_subscripts(p, 1) - 1)::INTEGER AS j, round(unnest(p), 6) + 0.0 AS v FROM {_SOFT}")
def softmax_t(spark, d):
    return _scores(spark, d).select("row_id", F.posexplode(vec.softmax(F.col("z"), 2.0)).alias("j", "v")).withColumn("v", r6("v"))


@query(f"SELECT row_id, (list_position(z, list_max(z)) - 1)::INTEGER AS k FROM (SELECT row_id, {_Z} AS z FROM {VECTORS})")
def ovr_argmax(spark, d):
    s = _scores(spark, d)
    return s.select("row_id", one_vs_rest([F.col("z")[i] for i in range(10)]).alias("k"))


@query(f"SELECT round(sum(list_sum(list_transform(range(10), lambda i: (p[i + 1] - (i = label)::INTEGER) ** 2))), 4) AS rss, round(sum(list_sum(list_transform(range(10), lambda i: (p[i + 1] - (i = label)::INTEGER) ** 2)) / 10), 4) AS mse, round(sum(-ln(p[label + 1])), 4) AS cross_entropy FROM {_SOFT}")
def losses(spark, d):
    s = _scores(spark, d).select("label", vec.softmax(F.col("z"), 2.0).alias("p"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    rss = vec.distance_squared(hot, F.col("p"))
    return s.agg(F.round(F.sum(rss), 4).alias("rss"), F.round(F.sum(rss / 10), 4).alias("mse"), F.round(F.sum(-F.ln(F.element_at("p", F.col("label") + 1))), 4).alias("cross_entropy"))


@query(f"SELECT i AS row_id, j, round(v - 0.001 * ((0.9 * 0.1 * v + 0.1 * v) / (1 - 0.9 ** 2)) / (sqrt((0.999 * v * v + 0.001 * v * v) / (1 - 0.999 ** 2)) + 1e-8), 6) + 0.0 AS adam, round(v + (0.9 * 0.1 * v - 0.01 * v), 6) + 0.0 AS momentum, round(v - 0.01 / (1 + 0.1 * 3) * v, 6) + 0.0 AS decayed FROM {ENTRIES}")
def gradient_steps(spark, d):
    """One step of each rule with the weights as their own gradients and moments."""

    def run(arrow):
        for b in arrow:
            v = b.column("v").to_numpy(zero_copy_only=False)
            steps = [nn.Step("adam", 0.001, t=1, state={0: (0.1 * v, v * v)}), nn.Step("momentum", 0.01, state={0: 0.1 * v}), nn.Step("decay", 0.01, decay=0.1, t=3)]
            moved = []
            for step in steps:
                p = v.copy()
                step([p], [v])
                moved.append(pa.array(p))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("j"), *moved], ["row_id", "j", "adam", "momentum", "decayed"])

    e = frame.entries(vectors(spark, d)).select(F.col("i").alias("row_id"), "j", "v")
    out = e.mapInArrow(run, "row_id long, j int, adam double, momentum double, decayed double")
    return out.select("row_id", "j", *(r6(c).alias(c) for c in ("adam", "momentum", "decayed")))


def _images(spark, d):
    e = frame.entries(vectors(spark, d))
    return e.select(F.col("i").alias("id"), F.floor(F.col("j") / 8).alias("y"), (F.col("j") % 8).cast("long").alias("x"), "v")


_IMG = f"(SELECT i AS id, (j // 8)::BIGINT AS y, (j % 8)::BIGINT AS x, v FROM {ENTRIES})"


@query(f"SELECT id, y - a AS y, x - b AS x, round(sum(v * sin(a * 3 + b)), 6) + 0.0 AS v FROM {_IMG}, range(3) t(a), range(3) u(b) WHERE y - a BETWEEN 0 AND 5 AND x - b BETWEEN 0 AND 5 GROUP BY 1, 2, 3")
def conv2d_one(spark, d):
    return nn.conv2d(_images(spark, d), [[math.sin(a * 3 + b) for b in range(3)] for a in range(3)]).withColumn("v", r6("v"))


@query(f"SELECT id, y // 2 AS y, x // 2 AS x, round(max(v), 6) + 0.0 AS v FROM {_IMG} GROUP BY 1, 2, 3")
def maxpool2d(spark, d):
    return nn.max_pool(_images(spark, d), 2).select("id", "y", "x", r6("v").alias("v"))


@query()
def mlp_train(spark, d):
    """Loss of 10 synchronous epochs over all embeddings."""
    v = vectors(spark, d).select("features", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0)).alias("target"))
    net = nn.mlp(DIM, [32], 10)
    return spark.createDataFrame(list(enumerate(net.train(v, 10, nn.Step("adam", 0.01)))), "epoch int, loss double")


# ---------------------------------------------------------------- evolution


@query(f"WITH p AS (SELECT c_custkey AS m, 1 + abs(c_acctbal) AS f FROM customer), c AS (SELECT m, sum(f) OVER (ORDER BY m) AS hi, f FROM p), t AS (SELECT sum(f) AS a FROM p) SELECT s_suppkey AS draw, m AS member_id FROM supplier, t, c WHERE hi - f < {uniform('s_suppkey', 5)} * a AND {uniform('s_suppkey', 5)} * a <= hi")
def roulette(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), (1 + F.abs("c_acctbal")).alias("fitness"))
    draws = table(spark, d, "supplier").select(F.col("s_suppkey").alias("draw"), rng.uniform(F.col("s_suppkey"), 5).alias("u"))
    return evo.roulette(p, draws)


_PAIR = f"(SELECT row_id, features AS a, list_reverse(features) AS b, 1 + (row_id % 60)::INTEGER AS c1, 2 + (row_id % 60)::INTEGER + (row_id % 3)::INTEGER AS c2 FROM {VECTORS})"


def _pair(spark, d):
    k = (F.col("row_id") % 60).cast("int")
    return vectors(spark, d).select("row_id", F.col("features").alias("a"), F.reverse("features").alias("b"), (1 + k).alias("c1"), (2 + k + (F.col("row_id") % 3).cast("int")).alias("c2"))


@query(f"SELECT row_id, (generate_subscripts(a, 1) - 1)::INTEGER AS j, round(unnest(list_concat(a[:c1], b[c1 + 1:])), 6) + 0.0 AS one, round(unnest(list_concat(list_concat(a[:c1], b[c1 + 1:c2]), a[c2 + 1:])), 6) + 0.0 AS two, round(unnest(list_transform(range(64), lambda i: CASE WHEN i % 2 = row_id % 2 THEN b[i + 1] ELSE a[i + 1] END)), 6) + 0.0 AS mixed, round(unnest(list_transform(range(64), lambda i: (a[i + 1] + b[i + 1]) / 2)), 6) + 0.0 AS mean FROM {_PAIR}")
def crossover(spark, d):
    a, b, c1, c2 = F.col("a"), F.col("b"), F.col("c1"), F.col("c2")
    mask = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.when(i % 2 == F.col("row_id") % 2, 1).otherwise(0))
    z = F.arrays_zip(evo.onepoint(a, b, c1).alias("one"), evo.twopoint(a, b, c1, c2).alias("two"), evo.mixed(a, b, mask).alias("mixed"), evo.averaged(a, b).alias("mean"))
    return _pair(spark, d).select("row_id", F.posexplode(z).alias("j", "z")).select("row_id", "j", *(r6(F.col("z")[n]).alias(n) for n in ("one", "two", "mixed", "mean")))


_PERM = "(SELECT p_partkey, range(0, 12) AS a, list_transform(range(0, 12), lambda i: (i * 5 + p_partkey) % 12) AS b, 1 + (p_partkey % 10)::INTEGER AS c1, 1 + (p_partkey % 10)::INTEGER + (p_partkey % 2)::INTEGER AS c2 FROM part)"


@query(f"SELECT p_partkey, list_aggregate(list_concat(a[:c1], list_filter(b, lambda x: x >= c1)), 'string_agg', ',') AS one, list_aggregate(list_concat(list_concat(a[:c1], list_filter(b, lambda x: x >= c1 AND x < c2)), a[c2 + 1:]), 'string_agg', ',') AS two, list_aggregate(list_sort(list_concat(a[:c1], list_filter(b, lambda x: x >= c1))), 'string_agg', ',') AS multi FROM {_PERM}")
def crossover_permutation(spark, d):
    k = (F.col("p_partkey") % 10).cast("int")
    a = F.sequence(F.lit(0), F.lit(11)).cast("array<bigint>")
    b = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: ((i * 5 + F.col("p_partkey")) % 12).cast("long"))
    p = table(spark, d, "part").select("p_partkey", a.alias("a"), b.alias("b"), (1 + k).alias("c1"), (1 + k + (F.col("p_partkey") % 2).cast("int")).alias("c2"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    a, b, c1, c2 = F.col("a"), F.col("b"), F.col("c1"), F.col("c2")
    return p.select("p_partkey", text(evo.permutation_onepoint(a, b, c1)).alias("one"), text(evo.permutation_twopoint(a, b, c1, c2)).alias("two"), text(evo.multiset_onepoint(a, b, c1)).alias("multi"))


@query(f"SELECT p_partkey, list_aggregate(list_transform(range(16), lambda i: CASE WHEN {uniform(chr(39) + chr(39) + ' || p_partkey || ' + chr(39) + '/' + chr(39) + ' || i', '9p')} < 0.25 THEN 1 - i % 2 ELSE i % 2 END), 'string_agg', '') AS bits FROM part")
def mutation_flip(spark, d):
    chain = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: (i % 2).cast("double"))
    return table(spark, d, "part").select("p_partkey", F.array_join(evo.mutate_flip(chain, F.col("p_partkey"), 0.25, 9).cast("array<int>").cast("array<string>"), "").alias("bits"))


@query(f"WITH p AS (SELECT i AS particle, j, v AS x, v / 2 AS v, abs(v) AS b FROM {ENTRIES}), s AS (SELECT *, 0.5 * v + {uniform(chr(39) + chr(39) + ' || particle || ' + chr(39) + '/' + chr(39) + ' || j', '4a')} * (b - x) + 2.0 * {uniform(chr(39) + chr(39) + ' || particle || ' + chr(39) + '/' + chr(39) + ' || j', '4b')} * (0.1 - x) AS w FROM p) SELECT particle, j, round(greatest(-0.2, least(0.2, x + w)), 6) + 0.0 AS x, round(CASE WHEN x + w < -0.2 OR x + w > 0.2 THEN -0.5 * w ELSE w END, 6) + 0.0 AS v FROM s")
def pso_step(spark, d):
    p = frame.entries(vectors(spark, d)).select(F.col("i").alias("particle"), "j", F.col("v").alias("x"), (F.col("v") / 2).alias("v"), F.abs("v").alias("pbest"))
    return evo.swarm_step(p, [0.1] * DIM, low=-0.2, high=0.2, seed=4).select("particle", "j", r6("x").alias("x"), r6("v").alias("v"))


@query("WITH m AS (SELECT avg(value) / 100 AS mean FROM events) SELECT event_id, round(greatest(0, least(1, (event_id % 11) / 10.0::DOUBLE + 0.1 * (value / 100 - mean))), 6) + 0.0 AS pull FROM events, m")
def attraction_update(spark, d):
    e = table(spark, d, "events")
    mean = e.agg((F.avg("value") / 100).alias("mean"))
    rows = e.select("event_id", ((F.col("event_id") % 11) / 10.0).alias("pull"), (F.col("value") / 100).alias("fitness")).crossJoin(F.broadcast(mean))
    return evo.attraction(rows).select("event_id", r6("pull").alias("pull"))


@query("SELECT event_id, round(a, 6) AS accuracy, round(((1 + a) / 2) ** 5, 6) AS power, round(exp(6 * a - 6), 6) AS exponential, round((exp(5 * a) - 1) / (exp(5 * a) + 1), 6) AS \"tanh\" FROM (SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS a FROM events)")
def fitness_shapes(spark, d):
    a = (F.col("event_id") % 101) / 100.0
    return table(spark, d, "events").select("event_id", *(F.round(scalar.fitness_shape(a, k), 6).alias(k) for k in ("accuracy", "power", "exponential", "tanh")))


@query()
def ga_onemax(spark, d):
    """Best fitness of 4 generations that count ones."""
    _, history = evo.Genetic(24, 16, lambda c: float(c.sum() / len(c)), elites=0.1).solve(spark, 4)
    return spark.createDataFrame(list(enumerate(history)), "generation int, best double")


@query()
def pso_sphere(spark, d):
    _, history = evo.Swarm(12, 3, lambda x: -float((x * x).sum()), -2.0, 2.0).solve(spark, 4)
    return spark.createDataFrame(list(enumerate(history)), "iteration int, best double")


@query()
def symbol_search(spark, d):
    _, history = evo.Symbols(16, 20, 5, lambda c: float((c < 5).mean())).solve(spark, 4)
    return spark.createDataFrame(list(enumerate(history)), "generation int, best double")


# ---------------------------------------------------------------- generators


@query(f"SELECT i::BIGINT AS row_id, round(CASE WHEN i % 2 = 0 THEN cos(t) ELSE 1 - cos(t) END + {uniform('i', '1x', -0.1, 0.1)}, 6) + 0.0 AS x0, round(CASE WHEN i % 2 = 0 THEN sin(t) ELSE 0.5 - sin(t) END + {uniform('i', '1y', -0.1, 0.1)}, 6) + 0.0 AS x1, (i % 2)::INTEGER AS label FROM (SELECT i, (i // 2) * (pi() / 249) AS t FROM range(500) r(i))")
def moons(spark, d):
    return generators.moons(spark, 499, 0.1, 1).select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"), "label")


@query(f"SELECT i::BIGINT AS row_id, round((CASE WHEN i % 2 = 0 THEN 1 ELSE 0.75 END) * cos(t) + {uniform('i', '1x', -0.05, 0.05)}, 6) + 0.0 AS x0, round((CASE WHEN i % 2 = 0 THEN 1 ELSE 0.75 END) * sin(t) + {uniform('i', '1y', -0.05, 0.05)}, 6) + 0.0 AS x1, (i % 2)::INTEGER AS label FROM (SELECT i, (i // 2) * (2 * pi() / 250) AS t FROM range(500) r(i))")
def circles(spark, d):
    return generators.circles(spark, 500, 0.05, seed=1).select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"), "label")


_SLASH = "{0} || '/' || {1}"


@query(f"SELECT i::BIGINT AS row_id, j::INTEGER AS j, round({uniform(_SLASH.format('(i % 4)', 'j'), '2c')} * 4 + {uniform(_SLASH.format('i', 'j'), 2, -0.5, 0.5)}, 6) + 0.0 AS v, (i % 4)::INTEGER AS label FROM range(400) r(i), range(3) s(j)")
def blobs(spark, d):
    return generators.blobs(spark, 399, 4, 3, 1.0, 2).select("row_id", F.posexplode("features").alias("j", "v"), "label").withColumn("v", r6("v"))


@query(f"SELECT i::BIGINT AS row_id, round(1.5 * pi() * (1 + 2 * u), 6) AS t, round(1.5 * pi() * (1 + 2 * u) * cos(1.5 * pi() * (1 + 2 * u)), 6) + 0.0 AS x0, round(21 * {uniform('i', '3u')}, 6) AS x1, round(1.5 * pi() * (1 + 2 * u) * sin(1.5 * pi() * (1 + 2 * u)), 6) + 0.0 AS x2 FROM (SELECT i, {uniform('i', '3t')} AS u FROM range(500) r(i))")
def swissroll(spark, d):
    return generators.swiss_roll(spark, 500, 3).select("row_id", *(r6(c).alias(c) for c in ("t", "x0", "x1", "x2")))


@query(f"SELECT i::BIGINT AS row_id, round(t, 6) + 0.0 AS t, round(sin(t), 6) + 0.0 AS x0, round(2 * {uniform('i', '3u')}, 6) AS x1, round(sign(t) * (cos(t) - 1), 6) + 0.0 AS x2 FROM (SELECT i, 3 * pi() * ({uniform('i', '3t')} - 0.5) AS t FROM range(500) r(i))")
def scurve(spark, d):
    return generators.s_curve(spark, 500, 3).select("row_id", *(r6(c).alias(c) for c in ("t", "x0", "x1", "x2")))


@query(f"SELECT i::BIGINT AS row_id, round(sin((i + 1) / 10.0::DOUBLE) + {uniform('i', 4, 0.0, 0.2)}, 6) + 0.0 AS v FROM range(500) r(i)")
def wave(spark, d):
    return generators.wave(spark, 500, 0.2, 10.0, 4).withColumn("v", r6("v"))


@query(f"WITH RECURSIVE s(t, x, h) AS (SELECT -1, 0, []::INTEGER[] UNION ALL SELECT t + 1, b, list_append(h, b) FROM (SELECT t, h, CASE WHEN {uniform('t + 1', 6)} < 0.5 + 0.5 * coalesce(h[len(h) - 2], 0) * (len(h) >= 3)::INTEGER - 0.25 * coalesce(h[len(h) - 7], 0) * (len(h) >= 8)::INTEGER THEN 1 ELSE 0 END AS b FROM s WHERE t < 199)) SELECT t, x FROM s WHERE t >= 0")
def binary_series(spark, d):
    return generators.binary_series(spark, 200, seed=6)


@query("SELECT row_id::BIGINT AS row_id, 2.5::DOUBLE + 0.25 * row_id AS v FROM range(500) r(row_id)")
def sequence(spark, d):
    return generators.sequence(spark, 500, 2.5, 0.25)


@query(f"SELECT event_id, round(CASE WHEN {uniform('event_id', '8r')} < 0.3 THEN {uniform('event_id', 8, -5.0, 5.0)} ELSE value END, 6) + 0.0 AS v FROM events")
def overwrite(spark, d):
    return table(spark, d, "events").select("event_id", r6(generators.overwrite(F.col("value"), F.col("event_id"), -5.0, 5.0, 0.3, 8)).alias("v"))


@query("SELECT row_id, label, (CASE WHEN row_number() OVER (PARTITION BY label ORDER BY row_id) <= floor(count(*) OVER (PARTITION BY label) * 0.4) THEN (label + ('0x' || substr(md5(row_id || ':2'), 1, 8))::BIGINT % 9 + 1) % 10 ELSE label END)::INTEGER AS noisy FROM (SELECT vec_id AS row_id, label FROM embeddings)")
def label_noise(spark, d):
    return generators.label_noise(vectors(spark, d).select("row_id", "label"), "label", 10, 0.4, seed=2)


_ART = "o.x.o\n.ooo.\nx...x\n.xxx."


@query("SELECT (x - 1)::INTEGER AS x, (y - 1)::INTEGER AS y, CASE m WHEN 'o' THEN 0 ELSE 1 END AS label FROM (SELECT y, generate_subscripts(string_split(l, ''), 1) AS x, unnest(string_split(l, '')) AS m FROM (SELECT generate_subscripts(a, 1) AS y, unnest(a) AS l FROM (SELECT string_split('" + _ART + "', chr(10)) AS a))) WHERE m IN ('o', 'x')")
def tiny_art(spark, d):
    return generators.ascii_art(spark, _ART, {"o": 0, "x": 1})


@query(f"SELECT i::BIGINT AS row_id, round(x, 6) + 0.0 AS x0, round(y, 6) + 0.0 AS x1, round(x * x + y * y, 5) + 0.0 AS y FROM (SELECT i, {uniform('i', '5x', -3.0, 3.0)} AS x, {uniform('i', '5y', -3.0, 3.0)} AS y FROM range(500) r(i))")
def regression_set(spark, d):
    g = generators.regression(spark, 500, "unimodal_bowl", -3.0, 3.0, 5)
    return g.select("row_id", r6("x0").alias("x0"), r6("x1").alias("x1"), (F.round("y", 5) + 0.0).alias("y"))


# ---------------------------------------------------------------- extension


@query("SELECT date_trunc('day', ts) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = windowed_stats(table(spark, d, "events"), key="event_type")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))
