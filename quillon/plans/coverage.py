"""Queries of what the other modules of queries leave out: derivatives, bits, layers, searches' pieces, files."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillon.functions import rng, scalar, vec
from quillon.operators import evo, frame, metrics, neighbors, nn, preproc, sample, stats
from quillon.operators.cluster import ClusterMap, InClass, KMeans
from quillon.operators.decomp import eigen
from quillon.sources import files, generators

from .learning import _IMG, _KNN, _SEEDS, _Z, _images, _scores, _seeds  # noqa: F401
from .registry import DIM, ENTRIES, VECTORS, query, r6, table, uniform, vectors

_MD5 = "md5(({0})::VARCHAR || ':{1}')"


def _exploded(df, v, *keys):
    """(keys, j, v) of a vector, to six places."""
    return df.select(*keys, F.posexplode(v).alias("j", "v")).withColumn("v", r6("v"))


def _unnested(v: str, source: str, keys: str = "row_id") -> str:
    return f"SELECT {keys}, (generate_subscripts({v}, 1) - 1)::INTEGER AS j, round(unnest({v}), 6) + 0.0 AS v FROM {source}"


# ---------------------------------------------------------------- scalar functions


@query(f"""SELECT i AS row_id, j, 1.0::DOUBLE AS linear, CASE WHEN v = 0 THEN 0 ELSE round(1 / v, 4) END + 0.0::DOUBLE AS log, CASE WHEN v <> 0 THEN 1.0::DOUBLE ELSE 0 END AS step, round(1 / (1 + exp(-v)), 6) AS softplus,
round(v * (1 - v), 6) + 0.0 AS logistic, round(1 - v * v, 6) + 0.0 AS "tanh", CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END AS relu, round(exp(v), 6) AS "exp" FROM {ENTRIES}""")
def derivatives(spark, d):
    """Of every activation; of logistic, tanh and relu by the function's value."""
    of = lambda name: scalar.ACTIVATIONS[name][1](F.col("v"))
    e = frame.entries(vectors(spark, d)).withColumnRenamed("i", "row_id")
    return e.select("row_id", "j", *((F.round(of(n), 4) + 0.0 if n == "log" else r6(of(n))).alias(n) for n in ("linear", "log", "step", "softplus", "logistic", "tanh", "relu", "exp")))


_XY = "(SELECT event_id, (event_id % 61) / 10.0::DOUBLE - 3 AS x, (event_id % 53) / 10.0::DOUBLE - 2.6 AS y FROM events)"


@query(f"SELECT event_id, round(3 * (1 - x) ** 2 * exp(-x * x - (y + 1) ** 2) - 10 * (x / 5 - x * x * x - y ** 5) * exp(-x * x - y * y) - exp(-((x + 1) ** 2) - y * y) / 3, 6) + 0.0 AS peaks FROM {_XY}")
def peaks(spark, d):
    e = table(spark, d, "events").select("event_id", ((F.col("event_id") % 61) / 10.0 - 3).alias("x"), ((F.col("event_id") % 53) / 10.0 - 2.6).alias("y"))
    return e.select("event_id", r6(scalar.SURFACES["peaks"](F.col("x"), F.col("y"))).alias("peaks"))


_BITS = "(SELECT p_partkey, list_transform(range(8), lambda i: ((p_partkey >> i) & 1)::INTEGER) AS b FROM part)"


@query(f"""SELECT p_partkey, array_to_string(b, '') AS bits, array_to_string(list_transform(range(8), lambda i: CASE WHEN i = 3 THEN 1 - b[i + 1] ELSE b[i + 1] END), '') AS flipped,
array_to_string(list_transform(range(8), lambda i: CASE WHEN i = 5 THEN 1 ELSE b[i + 1] END), '') AS with_bit, '00000000' AS zeros, '11111111' AS ones FROM {_BITS}""")
def bit_vectors(spark, d):
    bits = F.expr("transform(sequence(0, 7), i -> cast(shiftright(p_partkey, i) & 1 AS int))")
    p = table(spark, d, "part").select("p_partkey", bits.alias("b"))
    text = scalar.bit_text
    return p.select("p_partkey", text(F.col("b")).alias("bits"), text(scalar.flip(F.col("b"), 3)).alias("flipped"), text(scalar.set_bit(F.col("b"), 5)).alias("with_bit"), text(scalar.bit_zeros(8)).alias("zeros"), text(scalar.bit_ones(8)).alias("ones"))


@query("SELECT event_id, abs(value - 100) <= 5 AS near, (event_id % 5) * 2 + 1 AS kernel, ((event_id % 5) * 2)::INTEGER // 2 AS padding FROM events")
def tolerance(spark, d):
    e = table(spark, d, "events")
    kernel = (F.col("event_id") % 5) * 2 + 1
    padding = F.element_at(F.lit([scalar.same_padding(2 * k + 1) for k in range(5)]), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", scalar.close_to_zero(F.col("value") - 100, 5).alias("near"), kernel.alias("kernel"), padding.alias("padding"))


# ---------------------------------------------------------------- vectors and matrices


@query(f"SELECT i AS row_id, j, 1.5::DOUBLE AS filled, round(v * 2, 6) + 0.0 AS copied, round(v * -0.5, 6) + 0.0 AS scaled FROM {ENTRIES}")
def fill_copy_scale(spark, d):
    f = F.col("features")
    z = F.arrays_zip(vec.filled(DIM, 1.5).alias("filled"), vec.copied(f, 2.0).alias("copied"), vec.scale(f, -0.5).alias("scaled"))
    return vectors(spark, d).select("row_id", F.posexplode(z).alias("j", "z")).select("row_id", "j", *(r6(F.col("z")[n]).alias(n) for n in ("filled", "copied", "scaled")))


@query(f"SELECT row_id, round(features[3], 6) + 0.0 AS third, round(features[64], 6) + 0.0 AS last, round(features[2], 6) + 0.0 AS swapped FROM {VECTORS}")
def elements(spark, d):
    f = F.col("features")
    return vectors(spark, d).select("row_id", r6(vec.element(f, 2)).alias("third"), r6(vec.element(f, -1)).alias("last"), r6(vec.element(vec.swap_elements(f, 1, 5), 5)).alias("swapped"))


@query(f"SELECT row_id, (i - 1)::INTEGER AS i, (j - 1)::INTEGER AS j, round(features[i] * features[4 + j], 6) + 0.0 AS v FROM {VECTORS}, range(1, 5) a(i), range(1, 5) b(j)")
def outer_rows(spark, d):
    f = F.col("features")
    v = vectors(spark, d).select("row_id", vec.copy_range(f, 0, 4).alias("a"), vec.copy_range(f, 4, 4).alias("b"))
    return frame.outer_rows(v, "a", "b").withColumn("v", r6("v"))


@query(_unnested("list_reverse(features)", VECTORS))
def rot180(spark, d):
    return _exploded(vectors(spark, d), vec.rot180(F.col("features")), "row_id")


@query(f"WITH n AS (SELECT count(*) AS n FROM {VECTORS}) SELECT row_id, label FROM {VECTORS} UNION ALL SELECT row_id + n, label + 100 FROM {VECTORS}, n")
def append(spark, d):
    v = vectors(spark, d).select("row_id", "label")
    return frame.append(v, v.withColumn("label", F.col("label") + 100))


@query(f"SELECT a.row_id AS row_id, b.label AS label FROM {VECTORS} a JOIN (SELECT features, label FROM {VECTORS} WHERE row_id = 0) b ON a.features = b.features")
def find_row(spark, d):
    """Rows equal to the first row, a point."""
    v = vectors(spark, d)
    first = v.where("row_id = 0").first()
    return neighbors.find_row(v, first.features).withColumn("label", F.lit(first.label))


# ---------------------------------------------------------------- splits and orders

_SHUFFLED = f"(SELECT row_id, label, row_number() OVER (ORDER BY {_MD5.format('row_id', 3)}, row_id) - 1 AS pos FROM {VECTORS})"


@query(f"SELECT row_id, CASE WHEN pos < 300 THEN 'train' ELSE 'test' END AS part FROM {_SHUFFLED}")
def split_counts(spark, d):
    train, test = sample.train_test(sample.shuffled(vectors(spark, d).select("row_id"), seed=3), 300)
    return train.select("row_id", F.lit("train").alias("part")).unionByName(test.select("row_id", F.lit("test").alias("part")))


@query(f"SELECT row_id, row_id AS kept, row_number() OVER (ORDER BY {_MD5.format('row_id', 48)}, row_id) - 1 AS same, row_number() OVER (ORDER BY {_MD5.format('row_id', 52)}, row_id) - 1 AS new FROM {VECTORS}")
def epoch_orders(spark, d):
    """The third epoch's order by strategy."""
    v = vectors(spark, d).select("row_id")
    of = lambda strategy, name: sample.epoch_order(v, strategy, 3).select("row_id", F.col("pos").alias(name))
    return of("none", "kept").join(of("deterministic", "same"), "row_id").join(of("stochastic", "new"), "row_id")


@query("SELECT c_custkey AS member_id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos FROM customer")
def population_order(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), F.col("c_acctbal").alias("fitness"))
    return frame.number_rows(p, F.desc("fitness"), F.col("member_id"), name="pos").select("member_id", "pos")


@query("SELECT c_custkey AS member_id, c_acctbal AS fitness FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def bounded_best(spark, d):
    """The operator's feature is the bound: the 25 best."""
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), F.col("c_acctbal").alias("fitness"))
    return neighbors.best(p, 25, F.desc("fitness"), F.col("member_id"))


# ---------------------------------------------------------------- statistics and evaluation


@query(f"SELECT row_id, (SELECT count(*) FROM (SELECT unnest([label, row_id % 3, row_id % 5]) AS a, unnest([label, row_id % 2, row_id % 4]) AS b) WHERE a = b) AS same, (SELECT count(*) FROM (SELECT unnest([label, row_id % 3, row_id % 5]) AS a, unnest([label, row_id % 2, row_id % 4]) AS b) WHERE a = b AND a <> 0) AS known FROM {VECTORS}")
def count_equal(spark, d):
    a, b = (vec.vector(F.array(F.col("label").cast("long"), F.col("row_id") % m, F.col("row_id") % n)) for m, n in ((3, 5), (2, 4)))
    return vectors(spark, d).select("row_id", vec.count_equal(a, b).alias("same"), vec.count_equal(a, b, 0).alias("known"))


@query(f"SELECT row_id, round((SELECT count(*) FROM (SELECT unnest([1 + label % 2, row_id % 3, row_id % 5]) AS a, unnest([1, row_id % 2, row_id % 4]) AS b) WHERE a = b AND a <> 0) / (1 + label % 2 + row_id % 3 + row_id % 5)::DOUBLE, 6) AS accuracy FROM {VECTORS}")
def multilabel_known(spark, d):
    a = F.array((1 + F.col("label") % 2).cast("long"), F.col("row_id") % 3, F.col("row_id") % 5)
    b = F.array(F.lit(1).cast("long"), F.col("row_id") % 2, F.col("row_id") % 4)
    return vectors(spark, d).select("row_id", F.round(metrics.multilabel_accuracy(a, b), 6).alias("accuracy"))


@query(f"SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae FROM (SELECT unnest(features) - unnest(list_reverse(features)) AS e FROM {VECTORS})")
def matrix_errors(spark, d):
    v = vectors(spark, d).select("features", F.reverse("features").alias("p"))
    return metrics.matrix_errors(v, "features", "p").select(*(F.round(c, 6).alias(c) for c in ("mse", "rmse", "mae")))


@query("""WITH x AS (SELECT value::DOUBLE AS x FROM events WHERE value IS NOT NULL), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS w FROM x), c AS (SELECT least(9, floor((x - lo) / w))::INTEGER AS bin, count(*) AS n FROM x, e GROUP BY 1),
g AS (SELECT b::INTEGER AS bin, coalesce(n, 0) AS n FROM range(10) r(b) LEFT JOIN c ON c.bin = r.b) SELECT bin, n, repeat('█', floor(n * 40.0::DOUBLE / (SELECT max(n) FROM g))::INTEGER) AS bar FROM g""")
def histogram_text(spark, d):
    return stats.graphic(stats.histogram(table(spark, d, "events"), F.col("value"), 10))


def _weights(spark, d):
    return frame.entries(vectors(spark, d)).join(vectors(spark, d).select(F.col("row_id").alias("i"), F.col("label").alias("layer")), "i").withColumnRenamed("v", "w")


_WEIGHTS = f"(SELECT label AS layer, row_id AS i, (generate_subscripts(features, 1) - 1)::INTEGER AS j, unnest(features) AS w FROM {VECTORS})"


@query(f"SELECT layer, count(*) AS n, round(var_pop(w), 6) AS variance, round(sqrt(sum(w * w)), 6) AS norm, round(min(w), 6) + 0.0 AS least, round(max(w), 6) + 0.0 AS most FROM {_WEIGHTS} GROUP BY layer")
def weight_statistics(spark, d):
    """Of layers of weights: embeddings by label."""
    s = nn.weight_statistics(_weights(spark, d))
    return s.select("layer", "n", *(r6(c).alias(c) for c in ("variance", "norm", "least", "most")))


@query(f"WITH w AS {_WEIGHTS}, e AS (SELECT layer, min(w) AS lo, max(w) AS hi FROM w GROUP BY layer) SELECT layer, least(19, floor((w - lo) * 20 / (hi - lo)))::INTEGER AS bin, count(*) AS n FROM w JOIN e USING (layer) GROUP BY 1, 2")
def weight_histogram(spark, d):
    return nn.weight_histogram(_weights(spark, d))


@query(f"SELECT layer, i, round(sum(w * w), 6) AS energy FROM {_WEIGHTS} GROUP BY 1, 2")
def filter_energy(spark, d):
    return nn.filter_energy(_weights(spark, d)).withColumn("energy", F.round("energy", 6))


@query(f"SELECT row_number() OVER (ORDER BY layer, i, j) - 1 AS pos, round(w, 6) + 0.0 AS w FROM {_WEIGHTS}")
def flat_weights(spark, d):
    """A network's weights as a chain."""
    return nn.flat_weights(_weights(spark, d)).withColumn("w", r6("w"))


_CHAIN = f"(SELECT i * 64 + j AS pos, v AS w FROM {ENTRIES})"


@query(f"SELECT 0 AS layer, (pos // 64)::INTEGER AS i, (pos % 64)::INTEGER AS j, round(w, 6) + 0.0 AS w FROM {_CHAIN} WHERE pos < 3200 UNION ALL SELECT 1, ((pos - 3200) // 32)::INTEGER, ((pos - 3200) % 32)::INTEGER, round(w, 6) + 0.0 FROM {_CHAIN} WHERE pos BETWEEN 3200 AND 4479")
def shaped_weights(spark, d):
    """A chain as the weights of two layers of 50 x 64 and 40 x 32."""
    chain = frame.entries(vectors(spark, d)).select((F.col("i") * DIM + F.col("j")).alias("pos"), F.col("v").alias("w"))
    return nn.shaped_weights(chain, [(50, 64), (40, 32)]).withColumn("w", r6("w"))


# ---------------------------------------------------------------- clusters and components


@query("SELECT k::INTEGER AS cluster, count(*) AS n FROM (SELECT row_id, arg_min(k, (list_distance(features, c), k)) AS k FROM " + VECTORS + ", " + _SEEDS + " GROUP BY row_id) GROUP BY 1")
def kmeans_predict(spark, d):
    """Rows of each cluster by given centroids."""
    v, seeds = vectors(spark, d), _seeds(spark, d)
    return KMeans(len(seeds)).seeded(seeds).info(v)


@query(f"""WITH a AS (SELECT row_id, label, k, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(features, c), k) AS r FROM {VECTORS}, {_SEEDS}),
m AS (SELECT k, arg_min(label, (-n, label)) AS p FROM (SELECT k, label, count(*) AS n FROM a WHERE r = 1 GROUP BY 1, 2) GROUP BY k),
b AS (SELECT row_id, k, row_number() OVER (PARTITION BY row_id ORDER BY r) AS r FROM a WHERE k IN (SELECT k FROM m))
SELECT row_id, arg_min(p, (-n, p)) AS predicted FROM (SELECT row_id, p, count(*) AS n FROM b JOIN m USING (k) WHERE r <= 3 GROUP BY 1, 2) GROUP BY row_id""")
def centroid_knn(spark, d):
    """Majority of the three nearest centroids' classes."""
    v = vectors(spark, d)
    return v.select("row_id", ClusterMap(_seeds(spark, d)).fit(v).vote(F.col("features"), 3).alias("predicted"))


@query(f"""WITH s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS k, features AS c FROM {VECTORS} QUALIFY k < 2),
a AS (SELECT row_id, v.label, features, arg_min(k, (list_distance(features, c), k)) AS k FROM {VECTORS} v JOIN s ON v.label = s.label GROUP BY 1, 2, 3),
m AS (SELECT label, k, list(m ORDER BY j) AS c FROM (SELECT label, k, j, avg(x) AS m FROM (SELECT label, k, generate_subscripts(features, 1) AS j, unnest(features) AS x FROM a) GROUP BY 1, 2, 3) GROUP BY 1, 2),
n AS (SELECT s.label, s.k, coalesce(m.c, s.c) AS c FROM s LEFT JOIN m ON m.label = s.label AND m.k = s.k)
SELECT label, k::INTEGER AS cluster, count(*) AS n FROM (SELECT row_id, v.label, arg_min(k, (list_distance(features, c), k)) AS k FROM {VECTORS} v JOIN n ON v.label = n.label GROUP BY 1, 2) GROUP BY 1, 2""")
def in_class_clusters(spark, d):
    """Clusters within each class after one iteration from its first two rows."""
    v = vectors(spark, d)
    seeds: dict = {}
    for r in neighbors.top_k(v, 2, ["label"], F.col("row_id")).orderBy("row_id").collect():  # two rows a class
        seeds.setdefault(r.label, []).append(r.features)
    return InClass(2, tolerance=-1, max_iterations=1).fit(v, seeds=seeds).info(v)


@query("SELECT k::INTEGER AS k, 0.0::DOUBLE AS residual, 1.0::DOUBLE AS norm, true AS ordered FROM range(64) t(k)")
def eigen_pairs(spark, d):
    """What an eigenpair must fulfil: S v = w v, of norm 1, values descending."""
    s = np.zeros((DIM, DIM))
    for r in stats.covariance(vectors(spark, d), DIM).collect():  # DIM x DIM rows
        s[r.i, r.j] = r["cov"]
    w, v = eigen(s)
    residual, norm = np.linalg.norm(s @ v - v * w, axis=0), np.linalg.norm(v, axis=0)
    rows = [(k, round(float(residual[k]), 6) + 0.0, round(float(norm[k]), 6), k == 0 or bool(w[k] <= w[k - 1])) for k in range(DIM)]
    return spark.createDataFrame(rows, "k int, residual double, norm double, ordered boolean")


# ---------------------------------------------------------------- networks


@query(f"SELECT row_id, round(list_sum(features), 6) + 0.0 AS total FROM {VECTORS}")
def input_layer(spark, d):
    """A network without layers gives its input."""
    return nn.Network((DIM,), []).predict(vectors(spark, d)).select("row_id", r6(vec.total(F.col("output"))).alias("total"))


@query(f"SELECT row_id, (generate_subscripts(z, 1) - 1)::INTEGER AS j, round(1 / (1 + exp(-unnest(z))), 6) AS v FROM (SELECT row_id, {_Z} AS z FROM {VECTORS})")
def sigmoid_layer(spark, d):
    return _exploded(_scores(spark, d, "logistic"), F.col("z"), "row_id")


@query(f"SELECT i AS row_id, j, CASE WHEN {uniform(chr(39) + chr(39) + ' || i || ' + chr(39) + '/' + chr(39) + ' || j', 7)} < 0.25 THEN 0.0 ELSE round(v / 0.75, 6) END + 0.0::DOUBLE AS v FROM {ENTRIES}")
def dropout(spark, d):
    return _exploded(vectors(spark, d), nn.dropout(F.col("features"), F.col("row_id"), 0.25, 7), "row_id")


@query(f"SELECT id, y - a AS y, x - b AS x, (a * 3 + b)::INTEGER AS t, round(v, 6) + 0.0 AS v FROM {_IMG}, range(3) p(a), range(3) q(b) WHERE y - a BETWEEN 0 AND 5 AND x - b BETWEEN 0 AND 5")
def image_patches(spark, d):
    return nn.image_patches(_images(spark, d), 3, 8, 8).withColumn("t", F.col("t").cast("int")).withColumn("v", r6("v"))


@query(f"SELECT id, a::BIGINT AS y, b::BIGINT AS x, round(max(v), 6) + 0.0 AS v, arg_min(y, (-v, y, x)) AS at_y, arg_min(x, (-v, y, x)) AS at_x FROM {_IMG}, range(3) p(a), range(3) q(b) WHERE y BETWEEN 2 * a AND 2 * a + 2 AND x BETWEEN 2 * b AND 2 * b + 2 GROUP BY 1, 2, 3")
def maxpool_stride(spark, d):
    """Windows of 3 x 3 at stride 2, with the places of the largest."""
    return nn.max_pool(_images(spark, d), 3, 2, (8, 8)).withColumn("v", r6("v"))


_SOFTMAX = "list_transform({0}, lambda x: exp((x - list_max({0})) / {1}) / list_sum(list_transform({0}, lambda q: exp((q - list_max({0})) / {1}))))"
_KD = f"(SELECT label, {_SOFTMAX.format('z', '1.0')} AS s, {_SOFTMAX.format('z', '4.0')} AS ss, list_reverse({_SOFTMAX.format('z', '4.0')}) AS st FROM (SELECT label, list_transform({_Z}, lambda x: x * 0.1) AS z FROM {VECTORS}))"


@query(f"SELECT round(sum(0.1 * -ln(s[label + 1]) + 0.9 * -list_sum(list_transform(range(1, 11), lambda i: st[i] * ln(ss[i])))), 3) AS loss FROM {_KD}")
def distillation(spark, d):
    """The loss of a student whose teacher has its scores the other way round."""
    s = _scores(spark, d).select("label", F.transform("z", lambda x: x * 0.1).alias("z"))
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1.0).otherwise(0.0))
    return s.agg(F.round(F.sum(nn.distillation(hot, F.reverse("z"), F.col("z"), 0.1, 4.0)), 3).alias("loss"))


@query(f"SELECT row_id, (generate_subscripts(t, 1) - 1)::INTEGER AS j, round(unnest(t), 6) + 0.0 AS v FROM (SELECT row_id, list_concat(list_transform(range(10), lambda i: (i = label)::INTEGER::DOUBLE), {_Z}) AS t FROM {VECTORS})")
def kd_target(spark, d):
    hot = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.when(i == F.col("label"), 1).otherwise(0))
    return _exploded(_scores(spark, d), preproc.distillation_target(hot, F.col("z")), "row_id")


@query(f"SELECT n_nationkey AS pos, layer, round(w, 6) + 0.0 AS w FROM nation JOIN (SELECT label AS layer, row_id, list_sum(features) AS w FROM {VECTORS}) ON row_id = (n_nationkey * 7) % 50")
def filter_transfer(spark, d):
    """Filters of a teacher at the places of a chain that picks them."""
    teacher = vectors(spark, d).select(F.col("label").alias("layer"), F.col("row_id").alias("j"), vec.total(F.col("features")).alias("w"))
    chain = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), ((F.col("n_nationkey") * 7) % 50).cast("long").alias("j"))
    return nn.transfer(teacher, chain).select(F.col("j").alias("pos"), "layer", r6("w").alias("w"))


# ---------------------------------------------------------------- pieces of evolution

_KEY = "'' || m || '/' || i"
_MEMBER = "(SELECT s_suppkey AS m, i FROM supplier, range(6) r(i))"


@query(f"""SELECT m AS member_id, i::INTEGER AS j, 0.0::DOUBLE AS none, round({uniform(_KEY, 1, -1.0, 2.0)}, 6) + 0.0 AS uniform, CASE WHEN {uniform(_KEY, 2)} < 0.5 THEN 0.0::DOUBLE ELSE 1 END AS bool,
round(1 + 0.5 * sqrt(-2 * ln(greatest({uniform(_KEY, '3a')}, 1e-12))) * cos(2 * pi() * {uniform(_KEY, '3b')}), 6) + 0.0 AS gauss,
(list(i) OVER (PARTITION BY m ORDER BY {_MD5.format(_KEY, 4)} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))[i + 1]::DOUBLE AS permutation FROM {_MEMBER}""")
def initial_chains(spark, d):
    m = F.col("m")
    z = F.arrays_zip(evo.init_null(6).alias("none"), evo.init_uniform(m, 6, -1.0, 2.0, 1).alias("uniform"), evo.init_bool(m, 6, 2).alias("bool"), evo.init_normal(m, 6, 1.0, 0.5, 3).alias("gauss"), evo.init_permutation(m, 6, 0, 4).alias("permutation"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("m"))
    return s.select(F.col("m").alias("member_id"), F.posexplode(z).alias("j", "z")).select("member_id", "j", *(r6(F.col("z")[n]).alias(n) for n in ("none", "uniform", "bool", "gauss", "permutation")))


_GENE = f"(SELECT p_partkey AS m, i, i * 1.0::DOUBLE AS x, 1 + p_partkey % 3 AS a, 4 + p_partkey % 2 AS b FROM part, range(6) r(i))"


@query(f"""SELECT m AS p_partkey, i::INTEGER AS j, round(x + CASE WHEN {uniform(_KEY, '1p')} < 0.4 THEN {uniform(_KEY, 1, -1.0, 1.0)} ELSE 0 END, 6) + 0.0 AS added, round(CASE WHEN {uniform(_KEY, '2p')} < 0.4 THEN {uniform(_KEY, 2, -1.0, 1.0)} ELSE x END, 6) + 0.0 AS replaced,
round(CASE WHEN {uniform(_KEY, '3p')} < 0.4 THEN greatest(0, least(4, x + 0.5 * sqrt(-2 * ln(greatest({uniform(_KEY, '3a')}, 1e-12))) * cos(2 * pi() * {uniform(_KEY, '3b')}))) ELSE x END, 6) + 0.0 AS gauss,
CASE WHEN i = a THEN b ELSE CASE WHEN i = b THEN a ELSE i END END::DOUBLE AS swapped FROM {_GENE}""")
def mutations(spark, d):
    m = F.col("p_partkey")
    chain = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: i.cast("double"))
    a, b = (1 + m % 3).cast("int"), (4 + m % 2).cast("int")
    z = F.arrays_zip(
        evo.mutate_add(F.col("c"), m, 0.4, -1.0, 1.0, 1).alias("added"), evo.mutate_replace(F.col("c"), m, 0.4, -1.0, 1.0, 2).alias("replaced"),
        evo.mutate_normal(F.col("c"), m, 0.4, 0.5, 3, 0.0, 4.0).alias("gauss"), evo.mutate_swap(F.col("c"), a, b).alias("swapped"),
    )
    p = table(spark, d, "part").select("p_partkey", chain.alias("c"))
    return p.select("p_partkey", F.posexplode(z).alias("j", "z")).select("p_partkey", "j", *(r6(F.col("z")[n]).alias(n) for n in ("added", "replaced", "gauss", "swapped")))


@query("""SELECT p_partkey, array_to_string(CASE WHEN list_contains(c, s) THEN c ELSE list_sort(list_transform(range(4), lambda k: CASE WHEN k = p_partkey % 4 THEN s ELSE c[k + 1] END)) END, ',') AS multi
FROM (SELECT p_partkey, [1, 3, 5, 7] AS c, p_partkey % 9 AS s FROM part)""")
def mutation_multiset(spark, d):
    chain = F.lit([1, 3, 5, 7]).cast("array<bigint>")
    p = table(spark, d, "part").select("p_partkey", chain.alias("c"))
    out = evo.mutate_multiset_replace(F.col("c"), (F.col("p_partkey") % 4).cast("int"), (F.col("p_partkey") % 9).cast("long"))
    return p.select("p_partkey", F.array_join(out.cast("array<string>"), ",").alias("multi"))


@query("""WITH p AS (SELECT p_partkey, list_transform(range(5), lambda i: (i * 3 + p_partkey) % 11) AS a, list_transform(range(5), lambda i: (i * 2 + p_partkey) % 11) AS b FROM part),
u AS (SELECT p_partkey, a, list_concat(list_concat(list_transform(range(5), lambda i: CASE WHEN i % 2 = p_partkey % 2 THEN b[i + 1] ELSE a[i + 1] END), a), b) AS l FROM p),
q AS (SELECT p_partkey, x, min(k) AS k FROM (SELECT p_partkey, generate_subscripts(l, 1) AS k, unnest(l) AS x FROM u) GROUP BY 1, 2)
SELECT p_partkey, string_agg(x::VARCHAR, ',' ORDER BY x) AS multi FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY k) AS r FROM q) WHERE r <= 5 GROUP BY 1""")
def crossover_multiset(spark, d):
    """Uniform crossover of sets."""
    m = F.col("p_partkey")
    of = lambda step: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: ((i * step + m) % 11).cast("long"))
    mask = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i % 2 == m % 2, 1).otherwise(0))
    p = table(spark, d, "part").select("p_partkey", of(3).alias("a"), of(2).alias("b"), mask.alias("mask"))
    return p.select("p_partkey", F.array_join(evo.multiset_uniform(F.col("a"), F.col("b"), F.col("mask")).cast("array<string>"), ",").alias("multi"))


@query(f"""WITH p AS (SELECT c_custkey AS m, 1 + abs(c_acctbal) AS f FROM customer), c AS (SELECT m, f, sum(f) OVER (ORDER BY m) AS hi FROM p), t AS (SELECT sum(f) AS a FROM p),
x AS (SELECT s_suppkey AS child, {uniform('s_suppkey', 5)} * a AS s, {uniform('s_suppkey', 6)} AS w, a FROM supplier, t), y AS (SELECT child, m, f, hi, w * (a - f) AS s2 FROM x JOIN c ON hi - f < s AND s <= hi),
z AS (SELECT child, m, s2 + CASE WHEN s2 > hi - f THEN f ELSE 0 END AS s2 FROM y) SELECT child, z.m AS first, c.m AS second FROM z JOIN c ON c.hi - c.f < s2 AND s2 <= c.hi""")
def distinct_parents(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("member_id"), (1 + F.abs("c_acctbal")).alias("fitness"))
    k = F.col("s_suppkey")
    return evo.parents(p, table(spark, d, "supplier").select(k.alias("child"), rng.uniform(k, 5).alias("u"), rng.uniform(k, 6).alias("w")))


# ---------------------------------------------------------------- sets and files


@query(f"SELECT t::INTEGER AS t, v FROM (SELECT generate_subscripts(l, 1) - 1 AS t, unnest(l) AS v FROM (SELECT {generators.SHAMPOO}::DOUBLE[] AS l))")
def shampoo(spark, d):
    return generators.shampoo(spark)


@query("SELECT m, x::INTEGER AS x, y::INTEGER AS y, (x > y)::INTEGER AS label FROM range(10) a(x), range(10) b(y), (SELECT unnest([1, 3]) AS m) WHERE abs(x - y) >= m")
def linear_sets(spark, d):
    of = lambda m: generators.linear_set(spark, m).select(F.lit(m).alias("m"), "x", "y", "label")
    return of(1).unionByName(of(3))


@query("SELECT k AS kind, a::DOUBLE AS x0, b::DOUBLE AS x1, CASE WHEN k = 'or' THEN (a + b > 0)::INTEGER ELSE (a <> b)::INTEGER END AS y FROM range(2) p(a), range(2) q(b), (SELECT unnest(['or', 'xor']) AS k)")
def truth_tables(spark, d):
    of = lambda k: generators.truth_table(spark, k).select(F.lit(k).alias("kind"), "x0", "x1", "y")
    return of("or").unionByName(of("xor"))


def _file(spark, data: bytes) -> str:
    """A new file in the folder that all executors share; the tables written here have 25 rows at every size."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="quillon-")
    path = f"{folder.rstrip('/')}/quillon-file-{uuid.uuid4().hex}"
    files.put(spark, path, data)
    return path


def _nations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows


_NATION = "(SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_nationkey, n_name, n_regionkey FROM nation)"


@query(f"SELECT row_id, (generate_subscripts(f, 1) - 1)::INTEGER AS j, unnest(f) AS v FROM (SELECT row_id, [n_nationkey::DOUBLE, row_id::DOUBLE, CASE WHEN n_regionkey = 0 THEN -1 ELSE n_regionkey + 0.5 END] AS f FROM {_NATION})")
def csv_coded(spark, d):
    """Numbers, texts as codes in order of their first rows, empty cells, numbers that text follows, comments."""
    lines = ["# nations", " key ; name;region ", ""]
    for r in _nations(spark, d):
        lines += [f"{r.n_nationkey}; {r.n_name} ;{'' if r.n_regionkey == 0 else f'{r.n_regionkey}.5 east'}", "  # more"]
    df, names = files.read_coded(spark, _file(spark, "\n".join(lines).encode()), ";", nanval=-1)
    if names != ["key", "name", "region"]:
        raise ValueError(names)
    return df.select("row_id", F.posexplode("features").alias("j", "v"))


@query(f"""SELECT 'matrix' AS kind, row_id, j::INTEGER AS j, CASE j WHEN 0 THEN n_nationkey ELSE n_regionkey END::DOUBLE AS v FROM {_NATION}, range(2) r(j)
UNION ALL SELECT 'images', row_id, j::INTEGER, ((n_nationkey * 9 + n_regionkey * j) % 256)::DOUBLE FROM {_NATION}, range(4) r(j) UNION ALL SELECT 'labels', row_id, 0, n_regionkey::DOUBLE FROM {_NATION}
UNION ALL SELECT 'records', row_id, j::INTEGER, CASE WHEN j = 0 THEN n_regionkey ELSE (n_nationkey * 9 + n_regionkey * (j - 1)) % 256 END::DOUBLE FROM {_NATION}, range(5) r(j)""")
def binary_files(spark, d):
    """Raw matrices, image files with their labels and fixed records, written and read back."""
    rows = _nations(spark, d)
    key, region = np.array([r.n_nationkey for r in rows]), np.array([r.n_regionkey for r in rows])
    pixels = (key[:, None] * 9 + region[:, None] * np.arange(4)) % 256
    n = len(rows)
    exploded = lambda df, kind, v: df.select(F.lit(kind).alias("kind"), "row_id", F.posexplode(v).alias("j", "v"))
    matrix = files.read_matrix(spark, _file(spark, files.matrix_bytes(np.stack([key, region], 1))), n, 2)
    images = files.read_idx_images(spark, _file(spark, files.idx_images(pixels, 2, 2)))
    labels = files.read_idx_labels(spark, _file(spark, files.idx_labels(region)))
    records = files.read_records(spark, _file(spark, np.concatenate([region[:, None], pixels], 1).astype(np.uint8).tobytes()), 4)
    out = exploded(matrix, "matrix", "features").unionByName(exploded(images, "images", "features"))
    out = out.unionByName(labels.select(F.lit("labels").alias("kind"), "row_id", F.lit(0).alias("j"), F.col("label").cast("double").alias("v")))
    return out.unionByName(exploded(records, "records", F.concat(F.array(F.col("label").cast("double")), "features")))


@query(f"SELECT row_id, j, round(adam, 6) + 0.0 AS adam, round(momentum, 6) + 0.0 AS momentum FROM (SELECT i AS row_id, j, v - 0.01 * (v / (sqrt(v * v) + 1e-8)) AS adam, v - 0.1 * v AS momentum FROM {ENTRIES})")
def first_steps(spark, d):
    """The first step of two rules, whose gradients are the weights."""

    def run(arrow):
        for b in arrow:
            v = b.column("v").to_numpy(zero_copy_only=False)
            out = []
            for step in (nn.Step("adam", 0.01), nn.Step("momentum", 0.1)):
                p = v.copy()
                step([p], [v])
                out.append(pa.array(p))
            yield pa.RecordBatch.from_arrays([b.column("row_id"), b.column("j"), *out], ["row_id", "j", "adam", "momentum"])

    e = frame.entries(vectors(spark, d)).select(F.col("i").alias("row_id"), "j", "v")
    return e.mapInArrow(run, "row_id long, j int, adam double, momentum double").select("row_id", "j", r6("adam").alias("adam"), r6("momentum").alias("momentum"))
