"""Golden examples and properties of the library's own operators."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import rng, scalar, vec
from quillon.operators import evo, frame, metrics, neighbors, nn, preproc, sample, stats
from quillon.operators.cluster import ClusterMap, KMeans
from quillon.operators.decomp import Pca
from quillon.sources import files, generators


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def array(*x):
    return F.lit([float(v) for v in x])


def test_arg_and_one_hot(spark):
    v = array(4, -3, 10, 2, 5)
    assert one(spark, vec.argmax(v), vec.argmin(v), vec.one_hot_argmax(v))[0:3] == (2, 1, [0.0, 0.0, 1.0, 0.0, 0.0])


def test_activations_and_surfaces(spark):
    x = F.lit
    r = one(spark, scalar.safe_log(x(0.0)), scalar.safe_log(x(-1.0)), scalar.SURFACES["easom"](x(math.pi), x(math.pi)), scalar.SURFACES["ackley"](x(0.0), x(0.0)), scalar.SURFACES["himmelblau"](x(3.0), x(2.0)), scalar.SURFACES["eggholder"](x(512.0), x(404.2319)))
    assert r[0] == 0 and math.isnan(r[1]) and r[2] == pytest.approx(-1) and r[3] == pytest.approx(0, abs=1e-9) and r[4] == 0 and r[5] == pytest.approx(-959.6407, abs=1e-4)


def test_encoders(spark):
    df = spark.createDataFrame(list(enumerate(["A", "B", "D", "A", "D", "", None])), "row_id long, s string")
    enc = preproc.StringEncoder.fit(df, "s", "row_id", 1)
    assert [r.code for r in enc.encode(df, "s").orderBy("row_id").collect()] == [1, 2, 3, 1, 3, None, None]
    other = spark.createDataFrame([(0, "A"), (1, "Z"), (2, "Y")], "row_id long, s string")
    assert enc.first_unknown(other, "s", "row_id").first()[0] == 1
    y = spark.createDataFrame([(1,), (2,), (3,), (3,)], "y int")
    for drop, want in ((False, [[1, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1]]), (True, [[0, 0], [1, 0], [0, 1], [0, 1]])):
        o = preproc.OneHot.fit(y, "y", drop)
        rows = y.select("y", o.encode(F.col("y")).alias("v")).select("y", "v", o.decode(F.col("v")).alias("back")).collect()
        assert [r.v for r in rows] == want and all(r.y == r.back for r in rows)
    assert [r[0] for r in spark.createDataFrame([(2,), (0,)], "l int").select(preproc.binary(F.col("l"), 2)).collect()] == [1, -1]


def test_scalers_round_trip_and_constant_columns(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(10)], "a double, b double")
    for s in (preproc.min_max(df, ["a", "b"]), preproc.min_max(df, ["a", "b"], True), preproc.standard(df, ["a", "b"])):
        out = s.transform(df).collect()
        assert all(r.b is None for r in out)
        assert sorted(r.a for r in s.inverse(s.transform(df)).collect()) == pytest.approx(list(range(10)))


def test_rows(spark):
    df = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") * 10).alias("v"))
    assert sorted(r.v for r in frame.slice_rows(df, -3, 2).collect()) == [70, 80]
    index = spark.createDataFrame([(0, 3), (1, 3), (2, 9)], "pos long, row_id long")
    assert [r.v for r in frame.gather(df, index).orderBy("row_id").collect()] == [30, 30, 90]
    assert frame.exclude_rows(df, index).count() == 8
    with pytest.raises(ValueError):
        frame.drop_columns(df, [2])
    with pytest.raises(ValueError):
        frame.slice_rows(df, -30, 2)
    u = spark.createDataFrame(list(enumerate([3, 1, 1, 4, 5, 3])), "row_id long, v int")
    assert [r.value for r in frame.uniques(u, "v").orderBy("first").collect()] == [3, 1, 4, 5]
    assert sorted(r.row_id for r in frame.append(df, df).collect()) == list(range(20))


def test_bilinear_of_every_image(spark):
    from quillon.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    images = {r.vec_id: np.array(r.embedding, float).reshape(8, 8) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {(r.row_id, r.i, r.j): r.v for r in QUERIES["bilinear_all"](spark, sf).collect()}
    assert len(got) == 25 * len(images) > 25
    for (k, i, j), v in got.items():
        y, x = i * 7 / 4, j * 7 / 4
        y0, x0 = int(y), int(x)
        y1, x1, m = min(y0 + 1, 7), min(x0 + 1, 7), images[k]
        want = (1 - y + y0) * ((1 - x + x0) * m[y0, x0] + (x - x0) * m[y0, x1]) + (y - y0) * ((1 - x + x0) * m[y1, x0] + (x - x0) * m[y1, x1])
        assert v == pytest.approx(want, abs=2e-6)


def test_variance_windows_of_points_in_the_whole_table(spark):
    from quillon.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    v = {}
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        e = np.exp(np.array(r.embedding, float) - max(r.embedding))
        v[r.vec_id] = (r.label, (e / e.sum()).var(ddof=1))
    want = {i for i, (k, x) in v.items() if any(v[j][0] == k and abs(v[j][1] - x) <= 2e-7 for j in v if j % 20 == 0)}
    assert {r.row_id for r in QUERIES["variance_window_select_all"](spark, sf).collect()} == want >= {i for i in v if i % 20 == 0}


def test_permutations_and_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "row_id")
    p = sample.shuffled(df, seed=5)
    assert sorted(r.pos for r in p.collect()) == list(range(103))
    assert {(r.row_id, r.pos) for r in p.collect()} == {(r.row_id, r.pos) for r in sample.shuffled(df.repartition(7), seed=5).collect()}
    g = sample.shuffle_between_groups(df, 4, seed=5).collect()
    assert sorted(r.pos for r in g) == list(range(103)) and all(r.pos % 4 == r.row_id % 4 for r in g)
    folds = sample.k_fold(p, 5).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in folds} == {0: 20, 1: 20, 2: 20, 3: 20, 4: 20, -1: 3}
    assert sample.split(p, 0.5).where("is_train").count() == 51
    b = {r.batch: r["count"] for r in sample.mini_batches(df, 10, "row_id").groupBy("batch").count().collect()}
    assert b[9] == 13 and len(b) == 10
    assert sample.mini_batches(spark.range(5).withColumnRenamed("id", "row_id"), 10, "row_id").where("batch <> 0").count() == 0


def test_hash_uniform(spark):
    r = spark.range(4000).select(rng.uniform(F.col("id"), 1).alias("u"), rng.normal(F.col("id"), 1).alias("n")).agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("n"), F.stddev("n")).first()
    assert r[0] >= 0 and r[1] <= 1 and r[2] == pytest.approx(0.5, abs=0.02) and r[3] == pytest.approx(0, abs=0.05) and r[4] == pytest.approx(1, abs=0.05)


def test_histogram_keeps_empty_bins_and_constants(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (10.0,), (None,)], "x double")
    assert [r.n for r in stats.histogram(df, F.col("x"), 5).orderBy("bin").collect()] == [2, 0, 0, 0, 1]
    assert [r.n for r in stats.histogram(df.where("x = 10"), F.col("x"), 3).orderBy("bin").collect()] == [1, 0, 0]
    assert stats.graphic(stats.histogram(df, F.col("x"), 5), 4).orderBy("bin").first().bar == "████"


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "a int, p int")
    c = metrics.confusion(df, "a", "p")
    assert c.count() == 9 and c.agg(F.sum("n")).first()[0] == 4
    assert metrics.scores(c, "macro").first().precision is None
    assert metrics.scores(c, "micro").first().precision == 0.5
    r = metrics.scores(c, "binary", 1).first()
    assert r.precision == pytest.approx(1 / 3) and r.recall == 1
    same = spark.createDataFrame([(i, [float(i)], 0) for i in range(4)], "row_id long, features array<double>, cluster int")
    assert all(r.s is None for r in metrics.silhouette(same, 1).collect())


def test_neighbours_with_ties_and_large_k(spark):
    df = spark.createDataFrame([(i, [float(i // 2)], i % 2) for i in range(6)], "row_id long, features array<double>, label int")
    for block in (2, 100):
        near = neighbors.k_nearest(df, df, 3, 1, block=block)
        assert [r.id for r in near.where("q = 2").orderBy("rank").collect()] == [3, 0, 1]
    assert neighbors.k_nearest(df, df, 50, 1).where("q = 0").count() == 5
    near = neighbors.k_nearest(df, df, 2, 1, exclude_self=False)
    assert {r.q: r.predicted for r in neighbors.classify(near, df).collect()}[0] == 0


def test_kmeans(spark, tmp_path):
    b = generators.blobs(spark, 300, 3, 2, 0.05, 4)
    model = KMeans(3, seed=1).fit(b)
    assert all(x >= y - 1e-9 for x, y in zip(model.inertia, model.inertia[1:], strict=False))
    model.save(spark, f"file://{tmp_path}/km")
    assert np.allclose(KMeans.load(spark, f"file://{tmp_path}/km").centroids, model.centroids)
    seeds = [r.f for r in b.groupBy("label").agg(F.first("features").alias("f")).orderBy("label").collect()]
    m = ClusterMap(seeds).fit(b)
    assert b.where(m.classify(F.col("features")) != F.col("label")).count() == 0


def test_pca(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 4)) @ np.diag([5, 2, 1, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, features array<double>")
    p = Pca.fit(df, 4, 4)
    assert np.allclose(p.values, np.linalg.eigvalsh(np.cov(x.T))[::-1])
    back = df.select("features", p.inverse(p.transform(F.col("features"))).alias("b")).collect()
    assert np.allclose([q.features for q in back], [q.b for q in back])


def _check_gradients(net, x, y, loss):
    _, g = net.gradients(x, y, loss)
    for p, d in zip(net.trainable(), g, strict=True):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 5)]:
            keep, h = p[at], 1e-6
            p[at] = keep + h
            up = nn.LOSSES[loss][0](y, net.forward(x))
            p[at] = keep - h
            down = nn.LOSSES[loss][0](y, net.forward(x))
            p[at] = keep
            assert d[at] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-5)


def test_gradients():
    r = np.random.default_rng(1)
    y = np.eye(3)[r.integers(0, 3, 6)]
    _check_gradients(nn.Network((4,), [nn.Dense(5, "tanh"), nn.Softmax(3)], 1), r.normal(size=(6, 4)), y, "cross_entropy")
    _check_gradients(nn.Network((1, 6, 6), [nn.Conv2D(2, 3, padding="same", activation="tanh"), nn.MaxPool2D(2, 2), nn.Dense(3, "linear")], 2), r.normal(size=(6, 36)), y, "rss")


def test_training_modes_and_persistence(spark, tmp_path):
    df = generators.truth_table(spark, "xor").select(F.array("x0", "x1").alias("features"), F.array((1 - F.col("y")).cast("double"), F.col("y").cast("double")).alias("target"))
    net = nn.Network((2,), [nn.Dense(8, "tanh"), nn.Softmax(2)], 3)
    local = net.train(df, 200, nn.Step("adam", 0.05), mode="local")
    assert local[-1] < 0.1
    sync = nn.Network((2,), [nn.Dense(8, "tanh"), nn.Softmax(2)], 3).train(df, 3, nn.Step("adam", 0.05))
    assert sync[:2] == pytest.approx(local[:2])
    net.save(spark, f"file://{tmp_path}/net")
    again = nn.Network((2,), [nn.Dense(8, "tanh"), nn.Softmax(2)], 9).load(spark, f"file://{tmp_path}/net")
    assert all(np.allclose(a.output, b.output) for a, b in zip(net.predict(df).collect(), again.predict(df).collect(), strict=True))


def test_evolution(spark):
    a, b = F.lit([0, 1, 2, 3, 4, 5]), F.lit([5, 3, 1, 0, 2, 4])
    assert one(spark, evo.permutation_onepoint(a, b, F.lit(2)), evo.permutation_twopoint(a, b, F.lit(1), F.lit(4)), evo.respectful(a, b, F.lit(1)))[0] == [0, 1, 5, 3, 2, 4]
    r = one(spark, evo.permutation_twopoint(a, b, F.lit(1), F.lit(4)), evo.init_permutation(F.lit(3), 9))
    assert sorted(r[0]) == list(range(6)) and sorted(r[1]) == list(range(9))
    _, best = evo.Genetic(20, 12, lambda c: float(c.mean()), elites=0.1, seed=2).solve(spark, 3)
    assert best == sorted(best)


def test_file_formats(spark, tmp_path):
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (5, 12)), r.integers(0, 10, 5)
    (tmp_path / "i").write_bytes(files.idx_images(x, 3, 4))
    (tmp_path / "l").write_bytes(files.idx_labels(y))
    assert np.array_equal([q.features for q in files.read_idx_images(spark, f"file://{tmp_path}/i").orderBy("row_id").collect()], x)
    assert [q.label for q in files.read_idx_labels(spark, f"file://{tmp_path}/l").orderBy("row_id").collect()] == y.tolist()
    files.write_matrix(x, str(tmp_path / "m"))
    assert np.array_equal([q.features for q in files.read_matrix(spark, f"file://{tmp_path}/m", 5, 12).orderBy("row_id").collect()], x)
    for k in range(2):
        (tmp_path / f"r{k}.bin").write_bytes(b"".join(bytes([int(b)]) + v.astype(np.uint8).tobytes() for b, v in zip(y, x, strict=True)))
    rec = files.read_records(spark, f"file://{tmp_path}/r*.bin", 12).orderBy("row_id").collect()
    assert [q.row_id for q in rec] == list(range(10)) and [q.label for q in rec] == [*y.tolist(), *y.tolist()]
    (tmp_path / "p").write_bytes(struct.pack(">3i", 1, 2, 2) + struct.pack(">i", 77) + bytes(range(12)))
    assert files.read_posters(spark, f"file://{tmp_path}/p").first().id == 77
    (tmp_path / "c.csv").write_text("# note\n a ,b\n1,x\n,y\n3,x\n")
    c = files.read_csv(spark, f"file://{tmp_path}/c.csv")
    assert c.columns == ["a", "b"] and [q.a for q in c.collect()] == [1, None, 3]
    assert files.exists(spark, f"file://{tmp_path}/c.csv") and not files.exists(spark, f"file://{tmp_path}/no")


def test_bits_and_text(spark):
    r = one(spark, scalar.bits_to_real(scalar.real_to_bits(F.lit(-5.625), 4, 3), 4), scalar.values(F.lit("1, ,x,2.5")), scalar.left_trim(F.lit(" \t a ")), scalar.duration_text(F.lit(143.0)))
    assert r[0] == -5.625 and r[1] == [1.0, None, None, 2.5] and r[2] == "a " and r[3] == "2 mins and 23 secs"


def test_memory_text_of_more_than_a_gigabyte(spark, tmp_path):
    import duckdb

    from quillon.queries import ORACLES, QUERIES

    keys = [1, 2, 1073, 1074, 1099019, 1099020, 1200000, 3000000000]
    part = spark.createDataFrame([(k, "a b", 7, 1000.0) for k in keys], "p_partkey long, p_name string, p_size int, p_retailprice double")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["scalar_functions"](spark, str(tmp_path)).collect())) == sorted(con.execute(ORACLES["scalar_functions"]).fetchall())
    assert one(spark, *(scalar.memory_text(F.lit(n)) for n in (1023, 1024**2, 1024**3, 3 * 1024**4)))[0:4] == ("1023 bytes", "1.0 MB", "1.0 GB", "3072.0 GB")


def test_streaming_windows(spark, tmp_path):
    from quillon.streaming.windows import windowed_stats

    e = spark.createDataFrame([(f"2024-01-0{d} 0{h}:00:00", float(d)) for d in (1, 2, 3) for h in (1, 2)], "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    e.coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = windowed_stats(spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.n, r.mean) for r in spark.table("windows").collect()} == {(2, 1.0), (2, 2.0), (2, 3.0)}


def test_every_query_that_has_sql_names_its_columns():
    from quillon.queries import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) >= 70
