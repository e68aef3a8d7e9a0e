"""Training, searches and sources that SQL can't express, and rows that must not crash them."""

import collections
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import evo, metrics, neighbors, nn, stats
from quillon.operators.cluster import ClusterMap, InClass, KMeans
from quillon.operators.decomp import Pca
from quillon.sources import files, generators


@pytest.fixture(scope="module")
def task(spark):
    """Two classes on both sides of a line, and null vectors."""
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(int)
    rows = [(i, [float(v) for v in a], [float(b == 0), float(b == 1)], int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame([*rows, (300, None, [1.0, 0.0], 0), (301, rows[0][1], None, 1)], "row_id long, features array<double>, target array<double>, label int")


def test_training_reports_validation_and_saves_every_epoch(spark, task, tmp_path):
    net = nn.mlp(4, [8], 2)
    losses = net.train(task, 6, nn.Step("adam", 0.05), batch=60, validation=task, autosave=f"file://{tmp_path}/net")
    assert losses[-1] < losses[0] and len(net.validated) == 6 and net.validated[-1] > 0.9
    again = nn.mlp(4, [8], 2, seed=5).load(spark, f"file://{tmp_path}/net/epoch-5")
    assert np.array_equal(again.get_flat(), net.get_flat())
    assert net.accuracy(task) == net.validated[-1] and net.accuracy(task.where("false")) is None
    assert net.summary() == [("Dense", (8,), 40), ("Softmax", (2,), 18)]
    twin = net.clone()
    twin.layers[0].w += 1
    assert not np.array_equal(twin.get_flat(), net.get_flat())


def test_sums_over_tasks_are_one_gradient(spark, task):
    nets = [nn.mlp(4, [8], 2, seed=3) for _ in range(2)]
    whole = nets[0].train(task.repartition(1), 2, nn.Step("learnrate", 0.1))
    parts = nets[1].train(task.repartition(130), 2, nn.Step("learnrate", 0.1))
    assert whole == pytest.approx(parts) and np.allclose(nets[0].get_flat(), nets[1].get_flat())
    assert nets[0].train(task.where("false"), 3, nn.Step()) == [] and nets[0].train(task.where("false"), 3, nn.Step(), mode="local") == []


def test_a_student_learns_from_a_teacher(spark, task):
    teacher = nn.mlp(4, [16], 2, seed=1)
    teacher.train(task, 40, nn.Step("adam", 0.05))
    scores = teacher.layers[-1]

    def logits(arrow):
        import pyarrow as pa

        for b in arrow:
            x = np.array(b.column("features").to_pylist(), float).reshape(b.num_rows, -1)
            if b.num_rows:
                teacher.forward(x)
                yield pa.RecordBatch.from_arrays([b.column("features"), pa.array([[*t, *s] for t, s in zip(b.column("target").to_pylist(), scores.scores.tolist(), strict=True)], pa.list_(pa.float64()))], ["features", "target"])

    both = task.dropna().select("features", "target").mapInArrow(logits, "features array<double>, target array<double>")
    student = nn.mlp(4, [], 2, seed=2)
    losses = student.train(both, 60, nn.Step("adam", 0.05), nn.Distillation(0.1, 2.0))
    assert losses[-1] < losses[0] and student.accuracy(both) > 0.9
    r = np.random.default_rng(4)  # the gradient against differences
    y, t, s = np.eye(3)[[0, 2]], r.normal(size=(2, 3)), r.normal(size=(2, 3))
    loss = nn.Distillation(0.3, 2.5)
    _, g = loss(np.concatenate([y, t], 1), s)
    for i, j in np.ndindex(2, 3):
        e = np.zeros_like(s)
        e[i, j] = 1e-5
        up, down = (loss(np.concatenate([y, t], 1), s + k * e)[0] for k in (1, -1))
        assert g[i, j] == pytest.approx((up - down) / 2e-5, abs=1e-5)


def test_networks_merge_and_mutate_by_training():
    a, b = nn.mlp(3, [5], 2, seed=1), nn.mlp(3, [5], 2, seed=2)
    assert np.allclose(nn.merged(a, b).get_flat(), (a.get_flat() + b.get_flat()) / 2)
    for kind in nn.MERGES:
        child = nn.merged(a, b, kind, 0.5, 3).get_flat()
        assert child.shape == a.get_flat().shape
        if kind.startswith("uniform"):
            assert ((child == a.get_flat()) | (child == b.get_flat())).all()
    assert np.array_equal(nn.merged(a, b, "second").get_flat(), b.get_flat())
    twice = nn.merged(a, a, "average_similar", 1.0)
    assert np.allclose(twice.get_flat(), a.get_flat())
    x, y = np.random.default_rng(0).normal(size=(20, 3)), np.eye(2)[np.arange(20) % 2]
    moved = nn.trained(a, a.get_flat(), x, y, nn.Step("learnrate", 0.5))
    child = a.clone()
    child.set_flat(moved)
    assert child.gradients(x, y, "cross_entropy")[0] < a.gradients(x, y, "cross_entropy")[0]
    with pytest.raises(ValueError):
        nn.merged(a, b, "no such")


def test_lenet_learns(spark):
    r = np.random.default_rng(0)
    y = np.arange(60) % 2
    x = r.normal(0, 0.1, (60, 28, 28))
    x[y == 1, 5:12, 5:12] += 1
    net = nn.lenet(classes=2)
    step = nn.Step("adam", 0.002)
    for _ in range(12):
        _, g = net.gradients(x.reshape(60, -1), np.eye(2)[y], "cross_entropy")
        step(net.trainable(), [a / 60 for a in g])
    assert (net.forward(x.reshape(60, -1)).argmax(1) == y).mean() > 0.95


def test_searches_resume_where_they_stopped(spark, tmp_path):
    ones = lambda c: float(c.sum() / len(c))
    path = f"file://{tmp_path}"
    ga = evo.Genetic(20, 12, ones, elites=0.1, threshold=2.0)
    _, whole = ga.solve(spark, 4)
    half = evo.Genetic(20, 12, ones, elites=0.1, threshold=2.0)
    half.solve(spark, 2, autosave=f"{path}/ga")
    _, rest = half.solve(spark, 2, resume=f"{path}/ga")
    assert rest == whole and half.best[1] == max(whole) == ga.best[1]
    sphere = lambda x: -float((x * x).sum())
    best, whole = evo.Swarm(8, 2, sphere, -2.0, 2.0).solve(spark, 4)
    evo.Swarm(8, 2, sphere, -2.0, 2.0).solve(spark, 2, autosave=f"{path}/pso")
    again, rest = evo.Swarm(8, 2, sphere, -2.0, 2.0).solve(spark, 2, resume=f"{path}/pso")
    assert rest == whole and np.allclose(best, again)
    low = lambda c: float((c < 4).mean())
    best, whole = evo.Symbols(10, 12, 4, low).solve(spark, 4)
    evo.Symbols(10, 12, 4, low).solve(spark, 2, autosave=f"{path}/sv")
    again, rest = evo.Symbols(10, 12, 4, low).solve(spark, 2, resume=f"{path}/sv")
    assert rest == whole and whole == sorted(whole) and np.array_equal(best, again)


def test_symbol_search_finds_the_set(spark):
    best, history = evo.Symbols(24, 12, 3, lambda c: float((c < 3).mean()), exchanged=1).solve(spark, 10)
    assert history[-1] > history[0] and len(best) == 3 and len(set(best)) == 3


def test_parents_are_distinct_and_the_wheel_is_fair(spark):
    pop = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0)], "member_id long, fitness double")
    r = np.random.default_rng(1)
    draws = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(r.random((3000, 2)))], "child long, u double, w double")
    rows = evo.parents(pop, draws).collect()
    assert len(rows) == 3000 and all(x.first != x.second for x in rows)
    n = collections.Counter(x.first for x in rows)
    assert n[2] / 3000 == pytest.approx(0.75, abs=0.03) and n[3] == 0
    none = pop.withColumn("fitness", F.lit(0.0))
    n = collections.Counter(x.first for x in evo.parents(none, draws).collect())
    assert min(n.values()) > 850 and evo.roulette(none, draws.selectExpr("child AS draw", "u")).count() == 3000
    alone = evo.parents(pop.where("member_id = 2"), draws).collect()
    assert all((x.first, x.second) == (2, 2) for x in alone)
    assert evo.roulette(pop.where("false"), draws.selectExpr("child AS draw", "u")).count() == 0


def test_respectful_crossover(spark):
    a, b = (F.lit(x).cast("array<double>") for x in ([0.0, 1, 2, 3], [2.0, 3, 4, 5]))
    rows = spark.range(400).select(evo.respectful(a, b, F.col("id"), 20.0).alias("c"), evo.respectful(a, F.lit([0.0, 1.0, 2.0]), F.col("id"), 3.0, 1, 6).alias("s"))
    rows = rows.collect()
    assert all(len(set(r.c)) == 4 and list(r.c) == sorted(r.c) and set(r.c) <= set(range(6)) for r in rows)
    assert sum({2.0, 3.0} <= set(r.c) for r in rows) > 300
    two = spark.range(50).select(evo.respectful(F.lit([1.0, 2.0, 2.0]), F.lit([1.0, 2.0, 2.0]), F.col("id"), 3.0, 1, 6).alias("s")).collect()
    assert all(len(set(r.s)) == 3 and {1.0, 2.0} < set(r.s) for r in two) and len({tuple(r.s) for r in two}) > 1


def test_null_vectors_and_empty_tables(spark, task):
    empty = task.where("false")
    assert KMeans(2).fit(empty).info(task).collect()[0].cluster is None
    assert KMeans(2).fit(task).info(task.dropna()).agg(F.sum("n")).first()[0] == 300
    near = neighbors.k_nearest(task, task, 3, 4)
    assert near.select("q").distinct().count() == 301 and near.where("q = 300 OR id = 300").count() == 0
    assert neighbors.k_nearest(empty, task, 3, 4).count() == 0 == neighbors.k_nearest(task, empty, 3, 4).count()
    s = metrics.silhouette(task.withColumn("cluster", F.col("label")), 4)
    assert s.count() == 301 and metrics.silhouette(empty.withColumn("cluster", F.col("label")), 4).count() == 0
    genes = task.select(F.lit(1).alias("layer"), F.col("row_id").alias("gene"), F.col("features").alias("weights"))
    whole, parts = (sorted(map(tuple, neighbors.most_similar(genes, n).collect())) for n in (4096, 50))
    assert [x[:3] for x in whole] == [x[:3] for x in parts] and len(whole) == 301
    assert neighbors.most_similar(genes.where("false")).count() == 0
    assert stats.covariance(empty, 4).agg(F.sum("cov")).first()[0] == 0
    whole, parts = (stats.moments(task.repartition(n), 4) for n in (1, 130))
    assert np.allclose(whole[0], parts[0]) and np.allclose(whole[1], parts[1])
    x = np.array([r.features for r in task.where("features IS NOT NULL").collect()])
    assert np.allclose(whole[1], np.cov(x.T)) and np.allclose(Pca.fit(task, 2, 4).mean, x.mean(0))


def test_clusters_within_classes_vote(spark, task):
    known = task.dropna()
    model = InClass(3, max_iterations=20).fit(known)
    assert {r.label: r.n for r in model.info(known).groupBy("label").agg(F.sum("n").alias("n")).collect()} == {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    vote = model.prototypes().vote(F.col("features"), 3)
    assert known.select(F.avg((vote == F.col("label")).cast("int"))).first()[0] > 0.7
    one = ClusterMap([[0.0] * 4]).fit(known)
    assert known.select(one.classify(F.col("features"))).distinct().count() == 1


def test_coded_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("# c\na, b ,c\n1,x,2.5e1kg\n,y,\n\n  #no\n.5,x,-3\n")
    df, names = files.read_coded(spark, f"file://{tmp_path}/a.csv", nanval=-9)
    assert names == ["a", "b", "c"] and [r.features for r in df.orderBy("row_id").collect()] == [[1.0, 0.0, 25.0], [-9.0, 1.0, -9.0], [0.5, 0.0, -3.0]]
    (tmp_path / "b.csv").write_text("1,2\n3\n")
    with pytest.raises(ValueError, match="2 cells"):
        files.read_coded(spark, f"file://{tmp_path}/b.csv", header=False)
    (tmp_path / "e.csv").write_text("# nothing\n")
    assert files.read_coded(spark, f"file://{tmp_path}/e.csv")[0].count() == 0


def test_poster_labels_and_log(spark, tmp_path, capsys):
    files.put(spark, f"file://{tmp_path}/l", struct.pack(">i", 2) + struct.pack(">i", 7) + bytes([1, 0, 1]) + struct.pack(">i", 9) + bytes([0, 0, 0]))
    assert [(r.id, r.labels) for r in files.read_poster_labels(spark, f"file://{tmp_path}/l", 3).orderBy("row_id").collect()] == [(7, [1, 0, 1]), (9, [0, 0, 0])]
    files.tee("quillon-test", f"{tmp_path}/log").info("one line")
    assert (tmp_path / "log").read_text() == "one line\n" and "one line" in capsys.readouterr().out


def test_generators_number_rows_in_parts(spark):
    df = spark.range(40).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("label"))
    noisy = {r.row_id: (r.label, r.noisy) for r in generators.label_noise(df, "label", 3, 0.5).collect()}
    assert len(noisy) == 40 and all((a != b) == (i // 3 < (14 if a == 0 else 13) // 2) for i, (a, b) in noisy.items())
    x = [r.x for r in generators.binary_series(spark, 70000, seed=1).orderBy("t").collect()]
    assert len(x) == 70000 and 0.4 < np.mean(x) < 0.8
