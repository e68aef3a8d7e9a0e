"""Near duplicates, repeated passages and embeddings against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from quillon.llm import embedding_dedup, simhash, substring_dedup
from quillon.llm.common import components


def _classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(2000, 2100)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {n for e in edges for n in e}
    want = _classes(nodes, edges)
    assert all(got.get(n, n) == want[n] for n in nodes)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def _print(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_links(spark):
    r = random.Random(1)
    for most, tree in ((2048, 256), (2048, 20), (20, 20), (5, 1)):
        bits = set()
        for _ in range(40):
            base = r.getrandbits(64)
            for _ in range(r.choice([1, 3, 60])):
                x = base
                for _ in range(r.randint(0, 6)):
                    x ^= 1 << r.randrange(64)
                bits.add(x)
        items = {x: 7 * i for i, x in enumerate(sorted(bits))}
        df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, n) for x, n in items.items()], "bits long, node long")
        got = {x.node: x.root for x in components(simhash.links(df, most, tree), "a", "b").collect()}
        names = list(items)
        want = _classes(items.values(), [(items[x], items[y]) for i, x in enumerate(names) for y in names[:i] if (x ^ y).bit_count() <= 2])
        assert all(got.get(n, n) == w for n, w in want.items())


def test_simhash_rows(spark, hard, empty):
    rows = simhash.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    nodes = {_print(r.text) for r in hard.collect()}
    classes = _classes(nodes, [(x, y) for x in nodes for y in nodes if (x ^ y).bit_count() <= 2])
    least = {}
    for r in hard.collect():
        if r.doc_id is not None:
            c = classes[_print(r.text)]
            least[c] = min(r.doc_id, least.get(c, r.doc_id))
    want = [(r.doc_id, _print(r.text), least.get(classes[_print(r.text)])) for r in hard.collect()]
    assert sorted(((r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in rows), key=str) == sorted(want, key=str)
    zero = {r.component_id for r in rows if r.bits == 0}
    assert zero == {2}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.simhash_stage(spark, hard, "")
    assert kept.columns == hard.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({r.component_id for r in rows if r.component_id is not None and r.doc_id is not None})


def _substring(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (float("inf") if i is None else i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_op9_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: _print(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    names = sorted(set(docs.values()))
    bits = np.array(names, np.uint64)
    linked = [(x, names[j]) for i, x in enumerate(names) for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 2).tolist()]
    classes, least = _classes(names, linked), {}
    for i in sorted(docs):
        least.setdefault(classes[docs[i]], i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9(spark, sf).collect()}
    assert got == {i: (f"{x:016x}", least[classes[x]]) for i, x in docs.items()}


def test_shards_are_searched_through_trees(spark):
    """Of as many fingerprints as TREE and more, a shard's tree has branches, and a search leaves most of it out."""
    r = np.random.default_rng(3)
    tree = simhash.BkTree(r.integers(0, 1 << 63, 2000).tolist())
    seen = []
    tree.children = type("Counted", (dict,), {"__getitem__": lambda self, x: (seen.append(x), dict.__getitem__(self, x))[1]})(tree.children)
    for x in r.integers(0, 1 << 63, 50).tolist():
        tree.take(x, 2)
    assert 1 < len(seen) / 50 < 2000 * 0.6


def test_substring(spark, hard, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(hard).collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(_substring(rows, 50), key=key)
    assert substring_dedup.substring_dedup(empty).count() == 0
    stage = substring_dedup.substring_stage(spark, hard, "")
    assert stage.columns == hard.columns and {r.text for r in stage.where("doc_id = 1").collect()} == {rows[0][1]}


def test_substring_random(spark):
    r = random.Random(2)
    parts = [[f"{r.randrange(50)}" for _ in range(r.randint(3, 40))] for _ in range(12)]
    rows = [(i, " ".join(w for _ in range(r.randint(0, 8)) for w in r.choice(parts))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in substring_dedup.substring_dedup(df, window=10).collect())
    assert got == sorted(_substring(rows, 10))


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(30, 16))
    x = [base[i] + r.normal(size=16) * s for i, s in zip(r.integers(0, 30, 300), r.uniform(0, 0.4, 300), strict=True)]
    rows = [(i, [float(v) for v in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, None), (903, [0.0] * 16), (904, [float("nan")] + [1.0] * 15), (905, [1.0] * 3), (906, [None] + [1.0] * 15), (907, [float("inf")] + [1.0] * 15), (None, rows[0][1]), (900, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS n_links", "2 AS node")
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in good])
    link = u @ u.T >= 0.9
    for most in (2048, 8):
        got = embedding_dedup.near_duplicates(df, most=most).collect()
        assert len(got) == len(rows)
        by = {g.vec_id: g for g in got}
        extra = link[[i for i, _ in good].index(0)]
        found = sum(by[i].n_links for i, _ in good)
        want = int(link.sum() - len(good) + extra.sum())  # the copy without an id is a partner too
        assert 0.97 * want <= found <= want
        classes = _classes({i for i, _ in good}, [(good[a][0], good[b][0]) for a, b in zip(*np.nonzero(link), strict=True)])
        assert np.mean([by[i].component_id == classes[i] for i, _ in good]) > 0.97
        for bad in (902, 903, 904, 905, 906, 907):
            assert (by[bad].n_links, by[bad].component_id, by[bad].kept) == (0, bad, True)
        assert by[None].n_links == by[900].n_links
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_plan_keeps_recall():
    for n in (10, 10_000, 10**9):
        tables, k, width = embedding_dedup.plan(n)
        p = embedding_dedup.collision(0.2**0.5, width)
        assert 1 - (1 - p**k) ** tables >= 0.98


def test_kept_digest_is_of_utf8(hard):
    from pyspark.sql import functions as F

    row = substring_dedup.substring_dedup(hard.where("doc_id = 8")).select("kept", F.sha2("kept", 256).alias("h")).first()
    assert hashlib.sha256(row.kept.encode()).hexdigest() == row.h


def test_simhash_stage_keeps_different_texts_of_one_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(50))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a")), (3, text("c")), (3, text("d"))]
    kept = simhash.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(tuple(r) for r in kept.collect()) == sorted({(1, text("a")), (1, text("b")), (3, text("c")), (3, text("d"))})


def test_embeddings_of_mixed_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [3.0, -1.0, 0.5]), (4, [1.0, 2.0]), (5, [2.0, 4.0]), (6, [1.0, 2.0]), (7, [2.0, 1.0, 0.0, 1.0])]
    rows += [(8, [1e200, 2e200]), (9, [1e-300, 2e-300]), (10, [0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (4, 4), 5: (4, 4), 6: (4, 4), 7: (0, 7), 8: (4, 4), 9: (4, 4), 10: (0, 10)}
