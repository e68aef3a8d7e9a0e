"""Learned operators: held-out quality, exact counts, and what they do with hard rows."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ngram_lm, quality, toxicity

SF = "/root/testdata/sf0.01"


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("op", "label"), [(toxicity.op1, "toxic"), (quality.op8, "quality")])
def test_held_out(spark, op, label):
    mod, rest = (4, 2) if label == "toxic" else (5, 0)
    got = op(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % mod == rest) for i, h in zip(got.doc_id, got.held_out, strict=True))
    h = got[got.held_out]
    assert _auc(h[label].to_numpy(), h.score.to_numpy()) > 0.8
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()


@pytest.mark.parametrize("module", [toxicity, quality])
def test_hard_rows(spark, hard, empty, module):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false")):
        if module is toxicity:
            model = toxicity.train(hard, some)
            scored = toxicity.score(hard, model)
            none = toxicity.score(empty, toxicity.train(empty, some))
        else:
            v = quality.word_vectors(hard)
            scored = quality.score(hard, v, quality.train(hard, some, v))
            none = quality.score(empty, v, quality.train(empty, some, quality.word_vectors(empty)))
        rows = scored.collect()
        assert len(rows) == hard.count() and all(0 <= r.score <= 1 for r in rows)
        assert len({r.score for r in rows if not (r.text or "").strip()}) == 1
        assert none.count() == 0


def test_label_model_shares_correlated_evidence():
    r = np.random.default_rng(0)
    y = r.random(3000) < 0.3
    good = np.where(r.random(3000) < 0.9, y, ~y)
    copied = np.where(r.random(3000) < 0.7, y, ~y)
    v = np.stack([np.where(x, 1, -1) for x in (good, copied, copied, copied, copied, np.where(r.random(3000) < 0.85, y, ~y))], 1)
    model = toxicity.LabelModel(v, np.full(3000, -1))
    assert model.share[1:5].max() < 0.6 < min(model.share[0], model.share[5])
    assert ((model.posterior > 0.5) == y).mean() > 0.85


@pytest.fixture(scope="module")
def labelled(spark):
    """Features and labels of sf0.1: rows to fit on, labelled or not, and held-out labelled rows."""
    sf = SF.replace("0.01", "0.1")
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").where("toxic is not null or doc_id % 4 = 0").orderBy("doc_id").collect()
    held = [zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows]
    of = lambda some: ([toxicity.counts((r.text or "").encode()) for r in some], np.array([-1 if r.toxic is None else r.toxic for r in some]))
    return of([r for r, h in zip(rows, held, strict=True) if not h]), of([r for r, h in zip(rows, held, strict=True) if h and r.toxic is not None])


def test_posteriors_come_from_votes(labelled):
    """Held-out labels against posteriors: without any label, and with voters' rates counted on training labels."""
    (rows, gold), (held, y) = labelled
    train, other = toxicity.Texts(rows), toxicity.Texts(held)
    unknown = np.full(len(gold), -1)
    alone = toxicity.Voters(train, unknown)
    v = np.concatenate([alone.votes(train), alone.votes(other)])
    none = toxicity.LabelModel(v, np.full(len(v), -1)).posterior[len(gold) :]
    assert _auc(y, none + 1e-9 * np.random.default_rng(0).random(len(none))) > 0.75
    voters = toxicity.Voters(train, gold)
    v = np.concatenate([voters.votes(train), voters.votes(other)])
    model = toxicity.LabelModel(v, np.concatenate([gold, np.full(len(y), -1)]))
    found = model.posterior[len(gold) :]
    assert _auc(y, found) > 0.9 and ((found > 0.5) == y).mean() > 0.93
    # a text's own label changes nothing but the rates
    turned = np.concatenate([gold, np.full(len(y), -1)])
    i = int(np.flatnonzero((gold == 0) & (model.posterior[: len(gold)] < 0.01))[0])
    turned[i] = 1
    assert toxicity.LabelModel(v, turned).posterior[i] < 0.05


def test_linear_classifier_of_posteriors(labelled):
    (rows, gold), (held, y) = labelled
    w, b = toxicity.fit(rows, gold)
    s = 1 / (1 + np.exp(-np.array([(w[f] * n).sum() / (k + toxicity.PRIOR) + b for f, n, k in held])))
    assert _auc(y, s) > 0.93 and ((s >= 0.3) == y).mean() > 0.95


def _kneser_ney(tokens, held):
    bi, c = collections.Counter(), collections.Counter()
    for t, h in zip(tokens, held, strict=True):
        if not h:
            c.update(t)
            bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    total, kinds, n = collections.Counter(), collections.Counter(), {1: collections.Counter(), 2: collections.Counter(), 3: collections.Counter()}
    for (a, b), k in bi.items():
        total[a] += k
        kinds[b] += 1
        n[min(k, 3)][a] += 1
    ones = lambda v: np.array([list(v).count(i) for i in (1, 2, 3, 4)])
    d2, d1 = ngram_lm.discounts(ones(bi.values())), ngram_lm.discounts(ones(kinds.values()))
    less = lambda k, d: d[min(k, 3) - 1] if k else 0
    rest, s = sum(less(k, d1) for k in kinds.values()), sum(kinds.values())
    uni = lambda w: (max(kinds[w] - less(kinds[w], d1), 0) + rest / (len(c) + 1)) / s
    two = lambda a, w: (max(bi[a, w] - less(bi[a, w], d2), 0) + sum(d2[i - 1] * n[i][a] for i in n) * uni(w)) / total[a] if total[a] else uni(w)
    return c, two


def test_language_model(spark, hard, empty):
    docs = hard.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = docs.collect()
    tokens = [[*(r.text or "").encode().lower().split(), b"\n"] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    c, two = _kneser_ney(tokens, held)
    n, v = sum(c.values()), len(c)
    assert abs(sum(two(b"the", w) for w in c) + two(b"the", "?") - 1) < 1e-9
    want = sorted((str(r.doc_id), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5), round(sum(np.log10(two(a, w)) for a, w in zip(["<s>", *t[:-1]], t, strict=True)), 5)) for r, t, h in zip(rows, tokens, held, strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in ngram_lm.score(docs).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-4)
    assert ngram_lm.score(empty).count() == 0


def _kneser_ney_of(tokens, held, order):
    """Probability of a word after a context, by definition, from dictionaries."""
    counts = [collections.Counter() for _ in range(order)]
    for t, h in zip(tokens, held, strict=True):
        padded = ["<s>"] * (order - 1) + t
        if not h:
            counts[-1].update(tuple(padded[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k - 1].update(g[1:] for g in counts[k])
    d = [ngram_lm.discounts(np.array([list(c.values()).count(i) for i in (1, 2, 3, 4)])) for c in counts]
    after = [collections.defaultdict(list) for _ in range(order)]
    for k in range(order):
        for g, n in counts[k].items():
            after[k][g[:-1]].append(n)
    v = len(counts[0])

    def p(gram):
        k = len(gram) - 1
        lower = p(gram[1:]) if k else 1 / (v + 1)
        seen = after[k].get(gram[:-1], ())
        if not seen:
            return lower
        n = counts[k][gram]
        return (max(n - (d[k][min(n, 3) - 1] if n else 0), 0) + sum(d[k][min(x, 3) - 1] for x in seen) * lower) / sum(seen)

    return {g[0] for g in counts[0]}, p


@pytest.mark.parametrize("order", [3, 4])
def test_language_model_of_longer_contexts(spark, hard, order):
    docs = hard.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = docs.collect()
    tokens = [[*(r.text or "").encode().lower().split(), b"\n"] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in rows]
    words, p = _kneser_ney_of(tokens, held, order)
    context = (b"quick", b"brown", b"fox")[1 - order :]
    assert abs(sum(p((*context, w)) for w in words) + p((*context, "?")) - 1) < 1e-9
    padded = [["<s>"] * (order - 1) + t for t in tokens]
    want = sorted((str(r.doc_id), len(t), sum(np.log10(p(tuple(x[i : i + order]))) for i in range(len(t)))) for r, t, x in zip(rows, tokens, padded, strict=True))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in ngram_lm.score(docs, order=order).collect())
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=2e-4)


def test_op2_uses_two_words_of_context(spark):
    one = ngram_lm.score(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    of = lambda df: df.where("held_out").agg(F.sum("score") / F.sum("n_tokens")).first()[0]
    assert of(ngram_lm.op2(spark, "/root/testdata/sf0.001")) > of(one) + 0.01


def test_what_a_round_has_read_is_deleted(spark):
    """Neither messages to lower orders nor shuffles stay on disk when the counts are there."""
    import glob
    import time

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    files = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    tables = lambda: set(glob.glob(f"{folder}/quillon-grams*"))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 37}" for j in range(40))) for i in range(200)], "doc_id long, text string")
    old_files, old_tables = files(), tables()
    scored = ngram_lm.score(docs, order=3)
    made = tables() - old_tables
    assert made and all(spark.read.parquet(t).where(f"kind not in ({ngram_lm.TO_BLOCK}, {ngram_lm.TOTALS})").count() == 0 for t in made)
    end = time.time() + 20
    while (left := files() - old_files) and time.time() < end:
        time.sleep(0.5)
    assert not left
    assert scored.count() == 200


def test_orders_of_keys():
    r = np.random.default_rng(1)
    for bits in (1, 20, 50, 64):
        k = r.integers(0, 1 << min(bits, 63), 20000).astype(np.uint64) << np.uint64(bits - min(bits, 63))
        assert (ngram_lm.order_of(k, bits) == np.argsort(k, kind="stable")).all()
    assert len(ngram_lm.order_of(np.empty(0, np.uint64), 1)) == 0
