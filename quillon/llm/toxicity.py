"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

Voters look at a text's words and vote toxic, clean or not at all:
  * lexicon voters, one for each fixed list of insults, threats and profanity of a language;
  * induced lexicon voters, one for each word or word beginning that labelled toxic texts have more often (so
    inflected and unlisted terms are found, in any language), each with the share of a text's words from which on it
    votes;
  * pattern voters: density of all lexicon terms at three levels, shouting, repeated punctuation, addressed insults,
    and the absence of any term.
The label model is generative: a class balance, and for every voter how often it votes either way on toxic and on
clean texts. It is fitted by expectation-maximisation to the votes on labelled and unlabelled texts alike. A label is
never a vote and no posterior depends on its own text's label: labels only count, beside the expected counts, how
often voters were right; where there are none, a weak belief that voters are better than chance stands in for them.
Voters that err together are found by the correlation of their residuals under the posterior, and their evidence is
divided among them. A logistic regression over hashed relative frequencies of words, word beginnings and word shapes
is then trained on the posteriors of all texts of the sample, labelled or not. A text's score is its probability.

Fitting takes at most SAMPLE labelled rows and UNLABELLED others (the smallest hashes of their ids), sent to the
driver as hashed features only. Scoring is one pass without a shuffle; the weights (1 MB, fixed) are broadcast.
Neither labels nor lang, source or doc_id are inputs of a score.

Defined results: null and empty texts score as a text without any feature does; without any labels the fixed voters
decide alone, and without any rows the fixed lists do; labels that are null, or whose doc_id is null or has no
document, are left out; of several labels of a doc_id the largest counts, and of several rows of a doc_id the
smallest text; repeated rows score alike; extra columns pass through. The stage keeps the rows that score less than
THRESHOLD as they are, repeated ones too; empty tables give empty tables.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, documents, enter, held_out_column, register, texts

#: Labelled rows that fitting takes at most, and others.
SAMPLE, UNLABELLED = 5500, 2000
SIZE = 1 << 18
#: Words that a text has besides its own, so that one word of a very short text isn't all of it.
PRIOR = 10
#: Texts of the sample that must have a feature for it to get a weight.
LEAST = 5
#: Words that a worker keeps; when full it starts anew.
CACHE = 250_000
#: Induced voters at most.
INDUCED = 120

# Insults, threats and profanity by language, lower case, as whole words.
LEXICONS = {
    "en_insults": "idiot moron stupid dumb loser clown pathetic worthless trash scum disgusting fool imbecile ugly jerk creep coward garbage filth vermin parasite",
    "en_threats": "kill die hurt destroy punch hang murder shoot burn rape stab",
    "en_profanity": "damn crap shit fuck fucking bitch bastard asshole ass dick cunt whore slut",
    "de_insults": "idiot dummkopf trottel arschloch abschaum versager schwein dreck wichser hurensohn missgeburt vollidiot drecksau",
    "fr_insults": "idiot imbecile connard connasse salaud salope ordure merde crétin abruti débile minable pourri racaille",
    "es_insults": "idiota imbecil imbécil estúpido estupido basura escoria payaso inútil asqueroso mierda cabrón puta gilipollas pendejo",
}
ADDRESS = frozenset(b"you your du dein tu ton votre vous usted eres".split())
STRIP = b"".join(bytes([c]) for c in range(33, 127) if not bytes([c]).isalnum())


def _hash(x: bytes) -> int:
    return zlib.crc32(x) % (SIZE - 64) + 64


def features(word: bytes) -> tuple[int, ...]:
    """Of a space-separated word: its letters, its beginnings, and its shape."""
    core = word.strip(STRIP).decode("utf-8", "ignore").lower()
    tail = word[len(word.rstrip(STRIP)) :]
    shape = (1 if core and word.isupper() and len(core) > 1 else 0) + 2 * min(3, len(tail)) + 8 * (tail[-1:] in b"!?" and tail != b"") + 16 * any(c.isdigit() for c in core) + 32 * (not core)
    out = [shape % 64]
    if core:
        out.append(_hash(b"w:" + core.encode()))
        out += [_hash(b"%d:" % n + core[:n].encode()) for n in (4, 5, 6) if len(core) > n]
    return tuple(out)


class _Features(dict):
    def __missing__(self, word):
        f = self[word] = features(word)
        return f


_known = _Features()
register("toxicity features", _known)


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Features of a text, how often each, and the number of words."""
    enter("toxicity features")
    if len(_known) > CACHE:
        _known.clear()
    w = text.split()
    found = np.fromiter((f for x in map(_known.__getitem__, w) for f in x), np.int64)
    f, n = np.unique(found, return_counts=True)
    return f, n, len(w)


# ---------------------------------------------------------------- voters and label model


class Texts:
    """Features of many texts, in a row: which, of which text, and their shares of its words."""

    def __init__(self, rows: list):
        self.n = len(rows)
        none = [np.empty(0, np.int32)]
        self.feature = np.concatenate([*none, *(f for f, _, _ in rows)]).astype(np.int32)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(f) for f, _, _ in rows])
        self.words = np.array([w for _, _, w in rows], np.int64)
        self.count = np.concatenate([*none, *(n for _, n, _ in rows)]).astype(np.float32)
        self.share = self.count / (self.words + PRIOR).astype(np.float32)[self.row]

    def total(self, terms: np.ndarray) -> np.ndarray:
        """The share of each text's words that are among the terms."""
        known = np.zeros(SIZE, bool)
        known[terms] = True
        some = np.flatnonzero(known[self.feature])
        return np.bincount(self.row[some], self.share[some], self.n)

    def dense(self, which: np.ndarray) -> np.ndarray:
        """Of features of a shape, how many a word."""
        return np.bincount(self.row, self.count * which[self.feature], self.n) / np.maximum(1, self.words)


def threshold(x: np.ndarray, toxic: np.ndarray) -> float:
    """The x from which on toxic texts are most in excess, by share of their class."""
    order = np.argsort(-x, kind="stable")
    x, toxic = x[order], toxic[order]
    excess = np.cumsum(toxic) / max(1, toxic.sum()) - np.cumsum(~toxic) / max(1, (~toxic).sum())
    last = (x > 0) & np.append(x[1:] != x[:-1], True)
    return float(x[np.argmax(np.where(last, excess, -1))]) if last.any() else np.inf


class Voters:
    """gold: 1, 0 or -1 where unknown; of it come the induced terms and the thresholds, never a vote."""

    def __init__(self, texts_: Texts, gold: np.ndarray):
        self.lists = [np.array([_hash(b"w:" + w.encode()) for w in words.split()]) for words in LEXICONS.values()]
        self.address = np.array([_hash(b"w:" + w) for w in ADDRESS])
        self.terms = self._induced(texts_, gold)
        self.every = np.unique(np.concatenate([self.terms, *self.lists]))
        self.from_, self.levels = np.zeros(len(self.terms)), (0.004, 0.01, 0.02)
        known = gold >= 0
        if (gold == 1).any() and (gold == 0).any():
            self.from_ = np.array([threshold(texts_.total(np.array([t]))[known], gold[known] == 1) for t in self.terms])
            middle = threshold(texts_.total(self.every)[known], gold[known] == 1)
            self.levels = (middle / 2, middle, middle * 2)

    def _induced(self, texts_: Texts, gold: np.ndarray) -> np.ndarray:
        """Features of smoothed log odds 1.5 and more that four toxic texts or more have, one after another: that of the
        highest odds times texts, which count less by each feature that was taken of them."""
        of = gold[texts_.row]
        toxic, clean = (np.bincount(texts_.feature[of == y], minlength=SIZE).astype(float) for y in (1, 0))
        odds = np.log((toxic + 0.5) / (max(1, (gold == 1).sum()) + 1)) - np.log((clean + 0.5) / (max(1, (gold == 0).sum()) + 1))
        odds[:64] = 0
        good = (toxic >= 4) & (odds >= 1.5)
        some = np.flatnonzero((of == 1) & good[texts_.feature])
        row, feature = texts_.row[some], texts_.feature[some]
        left, taken = np.ones(texts_.n), []
        while len(taken) < INDUCED and good.any():
            gain = np.bincount(feature, left[row], SIZE) * np.minimum(odds, 4) * good
            best = int(gain.argmax())
            if gain[best] <= 0:
                break
            taken.append(best)
            good[best] = False
            left[row[feature == best]] *= 0.6
        return np.array(taken, np.int64)

    def votes(self, texts_: Texts) -> np.ndarray:
        """(texts, voters): 1 toxic, -1 clean, 0 no vote."""
        k, m = len(self.lists), len(self.lists) + len(self.terms)
        out = np.zeros((texts_.n, m + 6), np.int8)
        for i, terms in enumerate(self.lists):
            out[:, i] = texts_.total(terms) > 0
        place = np.full(SIZE, -1, np.int32)
        place[self.terms] = np.arange(len(self.terms))
        at = place[texts_.feature]
        some = np.flatnonzero(at >= 0)
        out[texts_.row[some], k + at[some]] = texts_.share[some] >= self.from_[at[some]]
        density, shape = texts_.total(self.every), np.arange(SIZE)
        low, middle, high = self.levels
        any_ = density > 0
        out[:, m] = np.where(density >= middle, 1, np.where(density < low, -1, 0))
        out[:, m + 1] = any_ & (density >= high)
        out[:, m + 2] = any_ & (texts_.dense((shape < 64) & (shape % 2 == 1)) > 0.5)
        out[:, m + 3] = any_ & (texts_.dense((shape < 64) & (shape & 8 > 0)) > 0.5)
        out[:, m + 4] = any_ & (texts_.total(self.address) > 0)
        out[:, m + 5] = np.where(any_, 0, -1)
        return out


class LabelModel:
    """Class balance and voters' rates by expectation-maximisation; correlated voters share their evidence.

    v: votes of all texts. gold (1, 0, -1 where unknown) only adds counts to how often voters vote which way on texts
    of a class, and to the balance; the posterior of a text comes from its votes alone."""

    #: Of no label: rates of votes for the voter's own side and the other on toxic texts, then on clean ones, as if from
    #: as many texts, and the balance as if from so many.
    BELIEF, TEXTS, BALANCE, BALANCE_TEXTS = ((0.3, 0.1), (0.02, 0.5)), 20, 0.1, 100

    def __init__(self, v: np.ndarray, gold: np.ndarray, rounds: int = 30):
        sides = [(v == s).astype(np.float32) for s in (1, -1)]
        none = 1 - sides[0] - sides[1]
        hits, sizes = np.empty((2, 2, v.shape[1])), [0.0, 0.0]  # by class, by side
        for y in (0, 1):
            of = gold == y
            hits[y] = [x[of].sum(0) + 0.5 for x in sides]
            sizes[y] = of.sum() + 1.5
        toxic, known = (gold == 1).sum(), (gold >= 0).sum()
        if not known:
            hits = np.array([[np.full(v.shape[1], rate * self.TEXTS) for rate in self.BELIEF[1 - y]] for y in (0, 1)])
            sizes = [self.TEXTS] * 2
        balance, weight = (toxic + self.BALANCE * 10) / (known + 10), max(known, self.BALANCE_TEXTS)
        # voters that nearly always vote alike count as one from the start
        centred = v - v.mean(0)
        scale = np.sqrt((centred**2).mean(0)) + 1e-9
        alike = np.clip(((centred / scale).T @ (centred / scale) / len(v) - 0.8) / 0.2, 0, 1)
        np.fill_diagonal(alike, 1)
        first = share = 1 / alike.sum(0)
        self.balance, p = balance, None
        for r in range(rounds):
            q = (np.zeros(len(v)), np.zeros(len(v))) if p is None else (1 - p, p)
            rate = np.array([[np.clip((x.T @ q[y] + hits[y][i]) / (q[y].sum() + sizes[y]), 1e-4, 0.9989) for i, x in enumerate(sides)] for y in (0, 1)])
            if p is not None:
                self.balance = (p.sum() + balance * weight) / (len(v) + weight)
            if r in (4, 9, 15):  # residual correlations under the present posterior
                e = v - (np.outer(q[1], rate[1, 0] - rate[1, 1]) + np.outer(q[0], rate[0, 0] - rate[0, 1]))
                e /= np.sqrt((e * e).mean(0)) + 1e-9
                share = np.minimum(first, 1 / np.maximum(1, np.maximum(0, e.T @ e / len(e) - 0.05).sum(0)))
            silent = np.clip(1 - rate.sum(1), 1e-3, 1)
            evidence = [np.log(rate[1, i] / rate[0, i]) * share for i in (0, 1)] + [np.log(silent[1] / silent[0]) * share]
            score = np.log(self.balance / (1 - self.balance)) + sum(x @ w for x, w in zip((*sides, none), evidence, strict=True))
            p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        self.posterior, self.share, self.rate = p, share, rate


def fit(rows: list, gold: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature (times relative frequency) and the bias. gold: 1, 0 or -1 where unknown."""
    weights = np.zeros(SIZE, np.float32)
    if not rows:
        for words in LEXICONS.values():
            weights[[_hash(b"w:" + w.encode()) for w in words.split()]] = 300.0
        return weights, -3.0
    x = Texts(rows)
    y = LabelModel(Voters(x, gold).votes(x), gold).posterior
    often = np.flatnonzero(np.bincount(x.feature, minlength=SIZE)[x.feature] >= LEAST)
    row, share = x.row[often], x.share[often] * 100
    used, of = np.unique(x.feature[often], return_inverse=True)
    of = of.astype(np.int32)
    n = x.n
    del x, often
    w, b = np.zeros(len(used)), -2.0
    g2, gb2, m, mb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for t in range(1, 201):  # Adam on the whole sample
        z = np.clip(np.bincount(row, share * w.astype(np.float32)[of], n) + b, -30, 30)
        d = 1 / (1 + np.exp(-z)) - y
        g = np.bincount(of, share * d.astype(np.float32)[row], len(used)) / n + 5e-5 * w
        gb = d.mean()
        m, mb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb
        g2, gb2 = 0.999 * g2 + 0.001 * g * g, 0.999 * gb2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= 0.08 * (m / c1) / (np.sqrt(g2 / c2) + 1e-8)
        b -= 0.08 * (mb / c1) / (np.sqrt(gb2 / c2) + 1e-8)
    weights[used] = w * 100
    return weights, float(b)


# ---------------------------------------------------------------- Spark


def sample(docs: DataFrame, labels: DataFrame, label: str, out: DataFrame, most: int, others: int = 0) -> DataFrame:
    """(text, y) of at most `most` labelled training rows and `others` without a label (y is -1), those of the smallest
    hashes."""
    known = labels.select(F.col("doc_id").cast("long").alias("_d"), F.col(label).cast("int").alias("y")).where("_d is not null and y is not null").groupBy("_d").agg(F.max("y").alias("y"))
    chosen = known.where(~out(F.col("_d"))).orderBy(F.xxhash64("_d"), "_d").limit(most)
    texts_ = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").cast("string").alias("text"))
    if others:
        rest = texts_.select("_d").where("_d is not null").where(~out(F.col("_d"))).distinct().join(known.select("_d"), "_d", "left_anti")
        chosen = chosen.unionByName(rest.orderBy(F.xxhash64("_d"), "_d").limit(others).select("_d", F.lit(-1).alias("y")))
    # a row for each id, whichever of its rows comes first: the smallest text
    return texts_.join(F.broadcast(chosen), "_d").groupBy("_d", "y").agg(F.min("text").alias("text")).select("_d", "text", "y")


def _sampled(arrow):
    for b in batches(arrow):
        f, n, words = zip(*map(counts, texts(b)), strict=True) if b.num_rows else ((),) * 3
        yield pa.RecordBatch.from_pydict({"_d": b.column("_d"), "y": b.column("y"), "f": pa.array([x.astype("<u4").tobytes() for x in f], pa.binary()), "n": pa.array([x.astype("<u4").tobytes() for x in n], pa.binary()), "words": pa.array(words, pa.int64())})


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, others: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """Fit on rows that are not held out (crc32 of the doc_id mod 4 is not 2)."""
    rows = sample(docs, labels, "toxic", lambda c: held_out_column(c, 4, 2), most, others)
    rows = rows.mapInArrow(_sampled, "_d long, y int, f binary, n binary, words long").collect()
    rows.sort(key=lambda r: r._d)
    return fit([(np.frombuffer(r.f, "<i4"), np.frombuffer(r.n, "<i4"), r.words) for r in rows], np.array([r.y for r in rows], np.int64))


class _Weights(dict):
    """A word's share of the score, each word once."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights

    def __missing__(self, word):
        w = self[word] = float(sum(self.weights[f] for f in features(word)))
        return w


_scorers: dict[str, _Weights] = {}
register("toxicity", _scorers)


def _scores(name: str, weights: np.ndarray, bias: float, found: list[bytes]) -> np.ndarray:
    enter("toxicity")
    if name not in _scorers:
        _scorers.clear()
        _scorers[name] = _Weights(weights)
    of = _scorers[name]
    if len(of) > CACHE:
        of.clear()
    z = [sum(map(of.__getitem__, w := t.split())) / (len(w) + PRIOR) + bias for t in found]
    return 1 / (1 + np.exp(-np.clip(np.array(z, float), -50, 50)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic."""
    sent, bias, name = docs.sparkSession.sparkContext.broadcast(model[0]), model[1], uuid.uuid4().hex
    docs = docs.select(*(c for c in docs.columns if c.lower() != column.lower()))
    out = T.StructType([*docs.schema, T.StructField(column, T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(arrow):
        for b in batches(arrow):
            found = _scores(name, sent.value, bias, texts(b, text))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, schema, strict=False)), pa.array(found, pa.float64())], schema=schema)

    return docs.mapInArrow(run, out)


THRESHOLD = 0.3


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out_column(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score THRESHOLD or more go."""
    model = train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    inner = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return score(inner, model).where(F.col("score") < THRESHOLD).select([F.col("row")[c].alias(c) for c in docs.columns])
