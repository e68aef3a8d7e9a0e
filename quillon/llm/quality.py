"""Quality by random-indexing word vectors pooled per document and a two-layer numpy network, calibrated.

Every word has two tokens: its letters (hashed to BUCKETS rows) and its shape (case, trailing marks, digits,
separators, and whether it repeats one of the two words before it). A token's index vector is sparse, ternary and
random; its word vector is the sum of the index vectors of the tokens within two words of it, over all words of
all documents. These sums are made in one pass: each task adds up its own table, of a fixed size, and the tables
are added by slices of rows, in a tree. A document is the mean of its words' normalised vectors, by kind of token, and its
length; the network sees those alone.

The network is fitted on at most SAMPLE labelled rows (the smallest hashes of their ids), which reach the driver
as pooled vectors; a fifth of them is kept from the fitting and sets the temperature of the probabilities. The
vectors (8 MB, fixed) and the network are broadcast; scoring is one pass without a shuffle. Neither labels nor
lang, source or doc_id are inputs of a score.

Defined results: null and empty texts pool to zero vectors and get that vector's score; without labels every
score is 0.5; labels that are null, or whose doc_id is null or has no document, are left out; of several labels of
a doc_id the largest counts; repeated rows score alike; extra columns pass through.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, documents, enter, held_out_column, register, texts
from .toxicity import STRIP, sample

#: Labelled rows that fitting takes at most.
SAMPLE = 8000
BUCKETS, SHAPES, DIM, NONZERO, HIDDEN = 1 << 15, 128, 64, 4, 32
ROWS = BUCKETS + SHAPES
#: Words that a worker keeps, none longer than so many bytes; when full it starts anew.
CACHE, WORD = 500_000, 64
SLICE, TREE = 1028, 1024
#: Bytes of texts whose words' vectors fit a processor's cache.
CHUNK = 1 << 18


def index_vectors() -> np.ndarray:
    r = np.random.default_rng(8)
    out = np.zeros((ROWS, DIM), np.float32)
    np.put_along_axis(out, r.random((ROWS, DIM)).argsort(1)[:, :NONZERO], r.choice([-1, 1], (ROWS, NONZERO)).astype(np.float32), 1)
    return out


class Words(dict):
    """Word to its two tokens, packed, each word once."""

    def __missing__(self, word):
        core = word.strip(STRIP)
        tail = word[len(word.rstrip(STRIP)) :]
        text = core.decode("utf-8", "ignore")
        shape = (1 if len(text) > 1 and text.isupper() else 0) + 2 * min(3, len(tail)) + 8 * (tail[-1:] in (b"!", b"?")) + 16 * any(c.isdigit() for c in text) + 32 * (not text)
        t = (zlib.crc32(text.lower().encode()) % BUCKETS) << 8 | shape
        if len(word) <= WORD:
            self[word] = t
        return t


_words = Words()


def tokens(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters' rows, shapes' rows and the numbers of words of texts."""
    enter("quality")
    if len(_words) > CACHE:
        _words.clear()
    get, packed, counts = _words.__getitem__, [], []
    for t in found:
        p = np.array(list(map(get, t.split())), np.int64)
        packed.append(p)
        counts.append(len(p))
    p = np.concatenate([np.empty(0, np.int64), *packed])
    n = np.array(counts, np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    again = np.zeros(len(p), bool)
    for k in (1, 2):
        again[k:] |= (p[k:] == p[:-k]) & (doc[k:] == doc[:-k])
    return p >> 8, BUCKETS + (p & 0xFF) + 64 * again, n


def add_contexts(total: np.ndarray, vectors: np.ndarray, found: list[bytes]) -> None:
    """Add to each token's row the index vectors of the words within two words of it."""
    core, shape, n = tokens(found)
    doc = np.repeat(np.arange(len(n)), n)
    own = vectors[core] + vectors[shape]
    near = np.zeros_like(own)
    for k in (1, 2):
        same = (doc[k:] == doc[:-k])[:, None]
        near[k:] += own[:-k] * same
        near[:-k] += own[k:] * same
    for rows in (core, shape):
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits: a radix sort
        at = np.flatnonzero(np.diff(rows[order], prepend=-1))
        if len(at):
            total[rows[order][at]] += np.add.reduceat(near[order], at, axis=0)


def pooled(table: np.ndarray, found: list[bytes]) -> np.ndarray:
    """(texts, 2 DIM + 1): means by kind of token, and the length's logarithm."""
    core, shape, n = tokens(found)
    out = np.zeros((len(n), 2 * DIM + 1), np.float32)
    full = n > 0
    if full.any():
        starts = (np.cumsum(n) - n)[full]
        out[full, :DIM] = np.add.reduceat(table[core], starts, axis=0) / n[full, None]
        doc = np.repeat(np.arange(len(n)), n)
        by = np.bincount(doc * SHAPES + shape - BUCKETS, minlength=len(n) * SHAPES).reshape(len(n), SHAPES)
        out[:, DIM:-1] = by @ table[BUCKETS:] / np.maximum(1, n)[:, None]
    out[:, -1] = np.log1p(n)
    return out


class Network:
    """One hidden layer of tanh units and a logistic output at a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60):
        self.fitted = len(y) >= 20 and 0 < y.mean() < 1
        if not self.fitted:
            return
        r = np.random.default_rng(8)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        inner = r.random(len(y)) < 0.8
        p = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        rows = np.flatnonzero(inner)
        for _ in range(epochs):
            r.shuffle(rows)
            for k in range(0, len(rows), 128):
                i = rows[k : k + 128]
                h = np.tanh(x[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = np.outer(d, p[2]) * (1 - h * h)
                g = [x[i].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
                t += 1
                for a, b, c, e in zip(p, m, v, g, strict=True):
                    b += 0.1 * (e - b)
                    c += 0.001 * (e * e - c)
                    a -= 0.003 * (b / (1 - 0.9**t)) / (np.sqrt(c / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z, outer = self.logits(x * self.scale + self.mean), ~inner
        grid = np.geomspace(0.3, 10, 60)
        loss = [np.logaddexp(0, np.where(y[outer] == 1, -z[outer], z[outer]) / c).mean() for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))]) if outer.any() else 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


# ---------------------------------------------------------------- Spark


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(ROWS, DIM) normalised vectors, from all texts."""

    def run(arrow):
        total, vectors = np.zeros((ROWS, DIM), np.float32), index_vectors()
        for b in batches(arrow, CHUNK):
            add_contexts(total, vectors, texts(b))
        task = TaskContext.get().partitionId()
        for i in range(0, ROWS, SLICE):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i // SLICE], pa.int32()), "task": pa.array([task], pa.int32()), "data": pa.array([zlib.compress(total[i : i + SLICE].tobytes(), 1)], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = 0
        for x in table.column("data"):
            total = total + np.frombuffer(zlib.decompress(x.as_py()), np.float32).astype(float)
        data = zlib.compress(total.astype(np.float32).tobytes(), 1)
        return pa.table({"slice": table.column("slice")[:1], "task": table.column("task")[:1], "data": pa.array([data], pa.binary())})

    schema = "slice int, task int, data binary"
    sums = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    # a tree: a slice's tables meet in TREE places first
    sums = sums.groupBy("slice", F.pmod("task", F.lit(TREE))).applyInArrow(add, schema)
    found = sums.groupBy("slice").applyInArrow(add, schema).collect()
    out = np.zeros((ROWS, DIM), np.float32)
    for r in found:  # a fixed number of slices
        part = np.frombuffer(zlib.decompress(r.data), np.float32).reshape(-1, DIM)
        out[r.slice * SLICE : r.slice * SLICE + len(part)] = part
    used = np.abs(out).sum(1) > 0
    norm = out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)
    common = norm[used].mean(0) if used.any() else 0
    norm = (norm - common) * used[:, None]
    return (norm / (np.linalg.norm(norm, axis=1, keepdims=True) + 1e-9)).astype(np.float32)


_tables: dict[str, tuple] = {}
register("quality", _words, _tables)


def _table(name: str, sent):
    enter("quality")
    if name not in _tables:
        _tables.clear()
        _tables[name] = sent.value
    return _tables[name]


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = SAMPLE) -> Network:
    """Fit on labelled rows that are not held out (crc32 of the doc_id mod 5 is not 0)."""
    sent, name = docs.sparkSession.sparkContext.broadcast(vectors), uuid.uuid4().hex

    def run(arrow):
        for b in batches(arrow, CHUNK):
            x = pooled(_table(name, sent), texts(b))
            yield pa.RecordBatch.from_pydict({"_d": b.column("_d"), "y": b.column("y"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = sample(docs, labels, "quality", lambda c: held_out_column(c, 5, 0), most).mapInArrow(run, "_d long, y int, x binary").collect()
    rows.sort(key=lambda r: r._d)
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], float).reshape(len(rows), 2 * DIM + 1)
    return Network(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability that a text is of quality 1."""
    sent, name = docs.sparkSession.sparkContext.broadcast((vectors, network)), uuid.uuid4().hex
    docs = docs.select(*(c for c in docs.columns if c.lower() != column.lower()))
    out = T.StructType([*docs.schema, T.StructField(column, T.DoubleType())])
    schema = to_arrow_schema(out)

    def run(arrow):
        for b in batches(arrow, CHUNK):
            v, net = _table(name, sent)
            found = net(pooled(v, texts(b, text)).astype(float))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, schema, strict=False)), pa.array(found, pa.float64())], schema=schema)

    return docs.mapInArrow(run, out)


THRESHOLD = 0.3


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    vectors = word_vectors(docs)
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), vectors)
    return score(docs, vectors, network).select("doc_id", held_out_column(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
