"""Feed-forward and convolutional networks: scoring in Arrow batches or as expressions, training by synchronous
gradients.

The reference procedure is sequential mini-batch descent. `train(mode="sync")` sums each step's gradient over
tasks instead, which gives the same mean gradient for a batch of all rows; `mode="local"` runs the sequential one on
the driver, for data that fits there.
"""

from __future__ import annotations

import copy
import itertools
import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import rng, vec
from quillon.functions.scalar import ACTIVATIONS

from .frame import number_rows

NUMPY = {
    "linear": (lambda x: x, lambda a: np.ones_like(a)),
    "logistic": (lambda x: 1 / (1 + np.exp(-x)), lambda a: a * (1 - a)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "relu": (lambda x: np.maximum(x, 0), lambda a: (a > 0).astype(float)),
}


# ---------------------------------------------------------------- layers


@dataclass
class Dense:
    """f(x W' + b); W starts uniform within sqrt(6 / (inputs + units))."""

    units: int
    activation: str = "relu"
    w: np.ndarray | None = None
    b: np.ndarray | None = None
    frozen: bool = False

    def alloc(self, shape: tuple, r) -> tuple:
        n = int(np.prod(shape))
        if self.w is None:
            lim = np.sqrt(6 / (n + self.units))
            self.w, self.b = r.uniform(-lim, lim, (self.units, n)), np.zeros(self.units)
        return (self.units,)

    def params(self):
        return [self.w, self.b]

    def forward(self, x, train=False, r=None):
        self.x = x.reshape(len(x), -1)
        self.a = NUMPY[self.activation][0](self.x @ self.w.T + self.b)
        return self.a

    def backward(self, g):
        g = g * NUMPY[self.activation][1](self.a)
        self.grads = [g.T @ self.x, g.sum(0)]
        return g @ self.w


@dataclass
class Softmax(Dense):
    """Dense with a softmax at a temperature; backward takes the gradient by the scores (of cross-entropy)."""

    temperature: float = 1.0

    def forward(self, x, train=False, r=None):
        self.x = x.reshape(len(x), -1)
        self.scores = self.x @ self.w.T + self.b
        z = self.scores / self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        self.a = e / e.sum(1, keepdims=True)
        return self.a

    def backward(self, g):
        g = g / self.temperature
        self.grads = [g.T @ self.x, g.sum(0)]
        return g @ self.w


@dataclass
class Dropout:
    """Zeroes a share while training and scales the rest; identity when scoring."""

    ratio: float
    frozen: bool = False

    def alloc(self, shape, r):
        return shape

    def params(self):
        return []

    def forward(self, x, train=False, r=None):
        self.mask = (r.random(x.shape) >= self.ratio) / (1 - self.ratio) if train else np.ones_like(x)
        return x * self.mask

    def backward(self, g):
        self.grads = []
        return g * self.mask


def patches(x: np.ndarray, k: int, stride: int) -> np.ndarray:
    """(n, c, h, w) -> (n, out_h, out_w, c * k * k)"""
    v = np.lib.stride_tricks.sliding_window_view(x, (k, k), axis=(2, 3))[:, :, ::stride, ::stride]
    return v.transpose(0, 2, 3, 1, 4, 5).reshape(len(x), v.shape[2], v.shape[3], -1)


@dataclass
class Conv2D:
    """Filters over (channels, height, width), without a bias; padding "valid" or "same"."""

    filters: int
    kernel: int
    stride: int = 1
    padding: str = "valid"
    activation: str = "relu"
    w: np.ndarray | None = None
    frozen: bool = False

    def alloc(self, shape, r):
        c, h, w = shape
        n = c * self.kernel**2
        if self.w is None:
            lim = np.sqrt(6 / (n + self.filters))
            self.w = r.uniform(-lim, lim, (self.filters, n))
        self.pad = (self.kernel - 1) // 2 if self.padding == "same" else 0
        return (self.filters, (h + 2 * self.pad - self.kernel) // self.stride + 1, (w + 2 * self.pad - self.kernel) // self.stride + 1)

    def params(self):
        return [self.w]

    def forward(self, x, train=False, r=None):
        p = self.pad
        self.padded = np.pad(x, ((0, 0), (0, 0), (p, p), (p, p)))
        self.p = patches(self.padded, self.kernel, self.stride)
        self.a = NUMPY[self.activation][0](self.p @ self.w.T).transpose(0, 3, 1, 2)
        return self.a

    def backward(self, g):
        g = (g * NUMPY[self.activation][1](self.a)).transpose(0, 2, 3, 1)
        self.grads = [np.tensordot(g, self.p, ((0, 1, 2), (0, 1, 2)))]
        d = (g @ self.w).reshape(*g.shape[:3], self.padded.shape[1], self.kernel, self.kernel)
        out = np.zeros_like(self.padded)
        for y in range(self.kernel):
            for x in range(self.kernel):
                out[:, :, y : y + self.stride * g.shape[1] : self.stride, x : x + self.stride * g.shape[2] : self.stride] += d[..., y, x].transpose(0, 3, 1, 2)
        p = self.pad
        return out[:, :, p : out.shape[2] - p, p : out.shape[3] - p]


@dataclass
class MaxPool2D:
    kernel: int
    stride: int
    frozen: bool = False

    def alloc(self, shape, r):
        c, h, w = shape
        return (c, (h - self.kernel) // self.stride + 1, (w - self.kernel) // self.stride + 1)

    def params(self):
        return []

    def forward(self, x, train=False, r=None):
        self.shape = x.shape
        v = np.lib.stride_tricks.sliding_window_view(x, (self.kernel, self.kernel), axis=(2, 3))[:, :, :: self.stride, :: self.stride]
        v = v.reshape(*v.shape[:4], -1)
        self.at = v.argmax(4)
        return v.max(4)

    def backward(self, g):
        self.grads = []
        out = np.zeros(self.shape)
        n, c, y, x = np.indices(self.at.shape)
        np.add.at(out, (n, c, y * self.stride + self.at // self.kernel, x * self.stride + self.at % self.kernel), g)
        return out


# ---------------------------------------------------------------- losses and steps


def softmax_(z: np.ndarray, t: float = 1.0) -> np.ndarray:
    e = np.exp((z - z.max(1, keepdims=True)) / t)
    return e / e.sum(1, keepdims=True)


#: name: (sum of the loss over a batch, its gradient by the output)
LOSSES = {
    "rss": (lambda y, p: ((y - p) ** 2).sum(), lambda y, p: 2 * (p - y)),
    "mse": (lambda y, p: ((y - p) ** 2).mean(1).sum(), lambda y, p: 2 * (p - y) / y.shape[1]),
    "cross_entropy": (lambda y, p: -(y * np.log(np.maximum(p, 1e-12))).sum(), lambda y, p: p - y),
}


@dataclass(frozen=True)
class Distillation:
    """The loss of a student. Targets are one-hot labels followed by the teacher's scores; the network's last layer is a
    Softmax of temperature 1."""

    alpha: float = 0.1
    temperature: float = 4.0

    def __call__(self, y: np.ndarray, scores: np.ndarray) -> tuple[float, np.ndarray]:
        n = scores.shape[1]
        return distillation_loss(y[:, :n], y[:, n:], scores, self.alpha, self.temperature)


def distillation_loss(one_hot, teacher_logits, student_logits, alpha: float, temperature: float) -> tuple[float, np.ndarray]:
    """alpha H(y, softmax(s)) + (1 - alpha) H(softmax(t / T), softmax(s / T)) and its gradient by s."""
    s, soft_t, soft_s = softmax_(student_logits), softmax_(teacher_logits, temperature), softmax_(student_logits, temperature)
    loss = -alpha * (one_hot * np.log(np.maximum(s, 1e-12))).sum() - (1 - alpha) * (soft_t * np.log(np.maximum(soft_s, 1e-12))).sum()
    return loss, alpha * (s - one_hot) + (1 - alpha) / temperature * (soft_s - soft_t)


@dataclass
class Step:
    """learnrate, decay (rate divided by 1 + decay * t), momentum or adam."""

    kind: str = "adam"
    rate: float = 0.001
    decay: float = 0.0
    momentum: float = 0.9
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    t: int = 0
    state: dict = field(default_factory=dict)

    def __call__(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        self.t += 1
        for i, (p, g) in enumerate(zip(params, grads, strict=True)):
            if self.kind == "momentum":
                v = self.state[i] = self.momentum * self.state.get(i, 0.0) - self.rate * g
                p += v
            elif self.kind == "adam":
                m, v = self.state.get(i, (0.0, 0.0))
                m, v = self.beta1 * m + (1 - self.beta1) * g, self.beta2 * v + (1 - self.beta2) * g * g
                self.state[i] = m, v
                p -= self.rate * (m / (1 - self.beta1**self.t)) / (np.sqrt(v / (1 - self.beta2**self.t)) + self.epsilon)
            elif self.kind in ("learnrate", "decay"):
                p -= self.rate / (1 + self.decay * (self.t - 1)) * g
            else:
                raise ValueError(self.kind)


# ---------------------------------------------------------------- networks


class Network:
    def __init__(self, shape: tuple, layers: list, seed: int = 0):
        self.shape, self.layers, self.r = tuple(shape), layers, np.random.default_rng(seed)
        s = self.shape
        for layer in layers:
            s = layer.alloc(s, self.r)
        self.out = s

    def forward(self, x: np.ndarray, train: bool = False) -> np.ndarray:
        x = x.reshape(len(x), *self.shape)
        for layer in self.layers:
            x = layer.forward(x, train, self.r)
        return x

    def gradients(self, x: np.ndarray, y: np.ndarray, loss) -> tuple[float, list[np.ndarray]]:
        """Sums over the rows; layers below the first that learns are skipped."""
        p = self.forward(x, True)
        cost, g = loss(y, self.layers[-1].scores) if callable(loss) else (LOSSES[loss][0](y, p), LOSSES[loss][1](y, p))
        first = next((i for i, a in enumerate(self.layers) if a.params() and not a.frozen), len(self.layers))
        grads: list = []
        for i in range(len(self.layers) - 1, first - 1, -1):
            layer = self.layers[i]
            g = layer.backward(g.reshape(layer.a.shape) if hasattr(layer, "a") else g.reshape(layer.mask.shape) if hasattr(layer, "mask") else g.reshape(layer.at.shape))
            if not layer.frozen:
                grads = [*layer.grads, *grads]
        return float(cost), grads

    def trainable(self) -> list[np.ndarray]:
        return [p for a in self.layers if not a.frozen for p in a.params()]

    def get_flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for a in self.layers for p in a.params()])

    def set_flat(self, w: np.ndarray) -> None:
        at = 0
        for a in self.layers:
            for p in a.params():
                p[...] = w[at : at + p.size].reshape(p.shape)
                at += p.size

    def clone(self) -> Network:
        return copy.deepcopy(self)

    def freeze(self, *layers: int) -> Network:
        for i in layers:
            self.layers[i].frozen = True
        return self

    def summary(self) -> list[tuple[str, tuple, int]]:
        """(kind, output's shape, parameters) of each layer."""
        out, shape, r = [], self.shape, np.random.default_rng(0)
        for layer in self.layers:
            shape = layer.alloc(shape, r)
            out.append((type(layer).__name__, tuple(int(n) for n in shape), sum(p.size for p in layer.params())))
        return out

    def weights(self, spark) -> DataFrame:
        """(layer, i, j, w)"""
        rows = [(k, i, j, float(w)) for k, a in enumerate(self.layers) if a.params() for (i, j), w in np.ndenumerate(a.params()[0])]
        return spark.createDataFrame(rows, "layer int, i int, j int, w double")

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(json.dumps(self.shape), [float(x) for x in self.get_flat()])], "shape string, w array<double>").write.parquet(path)

    def load(self, spark, path: str) -> Network:
        self.set_flat(np.array(spark.read.parquet(path).first().w))
        return self

    def predict(self, df: DataFrame, features: str = "features", out: str = "output") -> DataFrame:
        """df with the outputs, scored in Arrow batches."""
        sent, names, kept = df.sparkSession.sparkContext.broadcast(self), df.columns, df.schema
        from pyspark.sql.types import ArrayType, DoubleType, StructType

        def run(arrow):
            net = sent.value
            for b in arrow:
                x = np.array(b.column(features).to_pylist(), float).reshape(b.num_rows, -1)
                y = net.forward(x).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(y), pa.list_(pa.float64()))], [*names, out])

        return df.mapInArrow(run, StructType([*kept, *StructType().add(out, ArrayType(DoubleType()))]))

    def accuracy(self, df: DataFrame, features: str = "features", target: str = "target") -> float | None:
        """Share of rows whose largest output is where the target's largest is, among the first outputs; null vectors
        don't count, and without rows it is null."""
        n = int(np.prod(self.out))
        known = df.where(F.col(features).isNotNull() & F.col(target).isNotNull())
        real = vec.argmax(F.slice(vec.vector(target), 1, n))
        return self.predict(known.select(vec.vector(features).alias("x"), real.alias("y")), "x").agg(F.avg((vec.argmax(F.col("output")) == F.col("y")).cast("double"))).first()[0]

    def train(
        self, df: DataFrame, epochs: int, step: Step, loss="cross_entropy", batch: int = 0, mode: str = "sync", features: str = "features", target: str = "target", stop: float = 0.0,
        validation: DataFrame | None = None, autosave: str | None = None,
    ) -> list[float]:
        """Mean loss of each epoch. df has features and target arrays; rows without one of them are left out, and a table
        without rows trains nothing. loss: a name of LOSSES or a Distillation.

        sync: a step for all rows, or with `batch` for each part of about so many, dealt by hash anew every epoch; the
        gradients of a step are added up over tasks. local: sequential mini-batches on the driver, of a table that fits.
        validation: its accuracy after every epoch goes to self.validated. autosave: the weights of every epoch go to a
        folder there, `epoch-<number>`."""
        losses, self.validated = [], []
        data = df.select(vec.vector(features).alias("x"), vec.vector(target).alias("y")).where("x is not null and y is not null")
        epoch = self._local(data, step, loss, batch) if mode == "local" else self._sync_epochs(data, step, loss, batch)
        for e in range(epochs):
            cost = next(epoch, None)
            if cost is None:
                break
            losses.append(cost)
            if validation is not None:
                self.validated.append(self.accuracy(validation, features, target))
            if autosave is not None:
                self.save(df.sparkSession, f"{autosave}/epoch-{e}")
            if cost < stop:
                break
        epoch.close()
        return losses

    def _local(self, data: DataFrame, step: Step, loss, batch: int):
        rows = data.collect()
        x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
        while len(x):
            order, total = self.r.permutation(len(x)), 0.0
            for part in np.array_split(order, max(1, len(x) // max(1, batch or len(x)))):
                cost, g = self.gradients(x[part], y[part], loss)
                step(self.trainable(), [a / len(part) for a in g])
                total += cost
            yield total / len(x)

    def _sync_epochs(self, data: DataFrame, step: Step, loss, batch: int):
        data = data.withColumn("h", F.xxhash64("x", "y")).persist()
        try:
            parts = max(1, data.count() // batch) if batch else 1
            for e in itertools.count():
                total, rows = 0.0, 0
                for k in range(parts):
                    part = data if parts == 1 else data.where(F.pmod(F.xxhash64("h", F.lit(e)), F.lit(parts)) == k)
                    cost, n, g = self._sync(part.select("x", "y"), loss)
                    if n:
                        step(self.trainable(), [a / n for a in g])
                    total, rows = total + cost, rows + n
                if not rows:
                    return
                yield total / rows
        finally:
            data.unpersist()

    def _sync(self, data: DataFrame, loss):
        sent, shapes = data.sparkSession.sparkContext.broadcast(self), [p.shape for p in self.trainable()]
        schema = "k long, cost double, n long, g binary"

        def run(arrow):
            net, cost, n, total = sent.value, 0.0, 0, None
            for b in arrow:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in ("x", "y"))
                    c, g = net.gradients(x, y, loss)
                    flat = np.concatenate([a.ravel() for a in g])
                    cost, n, total = cost + c, n + len(x), flat if total is None else total + flat
            if n:
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([cost]), pa.array([n]), pa.array([total.tobytes()], pa.binary())], ["k", "cost", "n", "g"])

        def add(table: pa.Table) -> pa.Table:
            g = np.sum([np.frombuffer(x.as_py()) for x in table.column("g")], 0)
            return pa.table({"k": [0], "cost": [sum(table.column("cost").to_pylist())], "n": [sum(table.column("n").to_pylist())], "g": pa.array([g.tobytes()], pa.binary())})

        # a tree, so that not all tasks' sums meet in one
        sums = data.mapInArrow(run, schema).groupBy(F.pmod("k", F.lit(256))).applyInArrow(add, schema)
        r = sums.groupBy(F.lit(0).alias("all")).applyInArrow(add, schema).first()
        sent.unpersist()
        if r is None:
            return 0.0, 0, []
        flat, out, at = np.frombuffer(r.g), [], 0
        for s in shapes:
            out.append(flat[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        return r.cost, r.n, out


def weight_statistics(weights: DataFrame) -> DataFrame:
    """(layer, n, variance, norm, least, most) of weights (layer, i, j, w)."""
    return weights.groupBy("layer").agg(F.count("w").alias("n"), F.var_pop("w").alias("variance"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.min("w").alias("least"), F.max("w").alias("most"))


def weight_histogram(weights: DataFrame, bins: int = 20) -> DataFrame:
    """(layer, bin, n) of bins that are not empty, of equal width between a layer's ends."""
    ends = weights.groupBy("layer").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))  # one row a layer
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide((F.col("w") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))))
    return weights.join(F.broadcast(ends), "layer").groupBy("layer", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def filter_energy(weights: DataFrame) -> DataFrame:
    """(layer, i, energy): each filter's sum of squared weights."""
    return weights.groupBy("layer", "i").agg(F.sum(F.col("w") * F.col("w")).alias("energy"))


def flat_weights(weights: DataFrame) -> DataFrame:
    """(pos, w) of weights (layer, i, j, w): a network as a chain, by layer, row and column."""
    return number_rows(weights, F.col("layer"), F.col("i"), F.col("j"), name="pos").select("pos", "w")


def shaped_weights(chain: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(layer, i, j, w) of a chain (pos, w)."""
    starts = [0, *itertools.accumulate(a * b for a, b in shapes)]
    layer = F.coalesce(*(F.when(F.col("pos") < end, k) for k, end in enumerate(starts[1:])))
    at = chain.withColumn("layer", layer).where("layer is not null")
    first, width = (F.element_at(F.lit(x), F.col("layer") + 1) for x in ([int(s) for s in starts[:-1]], [int(s[1]) for s in shapes]))
    return at.select("layer", F.floor((F.col("pos") - first) / width).cast("int").alias("i"), ((F.col("pos") - first) % width).cast("int").alias("j"), "w")


MERGES = ("average", "average_similar", "uniform_weights", "uniform_units", "uniform_layers", "first", "second")


def merged(a: Network, b: Network, kind: str = "average", share: float = 0.5, seed: int = 0) -> Network:
    """A child of two networks of the same shape. average: of all parameters; average_similar: of each unit of a with
    the most similar unit of b (largest cosine of their weights) for a share of the units; uniform_*: each weight, unit
    or layer of either, of b with probability `share`; first, second: a copy."""
    if kind not in MERGES:
        raise ValueError(kind)
    r, out = np.random.default_rng(seed), (b if kind == "second" else a).clone()
    if kind in ("first", "second"):
        return out
    for mine, other in zip(out.layers, b.layers, strict=True):
        whole = r.random() < share
        mine_p, other_p = mine.params(), other.params()
        if not mine_p:
            continue
        units = r.random(len(mine_p[0])) < share
        if kind == "average_similar":
            unit = lambda w: w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-12)
            at = (unit(mine_p[0]) @ unit(other_p[0]).T).argmax(1)
        for p, q in zip(mine_p, other_p, strict=True):
            if kind == "average":
                p[...] = (p + q) / 2
            elif kind == "average_similar":
                p[units] = (p[units] + q[at[units]]) / 2
            elif kind == "uniform_weights":
                p[...] = np.where(r.random(p.shape) < share, q, p)
            elif kind == "uniform_units":
                p[units] = q[units]
            elif whole:
                p[...] = q
    return out


def trained(net: Network, chain: np.ndarray, x: np.ndarray, y: np.ndarray, step: Step, loss="cross_entropy") -> np.ndarray:
    """A mutation by training: the chain's network after one step of descent on a batch."""
    child = net.clone()
    child.set_flat(chain)
    _, g = child.gradients(x, y, loss)
    step(child.trainable(), [a / len(x) for a in g])
    return child.get_flat()


def lenet(seed: int = 0, channels: int = 1, side: int = 28, classes: int = 10) -> Network:
    return Network((channels, side, side), [Conv2D(6, 5), MaxPool2D(2, 2), Conv2D(16, 5), MaxPool2D(2, 2), Dense(120), Dense(84), Softmax(classes)], seed)


def mlp(inputs: int, hidden: list[int], classes: int, seed: int = 0, dropout: float = 0.0) -> Network:
    inner = [x for h in hidden for x in ([Dense(h), Dropout(dropout)] if dropout else [Dense(h)])]
    return Network((inputs,), [*inner, Softmax(classes)], seed)


# ---------------------------------------------------------------- as expressions


def dense(v: Column, w: list[list[float]], b: list[float], activation: str = "linear") -> Column:
    f = ACTIVATIONS[activation][0]
    return F.array(*(f(vec.dot(v, F.lit([float(x) for x in row])) + float(c)) for row, c in zip(w, b, strict=True)))


def conv2d(e: DataFrame, kernel: list[list[float]]) -> DataFrame:
    """(id, y, x, v) of images in pixels (id, y, x, v) under one kernel, valid positions: each pixel goes to the
    outputs that it is part of."""
    kh, kw = len(kernel), len(kernel[0])
    taps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(float(kernel[a][b])).alias("w")) for a in range(kh) for b in range(kw)))
    moved = e.select("id", "y", "x", "v", F.explode(taps).alias("t")).select("id", (F.col("y") - F.col("t.a")).alias("y"), (F.col("x") - F.col("t.b")).alias("x"), (F.col("v") * F.col("t.w")).alias("v"))
    return moved.groupBy("id", "y", "x").agg(F.sum("v").alias("v"), F.count("*").alias("taps")).where(F.col("taps") == kh * kw).drop("taps")


def max_pool(e: DataFrame, k: int, stride: int | None = None, size: tuple[int, int] | None = None) -> DataFrame:
    """(id, y, x, v, at_y, at_x): the largest of each k x k window, and the first place that has it, of images in pixels
    (id, y, x, v). With a stride other than k (`size`: height and width), a pixel goes to all windows that it is in."""
    s = stride or k
    first = F.min_by(F.struct("v", "py", "px"), F.struct(-F.col("v"), F.col("py"), F.col("px")))
    if s == k and size is None:
        spread = e.select("id", F.floor(F.col("y") / k).alias("y"), F.floor(F.col("x") / k).alias("x"), "v", F.col("y").alias("py"), F.col("x").alias("px"))
    else:
        last = [(n - k) // s for n in size]
        windows = lambda c, m: F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - k + 1) / s)).cast("long"), F.floor(F.col(c) / s))
        inside = lambda c, m: F.filter(windows(c, m), lambda o: (o <= m) & (o * s + k > F.col(c)))
        spread = e.select("id", "v", F.col("y").alias("py"), F.col("x").alias("px"), F.explode(inside("y", last[0])).alias("y"), "x")
        spread = spread.select("id", "v", "py", "px", "y", F.explode(inside("x", last[1])).alias("x"))
    return spread.groupBy("id", "y", "x").agg(first.alias("b")).select("id", "y", "x", F.col("b.v").alias("v"), F.col("b.py").alias("at_y"), F.col("b.px").alias("at_x"))


def image_patches(e: DataFrame, k: int, height: int, width: int) -> DataFrame:
    """(id, y, x, t, v): the k x k patch at each valid position, t = row * k + column, of images in pixels."""
    taps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(k) for b in range(k))))
    moved = e.select("id", "y", "x", "v", taps.alias("t"))
    moved = moved.select("id", (F.col("y") - F.col("t.a")).alias("y"), (F.col("x") - F.col("t.b")).alias("x"), (F.col("t.a") * k + F.col("t.b")).alias("t"), "v")
    return moved.where(F.col("y").between(0, height - k) & F.col("x").between(0, width - k))


def dropout(v: Column, key: Column, ratio: float, seed: int = 0) -> Column:
    """Elements zeroed by a hash of key and place, the others scaled to keep the mean."""
    gone = lambda i: rng.uniform(F.concat_ws("/", key.cast("string"), i.cast("string")), seed) < ratio
    return F.transform(v, lambda x, i: F.when(gone(i), F.lit(0.0)).otherwise(x / (1 - ratio)))


def distillation(one_hot: Column, teacher: Column, student: Column, alpha: float, temperature: float) -> Column:
    """A row's loss against labels and a teacher's scores."""
    entropy = lambda p, q: -vec.total(F.zip_with(p, q, lambda x, y: x * F.ln(F.greatest(y, F.lit(1e-12)))))
    return alpha * entropy(one_hot, vec.softmax(student)) + (1 - alpha) * entropy(vec.softmax(teacher, temperature), vec.softmax(student, temperature))


def transfer(teacher: DataFrame, chain: DataFrame) -> DataFrame:
    """Filters (layer, j, w...) of a teacher that a chain (pos, j) picks, at their new places."""
    return chain.join(teacher, "j").drop("j").withColumnRenamed("pos", "j")
