"""Evolutionary optimisers: genetic algorithm, particle swarm, attraction-guided symbols.

A population is a DataFrame (member_id, chain ARRAY<DOUBLE>, fitness). Operators on chains are column expressions
whose random picks come from hashes of (member, seed); fitness runs in parallel over members. A generation is cut
to a checkpoint, so plans don't grow and a lost executor loses nothing that counts.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import rng

# ---------------------------------------------------------------- initial chains


def genes(member: Column, size: int, seed, f: Callable[[Column], Column]) -> Column:
    """f of (member, gene) as text, for each gene."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: f(F.concat_ws("/", member.cast("string"), i.cast("string"))))


def init_null(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def init_uniform(member: Column, size: int, low: float, high: float, seed=0) -> Column:
    return genes(member, size, seed, lambda k: rng.uniform(k, seed, low, high))


def init_bool(member: Column, size: int, seed=0) -> Column:
    return genes(member, size, seed, lambda k: F.when(rng.uniform(k, seed) < 0.5, 0.0).otherwise(1.0))


def init_normal(member: Column, size: int, mean: float, sd: float, seed=0) -> Column:
    return genes(member, size, seed, lambda k: rng.normal(k, seed, mean, sd))


def init_permutation(member: Column, size: int, base: int = 0, seed=0) -> Column:
    keyed = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.struct(rng.key(F.concat_ws("/", member.cast("string"), i.cast("string")), seed).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: (s["i"] + base).cast("double"))


def init_multiset(member: Column, sizes: list[int], alphabet: int, seed=0) -> Column:
    """For each set, its size of distinct symbols below `alphabet`, sorted."""
    one = lambda k, n: F.array_sort(F.slice(init_permutation(F.concat_ws("#", member.cast("string"), F.lit(str(k))), alphabet, 0, seed), 1, n))
    return F.concat(*(one(k, n) for k, n in enumerate(sizes)))


# ---------------------------------------------------------------- crossover


def onepoint(a: Column, b: Column, cut: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), cut), F.slice(b, cut + 1, F.size(b) - cut))


def twopoint(a: Column, b: Column, c1: Column, c2: Column) -> Column:
    return F.concat(F.slice(a, F.lit(1), c1), F.slice(b, c1 + 1, c2 - c1), F.slice(a, c2 + 1, F.size(a) - c2))


def mixed(a: Column, b: Column, mask: Column) -> Column:
    """Of b where the mask is 1."""
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda x: F.when(x["m"] == 1, x["b"]).otherwise(x["a"]))


def permutation_onepoint(a: Column, b: Column, cut: Column) -> Column:
    """Head of a, then the rest in b's order."""
    head = F.slice(a, F.lit(1), cut)
    return F.concat(head, F.array_except(b, head))


def permutation_twopoint(a: Column, b: Column, c1: Column, c2: Column) -> Column:
    """a outside [c1, c2), inside what is missing in b's order."""
    outside = F.concat(F.slice(a, F.lit(1), c1), F.slice(a, c2 + 1, F.size(a) - c2))
    return F.concat(F.slice(a, F.lit(1), c1), F.array_except(b, outside), F.slice(a, c2 + 1, F.size(a) - c2))


def multiset_onepoint(a: Column, b: Column, cut: Column) -> Column:
    """Head of a, then of b and a what isn't there yet, to a's size, sorted."""
    return F.array_sort(F.slice(F.array_distinct(F.concat(F.slice(a, F.lit(1), cut), b, a)), F.lit(1), F.size(a)))


def multiset_uniform(a: Column, b: Column, mask: Column) -> Column:
    """Genes of b where the mask is 1 and of a elsewhere, without repeats, filled up from a and b to a's size, sorted."""
    return F.array_sort(F.slice(F.array_distinct(F.concat(mixed(a, b, mask), a, b)), F.lit(1), F.size(a)))


def respectful(a: Column, b: Column, member: Column, w: float = 3.0, seed=0, symbols: int = 0) -> Column:
    """Set crossover that weights common symbols w times: those of the union in weighted random order, to a's size. With
    the number of `symbols` there are, those that neither parent has (barred ones) come after, for what is missing."""
    weight = lambda x: F.when(F.array_contains(a, x) & F.array_contains(b, x), F.lit(w)).otherwise(F.lit(1.0))
    order = F.transform(F.array_union(a, b), lambda x: F.struct((-F.ln(F.greatest(rng.uniform(F.concat_ws("/", member.cast("string"), x.cast("string")), seed), F.lit(1e-12))) / weight(x)).alias("k"), x.alias("x")))
    chosen = F.transform(F.array_sort(order), lambda s: s["x"])
    if symbols:
        every = F.transform(F.sequence(F.lit(0), F.lit(symbols - 1)), lambda i: i.cast("double"))
        barred = F.transform(F.array_except(every, F.array_union(a, b)), lambda x: F.struct(rng.key(F.concat_ws("/", member.cast("string"), x.cast("string")), f"{seed}b").alias("k"), x.alias("x")))
        chosen = F.concat(chosen, F.transform(F.array_sort(barred), lambda s: s["x"]))
    return F.array_sort(F.slice(chosen, F.lit(1), F.size(a)))


def averaged(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


# ---------------------------------------------------------------- mutation


def _each(chain: Column, member: Column, ratio: float, seed, f) -> Column:
    return F.transform(chain, lambda x, i: F.when(rng.uniform(F.concat_ws("/", member.cast("string"), i.cast("string")), f"{seed}p") < ratio, f(x, F.concat_ws("/", member.cast("string"), i.cast("string")))).otherwise(x))


def mutate_flip(chain: Column, member: Column, ratio: float, seed=0) -> Column:
    return _each(chain, member, ratio, seed, lambda x, k: 1 - x)


def mutate_add(chain: Column, member: Column, ratio: float, low: float, high: float, seed=0) -> Column:
    return _each(chain, member, ratio, seed, lambda x, k: x + rng.uniform(k, seed, low, high))


def mutate_replace(chain: Column, member: Column, ratio: float, low: float, high: float, seed=0) -> Column:
    return _each(chain, member, ratio, seed, lambda x, k: rng.uniform(k, seed, low, high))


def mutate_normal(chain: Column, member: Column, ratio: float, sd: float, seed=0, low: float = float("-inf"), high: float = float("inf")) -> Column:
    return _each(chain, member, ratio, seed, lambda x, k: F.greatest(F.lit(low), F.least(F.lit(high), x + rng.normal(k, seed, 0, sd))))


def mutate_swap(chain: Column, i: Column, j: Column) -> Column:
    """Two genes change places: of permutations and multisets."""
    return F.transform(chain, lambda x, k: F.when(k == i, F.element_at(chain, j + 1)).when(k == j, F.element_at(chain, i + 1)).otherwise(x))


def mutate_multiset_replace(chain: Column, i: Column, symbol: Column) -> Column:
    """Gene i becomes the symbol, unless that is in the set."""
    return F.when(F.array_contains(chain, symbol), chain).otherwise(F.array_sort(F.transform(chain, lambda x, k: F.when(k == i, symbol).otherwise(x))))


# ---------------------------------------------------------------- selection and loops


#: Members that a wheel may have: two numbers of each are broadcast.
MOST = 1_000_000


def _wheel(population: DataFrame):
    """Ids and cumulative fitness in order of ids, broadcast; a missing or negative fitness counts as 0."""
    rows = population.select("member_id", F.greatest(F.coalesce("fitness", F.lit(0.0)).cast("double"), F.lit(0.0)).alias("f")).orderBy("member_id").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a population of more than {MOST} members")
    return population.sparkSession.sparkContext.broadcast((np.array([r.member_id for r in rows], np.int64), np.cumsum([r.f for r in rows])))


def _spin(sums: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The first place whose cumulative fitness reaches u times the total; without any fitness all are alike."""
    n = len(sums)
    at = np.searchsorted(sums, u * sums[-1], "left") if sums[-1] > 0 else np.floor(u * n).astype(np.int64)
    return np.minimum(at, n - 1)


def roulette(population: DataFrame, draws: DataFrame) -> DataFrame:
    """(draw, member_id): draws (draw, u) pick the first member whose cumulative fitness reaches u times the total; of a
    population without fitness all members are as likely. No members, no picks."""
    sent = _wheel(population)

    def run(arrow):
        ids, sums = sent.value
        for b in arrow:
            if len(ids):
                yield pa.RecordBatch.from_arrays([b.column("draw"), pa.array(ids[_spin(sums, b.column("u").to_numpy())])], ["draw", "member_id"])

    return draws.select(F.col("draw").cast("long").alias("draw"), F.col("u").cast("double").alias("u")).mapInArrow(run, "draw long, member_id long")


def parents(population: DataFrame, children: DataFrame) -> DataFrame:
    """(child, first, second) of children (child, u, w): u picks the first parent by roulette, and w the second from a
    wheel without the first, so that the two are distinct wherever there are two members."""
    sent = _wheel(population)

    def run(arrow):
        ids, sums = sent.value
        own = np.diff(sums, prepend=0.0)
        for b in arrow:
            if not len(ids):
                continue
            u, w = b.column("u").to_numpy(), b.column("w").to_numpy()
            first = _spin(sums, u)
            rest = sums[-1] - own[first]
            slice_ = w * rest
            slice_ += np.where(slice_ > sums[first] - own[first], own[first], 0.0)
            second = np.minimum(np.searchsorted(sums, slice_, "left"), len(ids) - 1)
            alike = (rest <= 0) | (second == first)  # nothing but the first has fitness, or rounding met it
            other = np.minimum(np.floor(w * (len(ids) - 1)).astype(np.int64), max(0, len(ids) - 2))
            second = np.where(alike, np.minimum(other + (other >= first), len(ids) - 1), second)
            yield pa.RecordBatch.from_arrays([b.column("child"), pa.array(ids[first]), pa.array(ids[second])], ["child", "first", "second"])

    some = children.select(F.col("child").cast("long").alias("child"), F.col("u").cast("double").alias("u"), F.col("w").cast("double").alias("w"))
    return some.mapInArrow(run, "child long, first long, second long")


def save_state(table: DataFrame, path: str, **numbers) -> None:
    """A table of a search, and its numbers beside it."""
    table.write.mode("overwrite").parquet(f"{path}/table")
    table.sparkSession.createDataFrame([(json.dumps(numbers),)], "numbers string").write.mode("overwrite").parquet(f"{path}/numbers")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/table"), json.loads(spark.read.parquet(f"{path}/numbers").first().numbers)


def evaluate(population: DataFrame, fitness: Callable[[np.ndarray], float]) -> DataFrame:
    """fitness of those members that have none."""

    def run(arrow):
        for b in arrow:
            f = [v if v is not None else float(fitness(np.array(c))) for v, c in zip(b.column("fitness").to_pylist(), b.column("chain").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("member_id"), b.column("chain"), pa.array(f, pa.float64())], ["member_id", "chain", "fitness"])

    return population.mapInArrow(run, "member_id long, chain array<double>, fitness double")


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; a local one where the session names none."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quillon-"))
    return df.checkpoint()


@dataclass
class Genetic:
    """Elitism, roulette parents, one-point or mixed crossover, mutation; stops at the threshold."""

    size: int
    genes: int
    fitness: Callable[[np.ndarray], float]
    kind: str = "bool"
    low: float = 0.0
    high: float = 1.0
    elites: float = 0.05
    crossover: str = "onepoint"
    mutation: float = 0.02
    threshold: float = 0.999
    seed: int = 0

    def solve(self, spark: SparkSession, generations: int, autosave: str | None = None, resume: str | None = None) -> tuple[DataFrame, list[float]]:
        """The last population and each generation's best fitness; self.best is the best chain of all generations, with
        its fitness. autosave: a folder for the state after every generation; resume: one to go on from."""
        ids = spark.range(self.size).withColumnRenamed("id", "member_id")
        m = F.col("member_id")
        chain = init_bool(m, self.genes, self.seed) if self.kind == "bool" else init_uniform(m, self.genes, self.low, self.high, self.seed)
        history, start, self.best = [], 0, ([], float("-inf"))
        if resume is not None:
            now, numbers = load_state(spark, resume)
            now, history, start, self.best = kept(now), numbers["history"], numbers["generation"], tuple(numbers["best"])
        else:
            now = kept(evaluate(ids.select("member_id", chain.alias("chain"), F.lit(None).cast("double").alias("fitness")), self.fitness))
        for g in range(start, start + generations):
            lead = now.orderBy(F.desc("fitness"), "member_id").first()
            history.append(lead.fitness)
            if lead.fitness > self.best[1]:
                self.best = (list(lead.chain), lead.fitness)
            if history[-1] >= self.threshold:
                break
            now = self.evolve(spark, now, g)
            if autosave is not None:
                save_state(now, autosave, history=history, generation=g + 1, best=self.best)
        return now, history

    def evolve(self, spark: SparkSession, now: DataFrame, g: int) -> DataFrame:
        n = max(1, int(self.size * self.elites))
        elite = now.orderBy(F.desc("fitness"), "member_id").limit(n)
        draws = spark.range(self.size - n).select(F.col("id").alias("child"), rng.uniform(F.col("id"), f"{self.seed}g{g}").alias("u"), rng.uniform(F.col("id"), f"{self.seed}h{g}").alias("w"))
        chains = now.select(F.col("member_id").alias("first"), F.col("chain").alias("a"))
        picked = parents(now, draws).join(chains, "first").join(chains.toDF("second", "b"), "second").select("child", "a", "b")
        child, seed = F.col("child"), f"{self.seed}x{g}"
        if self.crossover == "onepoint":
            made = onepoint(F.col("a"), F.col("b"), rng.integer(child, 1, max(1, self.genes - 1), seed))
        else:
            made = mixed(F.col("a"), F.col("b"), init_bool(child, self.genes, seed))
        made = mutate_flip(made, child, self.mutation, seed) if self.kind == "bool" else mutate_replace(made, child, self.mutation, self.low, self.high, seed)
        children = picked.select((child + n).alias("member_id"), made.alias("chain"))
        known = now.select("chain", F.col("fitness").alias("f")).dropDuplicates(["chain"])
        children = children.join(known, "chain", "left").select("member_id", "chain", F.col("f").alias("fitness"))
        again = Window.orderBy(F.desc("fitness"), "member_id")  # elites: a few rows
        elite = elite.select((F.row_number().over(again) - 1).cast("long").alias("member_id"), "chain", "fitness")
        return kept(evaluate(elite.unionByName(children), self.fitness))


def swarm_step(particles: DataFrame, best: list[float], w: float = 0.5, c1: float = 1.0, c2: float = 2.0, low: float = float("-inf"), high: float = float("inf"), seed=0) -> DataFrame:
    """particles (particle, j, x, v, pbest): velocities and places after one step; what leaves the bounds is put
    back on them with its velocity turned and halved."""
    key = F.concat_ws("/", F.col("particle").cast("string"), F.col("j").cast("string"))
    g = F.element_at(F.lit([float(x) for x in best]), (F.col("j") + 1).cast("int"))
    v = w * F.col("v") + c1 * rng.uniform(key, f"{seed}a") * (F.col("pbest") - F.col("x")) + c2 * rng.uniform(key, f"{seed}b") * (g - F.col("x"))
    moved = particles.withColumn("v", v).withColumn("x", F.col("x") + F.col("v"))
    out = (F.col("x") < low) | (F.col("x") > high)
    return moved.withColumn("v", F.when(out, F.col("v") * -0.5).otherwise(F.col("v"))).withColumn("x", F.greatest(F.lit(low), F.least(F.lit(high), F.col("x"))))


@dataclass
class Swarm:
    size: int
    dim: int
    fitness: Callable[[np.ndarray], float]
    low: float
    high: float
    w: float = 0.5
    c1: float = 1.0
    c2: float = 2.0
    threshold: float = float("inf")
    seed: int = 0

    def solve(self, spark: SparkSession, iterations: int, autosave: str | None = None, resume: str | None = None) -> tuple[np.ndarray, list[float]]:
        """Best place found and the best fitness after each iteration. autosave: a folder for the state after every
        iteration; resume: one to go on from."""
        f, dim = self.fitness, self.dim
        ids = spark.range(self.size).withColumnRenamed("id", "particle")
        x = init_uniform(F.col("particle"), dim, self.low, self.high, self.seed)
        now = ids.select("particle", F.posexplode(x).alias("j", "x")).withColumn("v", F.lit(0.0)).withColumn("pbest", F.col("x")).withColumn("pfit", F.lit(float("-inf")))
        history, best, top, start = [], [0.0] * dim, float("-inf"), 0
        if resume is not None:
            now, numbers = load_state(spark, resume)
            now, history, best, top, start = kept(now), *(numbers[k] for k in ("history", "best", "top", "iteration"))

        def judge(table: pa.Table) -> pa.Table:
            t = table.sort_by("j")
            place = t.column("x").to_numpy()
            fit, known = float(f(place)), t.column("pfit")[0].as_py()
            better = fit > known
            n = len(place)
            return pa.table({"particle": t.column("particle"), "j": t.column("j"), "x": t.column("x"), "v": t.column("v"), "pbest": t.column("x") if better else t.column("pbest"), "pfit": pa.array([max(fit, known)] * n)})

        for i in range(start, start + iterations):
            now = kept(now.groupBy("particle").applyInArrow(judge, "particle long, j int, x double, v double, pbest double, pfit double"))
            lead = now.orderBy(F.desc("pfit"), "particle", "j").limit(dim).collect()
            if lead[0].pfit > top:
                top, best = lead[0].pfit, [r.pbest for r in sorted(lead, key=lambda r: r.j)]
            history.append(top)
            if top >= self.threshold:
                break
            now = swarm_step(now, best, self.w, self.c1, self.c2, self.low, self.high, f"{self.seed}s{i}")
            if autosave is not None:
                save_state(now, autosave, history=history, best=best, top=top, iteration=i + 1)
        return np.array(best), history


def attraction(df: DataFrame, rate: float = 0.1) -> DataFrame:
    """(member_id, symbol, pull, fitness, mean): pulls move up with fitness above the mean and down below it, and
    stay in [0, 1]."""
    return df.withColumn("pull", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pull") + rate * (F.col("fitness") - F.col("mean")))))


@dataclass
class Symbols:
    """Attraction-guided search for a set of symbols: each generation a member gives up its symbols of least pull for
    those of the largest pull that it lacks, with hashed ties."""

    size: int
    symbols: int
    chosen: int
    fitness: Callable[[np.ndarray], float]
    rate: float = 0.1
    exchanged: int = 2
    seed: int = 0

    def solve(self, spark: SparkSession, generations: int, autosave: str | None = None, resume: str | None = None) -> tuple[np.ndarray, list[float]]:
        """Best set found and the best fitness up to each generation. autosave: a folder for the state after every
        generation; resume: one to go on from."""
        m = F.col("member_id")
        chain = init_multiset(m, [self.chosen], self.symbols, self.seed)
        pull, history, best, top, n, k, start = np.full(self.symbols, 0.5), [], None, float("-inf"), self.exchanged, self.symbols, 0
        if resume is not None:
            now, numbers = load_state(spark, resume)
            now, history, top, start = kept(now), *(numbers[k] for k in ("history", "top", "generation"))
            pull, best = np.array(numbers["pull"]), np.array(numbers["best"])
        else:
            first = spark.range(self.size).withColumnRenamed("id", "member_id").select("member_id", chain.alias("chain"), F.lit(None).cast("double").alias("fitness"))
            now = kept(evaluate(first, self.fitness))
        for g in range(start, start + generations):
            lead = now.orderBy(F.desc("fitness"), "member_id").first()
            if lead.fitness > top:
                top, best = lead.fitness, np.array(lead.chain)
            history.append(top)
            mean = now.agg(F.avg("fitness")).first()[0]
            by = now.select(F.explode("chain").alias("s"), "fitness").groupBy("s").agg(F.avg("fitness").alias("f")).collect()  # one row a symbol
            for r in by:
                pull[int(r.s)] = min(1, max(0, pull[int(r.s)] + self.rate * (r.f - mean)))
            sent, lead_id, seed = pull.copy(), lead.member_id, self.seed + 1000 * g

            def exchange(arrow, sent=sent, lead_id=lead_id, seed=seed):
                for b in arrow:
                    chains, fits = [], []
                    for member, c, f in zip(b.column("member_id").to_pylist(), b.column("chain").to_pylist(), b.column("fitness").to_pylist(), strict=True):
                        r = np.random.default_rng([seed, member])
                        if member == lead_id:
                            chains.append(c)
                            fits.append(f)
                            continue
                        noise = sent + r.uniform(0, 0.2, k)
                        have = np.array(c, int)
                        lack = np.setdiff1d(np.arange(k), have)
                        out = have[np.argsort(noise[have])][: min(n, len(lack))]
                        new = lack[np.argsort(-noise[lack])][: len(out)]
                        chains.append(np.sort(np.concatenate([np.setdiff1d(have, out), new])).astype(float).tolist())
                        fits.append(None)
                    yield pa.RecordBatch.from_arrays([b.column("member_id"), pa.array(chains, pa.list_(pa.float64())), pa.array(fits, pa.float64())], ["member_id", "chain", "fitness"])

            now = kept(evaluate(now.mapInArrow(exchange, "member_id long, chain array<double>, fitness double"), self.fitness))
            if autosave is not None:
                save_state(now, autosave, history=history, top=top, generation=g + 1, pull=pull.tolist(), best=best.tolist())
        return best, history
