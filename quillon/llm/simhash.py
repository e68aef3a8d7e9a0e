"""SimHash near-duplicates: exact links of fingerprints within a Hamming radius through BK-trees, by shard.

Fingerprints of 3-word shingles (majority of the bits of XXH64, seed 42) are grouped first, so that copies are
one node. Distinct fingerprints go to shards: of three blocks of 21 or 22 bits two fingerprints that differ in at
most two bits share at least one, so a fingerprint is in one shard for each block, by as many of the block's bits as
make shards of TREE fingerprints on average. A shard's fingerprints are put in a BK-tree - children keyed by integer
Hamming distance to their parent - and searched by following only edges within the radius of the distance. A search
takes what it finds out of the tree, so that a shard gives the links of a spanning forest, fewer than its
fingerprints, not all its pairs.

A shard of more than `most` fingerprints (near copies of one text, or texts whose blocks are alike) is divided again,
by two of four blocks of 16 bits, which such pairs share too, and if that leaves more than `most`, by 24 of the 32
other bits: the eight nibbles of which six must agree. What is left of a fingerprint then are 8 bits, so such a shard
has at most 256.

The trees go to their shards through the shuffle and are not broadcast: together they hold every distinct fingerprint
three times, 24 bytes a document, which no driver may collect (353 MB for the 14.7 million documents of 30 GB, 1.2 TB
for 100 TB). Links are joined to components by distributed contraction.

Defined results: a null or empty text, or one without words, has fingerprint zero, which links as any other; a
null doc_id gets the component of its fingerprint but never names one (null if no other has an id); repeated
rows stay rows; other columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, batches, components, cut, documents, drop, texts

SEED = 42
RADIUS = 2
BLOCKS = list(combinations(range(4), 2))
NIBBLES = list(combinations(range(8), 6))
#: Fingerprints of a shard on average, and the three blocks' first bits.
TREE, THIRDS = 256, (0, 21, 42)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64 bits as an unsigned number."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    joined, hashed = b" ".join(w), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<u8")[0])


class BkTree:
    """Integers under Hamming distance, each held once."""

    def __init__(self, items=()):
        self.root, self.children, self.gone = None, {}, set()
        for x in items:
            self.add(x)

    def add(self, x: int) -> None:
        if self.root is None:
            self.root, self.children[x] = x, {}
            return
        at = self.root
        while d := (at ^ x).bit_count():
            if (below := self.children[at].get(d)) is None:
                self.children[at][d] = x
                self.children[x] = {}
                return
            at = below

    def take(self, x: int, radius: int) -> list[int]:
        """Those within the radius that were not taken before; they stay as inner nodes only."""
        found, todo = [], [self.root]
        while todo:
            at = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius and at not in self.gone:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
            else:
                todo += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        self.gone.update(found)
        return found


def forest(items: dict[int, int], radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints (to their nodes) that lie within the radius."""
    tree, out = BkTree(items), []
    for x in items:
        if x in tree.gone:
            continue
        tree.gone.add(x)
        todo = [x]
        while todo:
            y = todo.pop()
            near = tree.take(y, radius)
            out += [(items[y], items[z]) for z in near]
            todo += near
    return out


def _shards(most: int | None, radius: int):
    """Rows (pair, key, bits, node) sorted by key to links (a, b); a shard beyond `most` goes on as it came."""

    def run(arrow):
        key, items, over = None, {}, False
        for batch in arrow:
            links, on = [], []
            for p, k, x, node in zip(*(batch.column(c).to_pylist() for c in ("pair", "key", "bits", "node")), strict=True):
                if k != key:
                    if len(items) > 1:
                        links += forest(items, radius)
                    key, items, over = k, {}, False
                if over:
                    on.append((p, k, x, node))
                    continue
                items[x & 0xFFFFFFFFFFFFFFFF] = node
                if most is not None and len(items) > most:
                    on += [(p, k, y - (1 << 64) if y >> 63 else y, n) for y, n in items.items()]
                    items, over = {}, True
            yield out(links, on)
        if len(items) > 1:
            yield out(forest(items, radius), [])

    def out(links, on):
        a, b = zip(*links, strict=True) if links else ((), ())
        p, k, x, n = zip(*on, strict=True) if on else ((),) * 4
        none, nothing = [None] * len(on), [None] * len(links)
        columns = {"a": [*a, *none], "b": [*b, *none], "pair": [*nothing, *p], "key": [*nothing, *k], "bits": [*nothing, *x], "node": [*nothing, *n]}
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "pair" else pa.int64()) for c, v in columns.items()})

    return run


LINKS = "a long, b long, pair int, key long, bits long, node long"


def _by_nibbles(arrow):
    """The rows of a large shard again under 28 narrower keys."""
    for batch in arrow:
        key, bits = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "bits"))
        pair = batch.column("pair").to_numpy()
        free = np.array([[4 * n + k for n in range(4) if n not in p for k in range(4)] for p in BLOCKS], np.uint64)[pair] * np.uint64(4)
        nibbles = (bits[:, None] >> free) & np.uint64(15)
        keys = []
        for c, chosen in enumerate(NIBBLES):
            k = key + np.uint64(c)
            for n in chosen:
                k = (k ^ (k >> np.uint64(29)) ^ nibbles[:, n]) * np.uint64(0x9E3779B97F4A7C15)
            keys.append(k.view(np.int64))
        rows = [np.repeat(batch.column(c).to_numpy(), len(NIBBLES)) for c in ("bits", "node")]
        yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).ravel()), *map(pa.array, rows)], ["key", "bits", "node"])


def _searched(rows: DataFrame, most: int | None) -> DataFrame:
    """LINKS of shards: rows (pair, key, bits, node)."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_shards(most, RADIUS), LINKS)


def links(nodes: DataFrame, most: int = 2048, tree: int = TREE) -> DataFrame:
    """nodes: distinct (bits, node), both long. Links (a, b) between nodes that connect all within the radius."""
    width = min(21, max(0, nodes.count() // tree).bit_length())
    found = []

    def searched(keys, rows):
        """Links of shards, and the rows of those that are too large."""
        out = cut(_searched(rows.select("bits", "node", F.posexplode(keys).alias("pair", "key")), most), "links")
        found.append(out.where("key is null").select("a", "b"))
        return out.where("key is not null")

    thirds = [F.expr(f"shiftrightunsigned(bits, {first}) & {(1 << width) - 1}") for first in THIRDS]
    over = searched(F.array(*(F.xxhash64(F.lit(i), x) for i, x in enumerate(thirds))), nodes)
    if over.isEmpty():
        return found[0]
    quarters = [F.expr(f"shiftrightunsigned(bits, {16 * i}) & 65535") for i in range(4)]
    keys = F.array(*(F.xxhash64(F.lit(i), quarters[p], quarters[q]) for i, (p, q) in enumerate(BLOCKS)))
    over = searched(keys, over.select("bits", "node").distinct())
    narrow = over.select("pair", "key", "bits", "node").mapInArrow(_by_nibbles, "key long, bits long, node long")
    last = _searched(narrow.select(F.lit(0).alias("pair"), "key", "bits", "node"), None)
    return found[0].unionByName(found[1]).unionByName(last.select("a", "b"))


def _prints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and text to doc_id and bits, by row."""

    def run(arrow):
        for b in batches(arrow):
            bits = np.array([fingerprint(t, shingle) for t in texts(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bits, pa.int64())], ["doc_id", "bits"])

    return docs.mapInArrow(run, "doc_id long, bits long")


def _classes(prints: DataFrame) -> DataFrame:
    """bits, group and the group's smallest doc_id (component_id) of every fingerprint. Groups go by fingerprints,
    as a doc_id may have several."""
    nodes = cut(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes.where("least is not null").select("bits", F.col("bits").alias("node"))), "a", "b")
    classes = nodes.join(found, nodes["bits"] == found["node"], "left").select("bits", F.coalesce("root", "bits").alias("group"), "least")
    return classes.join(classes.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("bits", "group", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, bits (the fingerprint, long), component_id for every row."""
    prints = cut(_prints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), shingle), "prints")
    return prints.join(_classes(prints), "bits", "left").select("doc_id", "bits", "component_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every document."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest doc_id, and of rows of the group that share it one,
    whatever rows of other groups have that id. A row without a doc_id stays unless another such row has its text."""
    prints = cut(_prints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), 3), "prints")
    found = prints.where("doc_id is not null").join(_classes(prints), "bits")
    keep = found.where("doc_id = component_id").groupBy("group", "doc_id").agg(F.min("bits").alias("_of")).select(F.col("doc_id").alias("_kept"), "_of")

    def run(arrow):
        for b in batches(arrow):
            bits = np.array([fingerprint(t) for t in texts(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits, pa.int64())], [*b.schema.names, "_bits"])

    rows = docs.where("doc_id is not null").mapInArrow(run, StructType([*docs.schema.fields, StructField("_bits", LongType())]))
    stay = rows.join(keep, (rows["doc_id"] == keep["_kept"]) & (rows["_bits"] == keep["_of"]), "left_semi").dropDuplicates(["doc_id", "_bits"]).drop("_bits")
    return stay.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
