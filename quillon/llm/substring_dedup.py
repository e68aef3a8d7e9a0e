"""Substring dedup: fixed-block anchors, probed with every rolling window, hits extended to maximal exact repeats.

Anchors are the non-overlapping blocks of window/2 words of every document. Any passage of `window` words that
stands in a document holds one of its anchors whole, and so, wherever else the passage stands, one of the probes
there (all rolling sequences of window/2 words) hits that anchor. A hit is extended to both sides: of the windows
around it those count whose whole word sequence also starts in another document. Windows one after another are a
maximal repeat, and the words it covers are removed from every document but the one of the smallest doc_id.

Round 1: each block of documents sends its distinct probes (4 bytes each, anchors marked) to shards of hashes,
which answer one bit for each: an anchor somewhere, and in two documents or more. Round 2: the windows around
such probes are sent with the smallest doc_id that a block has for each, and answered with one bit: another block
has a smaller one. Both are exact but for hash collisions: round 1's only add windows to look at, round 2's keys
have 64 bits and those of the shard. No pair of documents is ever formed, so groups of copies cost what their
texts cost.

Defined results: null or empty text has no words; documents of fewer words than `window` lose nothing; rows that
share a doc_id don't remove from one another; a null doc_id counts as larger than all and removes from none;
extra columns pass through, and one with a result's name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import ask, mix, pack, shard_slices, windows, word_hashes
from .common import cut, documents, drop, shuffle_partitions

BASES = (0x5DEECE66D1CE4E5B, 0x27BB2EE687B0B0FD)
LAST = np.iinfo(np.int64).max
RESULT = [
    T.StructField("kept", T.StringType()),
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]


class Block:
    """The words of a block's documents and the keys of their windows, the same whenever they are computed."""

    def __init__(self, table: pa.Table, text: str, doc_id: str, window: int):
        self.words = [(x or b"").split() for x in table.column(text).cast(pa.binary()).to_pylist()]
        ids = table.column(doc_id).to_pylist()
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.window, self.half = window, window // 2
        self.long = [k for k, w in enumerate(self.words) if len(w) >= window]
        h, self.bounds = word_hashes([self.words[k] for k in self.long])
        self.doc = np.repeat(np.arange(len(self.long)), np.diff(self.bounds))
        self.h, self.n = h, len(h)

    def _keys(self, size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the sequences that lie in one document, and their hashes."""
        hashes = windows(self.h, size, base)
        starts = np.flatnonzero(self.doc[: len(hashes)] == self.doc[size - 1 :]) if len(hashes) else np.empty(0, np.int64)
        return starts, mix(hashes[starts])

    def probes(self) -> None:
        self.at, keys = self._keys(self.half, BASES[0])
        self.probe, self.of = np.unique(keys, return_inverse=True)
        doc = self.ids[self.long][self.doc[self.at]] if len(self.at) else np.empty(0, np.int64)
        low, high = np.full(len(self.probe), LAST), np.full(len(self.probe), -LAST - 1)
        np.minimum.at(low, self.of, doc)
        np.maximum.at(high, self.of, doc)
        anchor = np.zeros(len(self.probe), bool)
        anchor[self.of[(self.at - self.bounds[:-1][self.doc[self.at]]) % self.half == 0]] = True
        self.flags = anchor | ((low != high).astype(np.uint8) << 1)
        self.single = np.where(low == high, low, LAST)

    def candidates(self, shared: np.ndarray) -> None:
        """Windows that hold a shared probe: their starts, distinct keys, and each key's smallest doc_id here."""
        hit = np.zeros(self.n + 1, np.int64)
        hit[self.at[shared[self.of]] + 1] = 1
        hit = np.cumsum(hit)
        starts, keys = self._keys(self.window, BASES[0])
        some = hit[starts + self.window - self.half + 1] > hit[starts]
        starts, keys = starts[some], keys[some]
        second = mix(windows(self.h, self.window, BASES[1])[starts]) & np.uint64(0xFFFFFFFF)
        order = np.lexsort((second, keys))
        new = np.ones(len(order), bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (second[order][1:] != second[order][:-1])
        self.start, self.key_of = starts, np.empty(len(order), np.int64)
        self.key_of[order] = np.cumsum(new) - 1
        self.key = keys[order[new]]
        # the shard tells the upper bits
        self.sent = (self.key << np.uint64(32)) | second[order[new]]
        self.start_doc = self.ids[self.long][self.doc[starts]] if len(starts) else np.empty(0, np.int64)
        self.low = np.minimum.reduceat(self.start_doc[order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)

    def removed(self, smaller: np.ndarray) -> np.ndarray:
        """Of all words of the long documents, in a row."""
        gone = smaller[self.key_of] | (self.start_doc > self.low[self.key_of])
        edge = np.zeros(self.n + 1, np.int64)
        np.add.at(edge, self.start[gone], 1)
        np.add.at(edge, self.start[gone] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).view(bool)


def _answered(slices, answers, round_: int, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    for s, a, b in slices:
        out[a:b] = _unbits(answers[(round_, s)], b - a)
    return out


def _row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64() if k == "block" else pa.int32()) for k, v in values.items()})


ANSWERS = "block long, round int, shard int, answer binary"


def _answer_probes(table: pa.Table) -> pa.Table:
    """Of a shard: which probes are an anchor somewhere and stand in two documents or more."""
    blocks, shards, flags = (table.column(c).to_pylist() for c in ("block", "shard", "flags"))
    keys = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
    ids = [np.frombuffer(x, "<i8") for x in table.column("ids").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(f, np.uint8), count=2 * len(k)).reshape(2, -1) for f, k in zip(flags, keys, strict=True)]
    known, of = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(of, minlength=len(known))
    both = np.concatenate(flags, axis=1)
    anchor, many = (np.bincount(of, f, len(known)) > 0 for f in both)
    shared = anchor & (many | (count > 1))
    ends = np.cumsum([0, *map(len, keys)])
    return pa.table({"block": pa.array(blocks, pa.int64()), "round": pa.array([1] * len(blocks), pa.int32()), "shard": pa.array(shards, pa.int32()), "answer": pa.array([_bits(shared[of[a:b]]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})


def _answer_windows(table: pa.Table) -> pa.Table:
    """Of a shard: for which windows another block has a smaller doc_id."""
    blocks, shards = (table.column(c).to_pylist() for c in ("block", "shard"))
    keys = [np.frombuffer(x, "<u8") for x in table.column("keys").to_pylist()]
    low = [np.frombuffer(i, "<i8")[np.frombuffer(r, "<u4")] for i, r in zip(table.column("ids").to_pylist(), table.column("flags").to_pylist(), strict=True)]
    known, of = np.unique(np.concatenate(keys), return_inverse=True)
    least = np.full(len(known), LAST)
    own = np.concatenate(low)
    np.minimum.at(least, of, own)
    smaller = least[of] < own
    ends = np.cumsum([0, *map(len, keys)])
    return pa.table({"block": pa.array(blocks, pa.int64()), "round": pa.array([2] * len(blocks), pa.int32()), "shard": pa.array(shards, pa.int32()), "answer": pa.array([_bits(smaller[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})


MESSAGES = "block long, shard int, keys binary, flags binary, ids binary"


def substring_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 50) -> DataFrame:
    """docs with kept (the words that stay, joined by a space), n_words, n_removed and repeats (ranges of the
    words removed). window: an even number of words."""
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)
    docs = docs.select(*(c for c in docs.columns if c.lower() not in {f.name for f in RESULT}))
    blocks = pack(docs)

    def first(number, table, _):
        b = Block(table, text, doc_id, window)
        b.probes()
        for s, i, j in shard_slices(b.probe, shards):
            flags = np.stack((b.flags[i:j] & 1, b.flags[i:j] >> 1))
            yield _row(block=number, shard=s, keys=b.probe[i:j].astype("<u4").tobytes(), flags=_bits(flags), ids=b"")

    def known(table, answers):
        b = Block(table, text, doc_id, window)
        b.probes()
        b.candidates(_answered(shard_slices(b.probe, shards), answers, 1, len(b.probe)))
        return b

    def second(number, table, answers):
        b = known(table, answers)
        for s, i, j in shard_slices(b.key, shards):
            ids, which = np.unique(b.low[i:j], return_inverse=True)
            yield _row(block=number, shard=s, keys=b.sent[i:j].astype("<u8").tobytes(), flags=which.astype("<u4").tobytes(), ids=ids.astype("<i8").tobytes())

    result = T.StructType([*docs.schema, *RESULT])
    schema = to_arrow_schema(result)

    def last(number, table, answers):
        b = known(table, answers)
        gone = b.removed(_answered(shard_slices(b.key, shards), answers, 2, len(b.key)))
        long = dict(zip(b.long, zip(b.bounds, b.bounds[1:], strict=False), strict=True))
        kept, removed, repeats = [], [], []
        for k, w in enumerate(b.words):
            mask = gone[slice(*long[k])] if k in long else None
            if mask is None or not mask.any():
                kept.append(b" ".join(w))
                removed.append(0)
                repeats.append([])
                continue
            kept.append(b" ".join([x for x, m in zip(w, mask.tolist(), strict=True) if not m]))
            removed.append(int(mask.sum()))
            turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
            repeats.append([{"start": int(x), "end": int(y)} for x, y in zip(turns[::2], turns[1::2], strict=True)])
        new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(list(map(len, b.words)), pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, schema.field("repeats").type)]
        yield from pa.table([*table.columns, *new], schema=schema).to_batches(max_chunksize=2000)

    one = cut(ask(blocks, None, first, MESSAGES).groupBy("shard").applyInArrow(_answer_probes, ANSWERS), "probes")
    two = cut(ask(blocks, one, second, MESSAGES).groupBy("shard").applyInArrow(_answer_windows, ANSWERS), "windows")
    return ask(blocks, one.unionByName(two), last, result)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    found = substring_dedup(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that lost words has those that stay as its text; the others are as they were."""
    inner = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found, new = substring_dedup(inner), F.col("n_removed") > 0
    change = {"text": F.when(new, F.col("kept")).otherwise(F.col("row")["text"]), "n_chars": F.when(new, F.length("kept").cast("long")).otherwise(F.col("row")["n_chars"]) if "n_chars" in docs.columns else None}
    return found.select([change.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
