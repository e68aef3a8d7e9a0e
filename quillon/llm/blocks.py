"""A corpus packed once into compressed blocks, and messages between blocks and shards of hashes.

Operators that must look up every word sequence of a corpus in an index as large as the corpus do so in rounds:
each block sends its distinct hashes to the shards they belong to, and the shards send back a few bits for each,
in the order in which they were asked. A block recomputes its hashes when the answer comes, so that neither
hashes nor texts travel twice. The blocks are rows of a bucketed table in the shared folder: answers are joined
to them without moving the texts again, and as the table is written, a lost executor changes no block.

A hash that is in very many documents is sent once per block, which bounds what a hot passage brings to a shard.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, enter, new_path, register, shuffle_partitions

BLOCK = 8 << 20
#: Words that a worker keeps; when full it starts anew.
CACHE = 500_000


def pack(df: DataFrame, most: int = BLOCK, encode=None) -> DataFrame:
    """(block, data): the rows of df as compressed Arrow batches of about `most` bytes, bucketed by block; or what
    encode(table) makes of each."""
    spark, schema = df.sparkSession, to_arrow_schema(df.schema)

    def run(arrow):
        held, size = [], 0
        for b in batches(arrow, most // 4):
            held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema))
            size += b.nbytes
            if size >= most:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def out(held):
        table = pa.Table.from_batches(held, schema)
        table = table if encode is None else encode(table)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        return pa.RecordBatch.from_pydict({"block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    name = f"quillon_blocks_{uuid.uuid4().hex}"
    df.mapInArrow(run, "block long, data binary").write.bucketBy(shuffle_partitions(spark), "block").option("path", new_path(spark, "blocks")).format("parquet").saveAsTable(name)
    out_ = spark.table(name)
    out_.quillon_table = name
    return out_


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def ask(blocks: DataFrame, answers: DataFrame | None, send, schema: str) -> DataFrame:
    """Rows that send(block number, its table, {(round, shard): answer}) yields (as record batches) for each block.

    answers: (block, round, shard, answer); of a block they are at most some bits for each of its words.
    """
    rows = blocks if answers is None else blocks.join(answers.groupBy("block").agg(F.collect_list(F.struct("round", "shard", "answer")).alias("answers")).hint("shuffle_hash"), "block", "left")

    answered = answers is not None

    def run(arrow):
        for b in arrow:
            for i in range(b.num_rows):
                got = {} if not answered else {(x["round"], x["shard"]): x["answer"] for x in b.column("answers")[i].as_py() or ()}
                yield from send(b.column("block")[i].as_py(), unpack(b.column("data")[i].as_buffer()), got)

    return rows.mapInArrow(run, schema)


def shard_slices(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted unsigned 64-bit keys: shards are ranges of their upper 32 bits."""
    of = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    at = np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))
    return [(s, int(a), int(b)) for s, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]


class WordHashes(dict):
    """XXH64 of a word, each word once."""

    def __missing__(self, word):
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()
register("blocks", _words)


def word_hashes(split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text's begin (one more than texts)."""
    enter("blocks")
    if len(_words) > CACHE:
        _words.clear()
    counts = np.fromiter(map(len, split), np.int64, len(split))
    get = _words.__getitem__
    return np.concatenate([np.empty(0, np.uint64), *(np.array(list(map(get, w)), np.uint64) for w in split)]), np.concatenate(([0], np.cumsum(counts)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def windows(h: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hashes of every `size` consecutive ones, by doubling; one for each start that has them."""
    n = len(h)
    if n < size:
        return np.empty(0, np.uint64)
    power, width, out, done = h, 1, None, 0
    while True:
        if size & width:
            if out is None:
                out = power
            else:  # this part, then what is done so far
                k = n - width - done + 1
                out = power[:k] * np.uint64(pow(base, done, 1 << 64)) + out[width : width + k]
            done += width
        if done == size:
            return out
        power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2
