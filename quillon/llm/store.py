"""Token ids in a content-addressed store: chunks cut by a rolling hash and kept once, recipes, Merkle manifests.

A store is a folder of four tables, written and read by Spark alone:

    chunks/     digest (BLAKE2b, 16 bytes), ids (little-endian, `width` bytes each): every distinct chunk once
    recipes/    block, root, n_tokens, digests: every distinct id stream once, as its chunks' digests in order
    documents/  part, doc_id, start, n_tokens, root: in ascending doc_id order (null first), part by part
    manifest/   part, first_doc, last_doc, n_docs, n_ids, root, buckets: a Merkle root over each part's documents

A document's root is the Merkle root over its chunks' digests. Reading looks up every recipe's chunks, hashes
them again, recomputes roots and manifests, and fails on the first that differs.

A chunk ends where the low bits of a hash rolled over the last `WINDOW` ids of the same document are all ones
(256 ids apart on average), but not before MIN nor after MAX ids, so equal passages give equal chunks wherever
they stand. Duplicated chunks are dropped map-side before their one shuffle; chunks/ is bucketed by
digest, so that reading moves the references to the chunks and not the chunks.

Defined results: null text is empty and has only the end id; repeated rows are documents of their own, in a
stable order; an empty table gives an empty store; other columns of the input are not stored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import batches, cut, documents, drop, enter, new_path, register, shuffle_partitions, texts

WINDOW, MIN, MASK, MAX = 8, 64, 255, 1024
#: ASCII marks: neither letters nor digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Merkle:
    """Root over leaves given one by one, with a logarithm of them in memory."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def push(self, leaf: bytes) -> None:
        level, node = 0, digest(b"\0" + leaf)
        while self.peaks and self.peaks[-1][0] == level:
            node = digest(b"\1" + self.peaks.pop()[1] + node)
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        node = b""
        for _, peak in reversed(self.peaks):
            node = digest(b"\1" + peak + node) if node else peak
        return node


def merkle(leaves) -> bytes:
    m = Merkle()
    for leaf in leaves:
        m.push(leaf)
    return m.root()


#: Words in lower case whose bytes are the model's letters: ASCII, and the composed letters of Latin-1.
SIMPLE = re.compile("[a-zß-öø-ÿ]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes of Latin-1 stand for themselves, the others for what follows 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordEncoder(dict):
    """Encodes by the tokenizers library, each ASCII-white-space-separated word once: a word's ids as bytes.

    The tokenizer drops white space and no match of its pattern holds any, so the words' ids in a row are the
    text's ids. A word that is ASCII letters and then marks is two matches, and digits are one each; these are
    looked up by themselves, letters with A-Z lowered. A run of simple letters in lower case goes straight to the
    library's model, as its normaliser and pattern leave it whole; any other word goes the library's whole way,
    and so does every word if on samples the two ways differ.

    Two generations of words are kept, of `most` bytes together; what was not used since the last turn goes.
    """

    SAMPLES = ("the", "quick", "übergröße", "ça", "año", "zzxqjv")

    def __init__(self, definition: str, width: int = 2, most: int = 192 << 20):
        self.tokenizer = Tokenizer.from_str(definition)
        self.letters = byte_letters()
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # no word comes twice
        self.tokenize = model.tokenize
        self.kind = {1: "B", 2: "H", 4: "I"}[width]
        self.whole = any(self._simple(w.encode()) != self._any(w.encode()) for w in self.SAMPLES)
        parts = [("Ab,", "ab", ","), ("c!?", "c", "!?"), ("12", "1", "2")]
        self.split = all(self._any(w.encode()) == b"".join(self._any(x.encode()) for x in p) for w, *p in parts)
        self.old: dict[bytes, bytes] = {}
        self.most, self.size = most // 2, 0

    def _bytes(self, ids: list[int]) -> bytes:
        try:
            return array(self.kind, ids).tobytes()
        except OverflowError:
            raise ValueError(f"id {max(ids)} doesn't fit in {array(self.kind).itemsize} bytes") from None

    def _any(self, word: bytes) -> bytes:
        return self._bytes(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)

    def _simple(self, word: bytes) -> bytes:
        text = word.decode("latin-1")
        return self._bytes([x.id for x in self.tokenize(text if word.isascii() else text.translate(self.letters))])

    def _ids(self, word: bytes) -> bytes:
        core = word.rstrip(MARKS)
        if self.split and core:
            tail = self[word[len(core) :]] if len(core) < len(word) else b""
            if core.isalpha():
                return self[core.lower()] + tail
            if core.isdigit() and len(word) > 1:
                return b"".join([self[core[i : i + 1]] for i in range(len(core))]) + tail
            if not self.whole and SIMPLE.fullmatch(low := core.decode().lower()):
                return (self[low.encode()] if tail or low.encode() != word else self._simple(word)) + tail
        return self._any(word)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self._simple(word) if not self.whole and word.isalpha() and word.islower() else self._ids(word)
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[word] = ids
        self.size += len(word) + len(ids) + 180
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


_GEAR = (np.random.default_rng(20).integers(0, 1 << 32, 1 << 16, np.uint32) & MASK).astype(np.uint8)


def cuts(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """Ends of each document's chunks in the whole stream."""
    h = _GEAR[ids & 0xFFFF]
    for k in range(WINDOW.bit_length() - 1):  # a window of 1, 2, 4, 8 ids; of the hash only MASK's bits are looked at
        n = 1 << k
        h[n:] += h[:-n] << np.uint8(n)
    marks = np.flatnonzero(h == MASK) + 1
    first, last = np.searchsorted(marks, bounds[:-1], "right"), np.searchsorted(marks, bounds[1:], "left")
    out = []
    for s, e, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first, last, strict=True):
        ends, at = [], s
        for m in marks[a:b].tolist():
            while m - at > MAX:
                at += MAX
                ends.append(at)
            if m - at >= MIN:
                at = m
                ends.append(at)
        while e - at > MAX:
            at += MAX
            ends.append(at)
        ends.append(e)
        out.append(ends)
    return out


_encoders: dict[str, WordEncoder] = {}
register("store", _encoders)


def _encoder(name: str, sent, width: int) -> WordEncoder:
    """This worker process's encoder, kept with its words from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    enter("store")
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(sent.value, width)
    return _encoders[name]


ENCODED = "doc_id long, n_tokens long, root binary, digests binary, digest binary, ids binary"


def _encoded(docs: DataFrame, definition: str, end: int, width: int) -> DataFrame:
    """A row for every document (doc_id, n_tokens, root, digests of 16 bytes each), and for the chunks that are new to
    a batch (digest, ids)."""
    sent, name = docs.sparkSession.sparkContext.broadcast(definition), uuid.uuid4().hex
    if end >= 1 << 8 * width:
        raise ValueError(f"id {end} doesn't fit in {width} bytes")
    last = end.to_bytes(width, "little")

    def run(arrow):
        encoder = _encoder(name, sent, width)
        for b in batches(arrow, 8 << 20):
            found = [encoder.encode(t) + last for t in texts(b)]
            data = b"".join(found)
            bounds = np.cumsum([0, *map(len, found)]) // width
            del found
            chunks, n, roots, lists = {}, [], [], []
            for s, ends in zip(bounds.tolist(), cuts(np.frombuffer(data, f"<u{width}"), bounds), strict=False):
                digests, at = [], s
                for e in ends:
                    chunk = data[at * width : e * width]
                    key = digest(chunk)
                    chunks.setdefault(key, chunk)
                    digests.append(key)
                    at = e
                n.append(at - s)
                roots.append(merkle(digests))
                lists.append(b"".join(digests))
            rows, more = len(n), len(chunks)
            columns = [
                pa.concat_arrays([b.column("doc_id").cast(pa.int64()), pa.nulls(more, pa.int64())]),
                pa.concat_arrays([pa.array(n, pa.int64()), pa.nulls(more, pa.int64())]),
                *(pa.concat_arrays([pa.array(x, pa.binary()), pa.nulls(more, pa.binary())]) for x in (roots, lists)),
                *(pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array(x, pa.binary())]) for x in (chunks.keys(), chunks.values())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "root", "digests", "digest", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED)


#: Chunks that a block of recipes refers to at most, unless it is one recipe alone.
BLOCK = 4096


def _blocks(arrow):
    """Recipes with the number of their block."""
    for b in arrow:
        size = np.array([len(d) // 16 for d in b.column("digests").to_pylist()], np.int64)
        of, names, now = [], [], BLOCK
        for n in size.tolist():
            if now + n > BLOCK:
                names.append(uuid.uuid4().int >> 65)
                now = 0
            now += n
            of.append(names[-1])
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), *b.columns], ["block", *b.schema.names])


def _manifest(docs: DataFrame) -> DataFrame:
    """One row per part of documents/, streamed in order."""

    def run(arrow):
        part, m, row = None, None, None
        for b in arrow:
            for p, doc, start, n, root in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "start", "n_tokens", "root")), strict=True):
                if p != part:
                    if m is not None:
                        yield out(row, m)
                    part, m, row = p, Merkle(), [p, doc, doc, 0, 0]
                m.push(repr((doc, start, n)).encode() + root)
                row[2], row[3], row[4] = doc, row[3] + 1, row[4] + n
        if m is not None:
            yield out(row, m)

    def out(row, m):
        return pa.RecordBatch.from_pydict({"part": pa.array([row[0]], pa.int32()), "first_doc": pa.array([row[1]], pa.int64()), "last_doc": pa.array([row[2]], pa.int64()), "n_docs": pa.array([row[3]], pa.int64()), "n_ids": pa.array([row[4]], pa.int64()), "root": pa.array([m.root()], pa.binary())})

    return docs.select("part", "doc_id", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start", "root").mapInArrow(run, "part int, first_doc long, last_doc long, n_docs long, n_ids long, root binary")


def _bucketed(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """chunks/ with what Spark must know of its buckets; the catalog's entry serves to tell it and goes at once."""
    name = f"quillon_chunks_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (digest BINARY, ids BINARY) USING parquet CLUSTERED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/chunks'")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 1, width: int = 2) -> None:
    """Encode documents (doc_id, text) and write them as a store. width: bytes of an id; a larger id is an error."""
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        e = cut(_encoded(docs, f.read(), end, width), "encoded")
    buckets, name = shuffle_partitions(spark), f"quillon_chunks_{uuid.uuid4().hex}"
    chunks = e.where("digest is not null").select("digest", "ids").groupBy("digest").agg(F.first("ids").alias("ids"))
    chunks.write.option("compression", "zstd").bucketBy(buckets, "digest").option("path", f"{path}/chunks").format("parquet").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as it has a path of its own
    rows = e.where("digest is null")
    recipes = rows.select("root", "n_tokens", "digests").dropDuplicates(["root"])
    recipes.mapInArrow(_blocks, "block long, root binary, n_tokens long, digests binary").write.parquet(f"{path}/recipes")
    small = rows.select("doc_id", "n_tokens", "root").repartitionByRange(buckets, F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    small = cut(small, "ordered")
    parts = small.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per part: as many as shuffle partitions, whatever the number of documents
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    running = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root")
    placed = small.withColumn("end", F.sum("n_tokens").over(running.rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "part")
    placed = placed.select("part", "doc_id", (F.col("before") + F.col("end") - F.col("n_tokens")).alias("start"), "n_tokens", "root")
    placed.sortWithinPartitions("part", "start").write.parquet(f"{path}/documents")
    _manifest(spark.read.parquet(f"{path}/documents")).withColumn("buckets", F.lit(buckets)).write.parquet(f"{path}/manifest")
    drop(e)
    drop(small)


def _references(arrow):
    """The distinct chunks of each block of recipes; a block is in one batch, as it was when it was numbered, or in a
    few, and then its common chunks come more than once."""
    for b in arrow:
        of: dict[int, set] = {}
        for block, digests in zip(b.column("block").to_pylist(), b.column("digests").to_pylist(), strict=True):
            of.setdefault(block, set()).update(digests[i : i + 16] for i in range(0, len(digests), 16))
        blocks = [block for block, found in of.items() for _ in found]
        keys = [d for found in of.values() for d in sorted(found)]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(keys, pa.binary())], ["block", "digest"])


def read_store(spark: SparkSession, path: str, width: int = 2, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of ids as u4) and, if asked for, ids (array of int), all verified.

    A distinct id stream is put together once. Recipes ask for their chunks by the block, so that a chunk that very
    many of them have is one row for each block.
    """
    docs, recipes, manifest = (spark.read.parquet(f"{path}/{t}") for t in ("documents", "recipes", "manifest"))
    buckets = (manifest.select("buckets").first() or [1])[0]
    wrong = _manifest(docs).exceptAll(manifest.drop("buckets")).count()
    if wrong:
        raise ValueError(f"{path}: {wrong} parts of documents differ from the manifest")

    def assemble(arrow):
        """Rows sorted by block, chunks before recipes."""
        now, known = None, {}
        for b in arrow:
            rows = []
            for block, root, digests, d, data in zip(*(b.column(c).to_pylist() for c in ("block", "root", "digests", "digest", "ids")), strict=True):
                if block != now:
                    now, known = block, {}
                if root is None:
                    if data is None or digest(data) != d:
                        raise ValueError(f"chunk {d.hex()} is missing or damaged")
                    known[d] = data
                    continue
                parts = [digests[i : i + 16] for i in range(0, len(digests), 16)]
                if merkle(parts) != root:
                    raise ValueError(f"recipe {root.hex()} does not give its root")
                found = np.frombuffer(b"".join([known[p] for p in parts]), f"<u{width}").astype("<u4")
                rows.append((root, len(found), zlib.crc32(found.tobytes()), found.astype(np.int32) if ids else None))
            root, n, crc, found = zip(*rows, strict=True) if rows else ((),) * 4
            out = [pa.array(root, pa.binary()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(found, pa.list_(pa.int32()))] if ids else out, ["root", "n", "ids_crc32", "ids"][: 3 + ids])

    wanted = recipes.select("block", "digests").mapInArrow(_references, "block long, digest binary").join(_bucketed(spark, path, buckets), "digest", "left")
    nothing = F.lit(None).cast("binary")
    rows = wanted.select("block", nothing.alias("root"), nothing.alias("digests"), "digest", "ids")
    rows = rows.unionByName(recipes.select("block", "root", "digests", nothing.alias("digest"), nothing.alias("ids")))
    streams = rows.repartition("block").sortWithinPartitions("block", F.col("root").asc_nulls_first()).mapInArrow(assemble, "root binary, n long, ids_crc32 long" + ", ids array<int>" * ids)
    same = F.col("n_tokens") == F.col("n")
    n = F.when(same, F.col("n")).otherwise(F.raise_error(F.lit("a document's recipe is missing or of another length")).cast("long"))
    return docs.join(streams, "root", "left").select("doc_id", "start", n.alias("n_tokens"), "ids_crc32", *["ids"] * ids)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, read back from a store."""
    path = new_path(spark, "store")
    write_store(documents(spark, sf_dir), path)
    return read_store(spark, path, ids=False)
