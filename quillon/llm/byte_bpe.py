"""Byte-level BPE by a file of ranks, encoded and decoded exactly as the tiktoken library does.

A text is cut by the tokenizer's pattern; every distinct piece is merged once per worker and looked up after
that. New pieces are bucketed by length into padded matrices of ids. Each round finds every row's leftmost pair
of least rank through a hash table of mergeable pairs, merges it, and compacts the matrix by one column; rows
without a mergeable pair leave. Pieces beyond `LONG` bytes, whose rounds would cost the square of their length,
are merged in the same order with a heap.

Documents stay in their partitions: no shuffle. The ranks (about 1 MB, fixed) are broadcast.
Defined results: null text encodes as empty (no ids); repeated rows give equal rows; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import uuid

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, documents, enter, register

LONG = 1024
#: Units that a worker keeps; when full it starts anew.
CACHE = 500_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class PairTable:
    """Open-addressing hash table from a pair of ids to the id of their concatenation, probed for whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append((a << 32) | b)
                    values.append(rank)
        self.size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(65 - self.size.bit_length())
        self.keys = np.full(self.size, -1, np.int64)
        self.values = np.zeros(self.size, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(keys)
        while len(keys):  # of those that meet at a free slot one stays, the others go on
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            self.values[at[free]] = values[free]
            rest = self.keys[at] != keys
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], none)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.size - 1)
            got = self.keys[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (got != -1)]
        return out


class _Cache(dict):
    """Unit to number; an unknown one is given to `missing`."""

    def __missing__(self, unit):
        return self.missing(unit)


class ByteBpe:
    #: White space here is a superset of the pattern's.
    inner_space = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.pairs = PairTable(ranks)
        self.none = max(ranks.values()) + 1
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        parts: list[bytes] = [b""] * self.none
        for token, rank in ranks.items():
            parts[rank] = token
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.vocabulary = np.frombuffer(b"".join(parts), np.uint8)
        self._clear()

    def _clear(self) -> None:
        self.cache = _Cache()
        self.ids = np.empty(0, np.uint32)
        self.lengths = np.empty(0, np.int64)

    # -------- one piece, or many

    def merge_matrix(self, m: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
        """m: (rows, width) ids padded with -1 on the right, n: their numbers of ids. Merged ids by row."""
        out: list = [None] * len(m)
        rows, none = np.arange(len(m)), self.none

        def ranked(left, right):
            r = np.full(left.shape, none, np.int64)
            real = right >= 0
            r[real] = self.pairs.find(left[real], right[real], none)
            return r

        rank = ranked(m[:, :-1], m[:, 1:])
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), none)
            done = least == none
            for k in np.flatnonzero(done):
                out[rows[k]] = m[k, : n[k]]
            live = ~done
            if not live.any():
                break
            m, n, rank, rows, at, least = m[live], n[live] - 1, rank[live], rows[live], at[live], least[live]
            k = np.arange(len(rows))
            m[k, at] = least
            stay = np.ones(m.shape, bool)
            stay[k, at + 1] = False
            m = m[stay].reshape(len(rows), -1)
            stay = np.ones(rank.shape, bool)
            stay[k, at] = False
            rank = rank[stay].reshape(len(rows), -1)
            width = int(n.max())
            m, rank = m[:, :width], rank[:, : width - 1]
            right = at < width - 1
            i, p = k[right], at[right]
            rank[i, p] = ranked(m[i, p], m[i, p + 1])
            left = (at > 0) & (at <= width - 1)
            i, p = k[left], at[left]
            rank[i, p - 1] = ranked(m[i, p - 1], m[i, p])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order through a heap of (rank, position)."""
        ids = [int(x) for x in self.bytes[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        end = list(range(1, n + 1))
        before, after, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list = []

        def offer(i):
            if i >= 0 and (j := after[i]) < n and (r := self.ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, e = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or end[j] != e:
                continue
            ids[i], end[i], after[i], alive[j] = r, end[j], after[j], False
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = np.array([whole])
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                n = len(p)
                buckets.setdefault(n if n < 16 else 1 << (n - 1).bit_length(), []).append(i)
        for width, rows in buckets.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                raw = b"".join(pieces[i].ljust(width, b"\0") for i in part)
                n = np.array([len(pieces[i]) for i in part])
                m = self.bytes[np.frombuffer(raw, np.uint8)].reshape(len(part), width)
                m[np.arange(width) >= n[:, None]] = -1
                for i, ids in zip(part, self.merge_matrix(m, n), strict=True):
                    out[i] = ids
        return out

    # -------- texts

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.

        A text is looked up by units: what stands before its first space, then each space with what follows it up
        to the next. No match of the pattern crosses from one unit to the next, unless a space has white space on
        both sides (or ends the text after white space); such a text is looked up match by match.
        """
        if len(self.cache) > CACHE:
            self._clear()
        size, new = len(self.lengths), []

        def missing(unit):
            i = self.cache[unit] = size + len(new)
            new.append(unit)
            return i

        self.cache.missing = missing
        get, found = self.cache.__getitem__, []
        for t in texts:
            if self.inner_space.search(t):
                units = self.pattern.findall(t)
            else:
                first, *units = t.split(" ")
                units = [" " + u for u in units]
                units.insert(0, first)
            found.append(np.array(list(map(get, units)), np.int64))
        if new:
            self._add(new)
        starts = np.cumsum(self.lengths) - self.lengths
        return [self.ids[_spread(starts[f], self.lengths[f])] for f in found]

    def _add(self, units: list[str]) -> None:
        """Merge the pieces of new units, each once."""
        number: dict[str, int] = {}
        each = [self.pattern.findall(u) for u in units]
        which = np.array([number.setdefault(p, len(number)) for pieces in each for p in pieces], np.int64)
        merged = self.merge([p.encode() for p in number])
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.concatenate(merged).astype(np.uint32) if merged else np.empty(0, np.uint32)
        of = np.repeat(np.arange(len(units)), np.fromiter(map(len, each), np.int64, len(each)))
        self.ids = np.concatenate([self.ids, flat[_spread((np.cumsum(sizes) - sizes)[which], sizes[which])]])
        self.lengths = np.concatenate([self.lengths, np.bincount(of, sizes[which], len(units)).astype(np.int64)])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.vocabulary[_spread(self.starts[ids], self.sizes[ids])].tobytes()


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    out += np.arange(total)
    return out


_models: dict[str, ByteBpe] = {}
register("byte_bpe", _models)


def _model(name: str, sent, pattern: str) -> ByteBpe:
    """This worker process's model, kept with its cache from task to task."""
    enter("byte_bpe")
    if name not in _models:
        _models.clear()
        _models[name] = ByteBpe(read_ranks(sent.value), pattern)
    return _models[name]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, text: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """The columns `keep` (all) with `ids` (array of int) and `decoded` (string); with digest instead n_tokens,
    ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256."""
    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern, name = pattern or public_tokenizers.PATTERN, uuid.uuid4().hex
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in {f.name for f in new}]
    source = docs.select(*kept, *([] if text in kept else [text]))
    out = T.StructType([*(docs.schema[c] for c in kept), *new])
    schema = to_arrow_schema(out)

    def run(arrow):
        model = _model(name, sent, pattern)
        for b in batches(arrow, 4 << 20):
            ids = model.encode([x or "" for x in b.column(text).to_pylist()])
            if digest:
                values = [[len(x) for x in ids], [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], [hashlib.sha256(model.decode(x)).hexdigest() for x in ids]]
            else:
                values = [[x.astype(np.int32) for x in ids], [model.decode(x).decode() for x in ids]]
            yield pa.RecordBatch.from_arrays([b.column(c).cast(schema.field(c).type) for c in kept] + [pa.array(v, type=schema.field(len(kept) + i).type) for i, v in enumerate(values)], schema=schema)

    return source.mapInArrow(run, out)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return encode_documents(documents(spark, sf_dir), keep=["doc_id"], digest=True)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its tokens' number and digests: the last stage of a pipeline."""
    return encode_documents(docs, keep=["doc_id"], digest=True)
