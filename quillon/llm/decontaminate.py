"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts scans each text once.

Words are runs of ASCII letters and digits (A-Z lowered) and of everything beyond ASCII. The automaton's
patterns are the items' windows of `window` consecutive words. It works on numbered words: a word of the benchmark
is as many characters as its number has digits to the base BASE, each digit in a range of its own, so that a match
is always whole words, no node has many children, and memory is about 140 bytes for each byte of items (290 with
letters). Any other word is one character that no pattern has. Matches are mapped to word numbers and, for the
texts that have any, to character offsets in the original text.

The automaton is broadcast as its items' texts, of at most `group_bytes` (4 MB: an automaton of 560 MB). A larger
benchmark, whose automaton an executor could not hold, is scanned in groups of items, each over all documents.
Documents are never shuffled.

Defined results: a null or empty text has no words and no hits; a null item or an item without words has no
window; an item of fewer words than `window` is one window of them all; repeated items count by their ids, an
item without id still marks words but is not listed; an empty benchmark hits nothing; extra columns pass
through, and a column of the input with a result's name is replaced. The stage keeps rows as they are (repeated
ones too) and drops those with `window` hit words or more.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches, cut, documents, drop, enter, register, texts

#: A-Z to a-z, other bytes below 128 that are not letters or digits to a space.
NORMAL = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32) for c in range(256))
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("_words", T.BinaryType()),
])


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def windows(items: list[tuple[int | None, bytes]], window: int) -> dict[tuple[bytes, ...], list]:
    """Words of a window to ids of its items."""
    found: dict[tuple[bytes, ...], list] = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            ids = found.setdefault(tuple(w[i : i + window]), [])
            if item is not None and item not in ids[-1:]:
                ids.append(item)
    return found


BASE = 64


class _Codes(dict):
    """Words of the benchmark to characters; any other word is one that stands for all of them."""

    def __init__(self, known: list[bytes]):
        self.digits = 1
        while BASE**self.digits < len(known):
            self.digits += 1
        places = [(1 + BASE * d, BASE**d) for d in range(self.digits)]
        super().__init__((w, "".join(chr(at + i // unit % BASE) for at, unit in places)) for i, w in enumerate(known))

    def __missing__(self, word):
        return "\0"


class Automaton:
    def __init__(self, items: list[tuple[int | None, bytes]], window: int):
        patterns = windows(items, window)
        self.codes = _Codes(sorted({w for p in patterns for w in p}))
        self.trie = ahocorasick.Automaton()
        for p, ids in patterns.items():
            self.trie.add_word("".join(map(self.codes.__getitem__, p)), (len(p), tuple(ids)))
        self.trie.make_automaton()

    def scan(self, found: list[bytes]) -> tuple[np.ndarray, set]:
        """Numbers of the words hit, in order, and the ids of the items found."""
        coded = list(map(self.codes.__getitem__, found))
        matches, items = [], set()
        for end, (n, ids) in self.trie.iter("".join(coded)):
            matches.append((end, n))
            items.update(ids)
        if not matches:
            return np.empty(0, np.int64), items
        at, sizes = np.array(matches, np.int64).T
        ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded))) - 1
        last = np.searchsorted(ends, at) + 1  # the last word's number, plus 1
        mark = np.zeros(len(ends) + 1, np.int64)
        np.add.at(mark, last - sizes, 1)
        np.add.at(mark, last, -1)
        return np.flatnonzero(np.cumsum(mark) > 0), items


def original_spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Character offsets in the original of the runs of consecutive hit words."""
    inside = np.concatenate(([0], (np.frombuffer(text.translate(NORMAL), np.uint8) != 32).astype(np.int8), [0]))
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    breaks = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate(([0], breaks + 1))], hit[np.concatenate((breaks, [len(hit) - 1]))]
    return [{"start": int(s), "end": int(e)} for s, e in zip(chars[starts[first]], chars[ends[last]], strict=True)]


#: The automaton that this worker process has built, by the name of its broadcast.
_built: dict[str, Automaton | None] = {}
register("decontaminate", _built)


def _automaton(name: str, sent, window: int) -> Automaton | None:
    enter("decontaminate")
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(sent.value, window) if sent.value else None
    return _built[name]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, group_bytes: int = 4 << 20
) -> DataFrame:
    """docs with n_words, n_hit, items (ids found, ascending) and spans (hit passages, character offsets)."""
    keep = [c for c in docs.columns if c.lower() not in {f.name for f in RESULT}]
    docs = docs.select(*keep)
    out_type = T.StructType([*docs.schema, *RESULT])
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t")).where("t is not null").distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    context = docs.sparkSession.sparkContext
    out = None
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(groups)) == g).collect()
        sent = context.broadcast(sorted(((r.i, bytes(r.t)) for r in rows), key=lambda r: (r[1], r[0] is None, r[0] or 0)))
        last = out
        scanner = _scanner(sent, window, text, keep, to_arrow_schema(out_type), last is not None)
        out = (docs if out is None else out).mapInArrow(scanner, out_type)
        if groups > 1:
            out = cut(out, "scanned")
            if last is not None:
                drop(last)
            sent.unpersist()
    return out.drop("_words")


def _scanner(sent, window: int, text: str, keep: list[str], schema: pa.Schema, again: bool):
    name = uuid.uuid4().hex

    def run(arrow):
        a = _automaton(name, sent, window)
        for b in batches(arrow):
            n_words, n_hit, items, spans, hits = [], [], [], [], []
            before = list(zip(b.column("items").to_pylist(), b.column("_words").to_pylist(), strict=True)) if again else None
            for i, t in enumerate(texts(b, text)):
                w = words(t)
                hit, found = a.scan(w) if a is not None and w else (np.empty(0, np.int64), set())
                if before:
                    found |= set(before[i][0])
                    hit = np.union1d(hit, np.frombuffer(before[i][1], np.int64))
                n_words.append(len(w))
                n_hit.append(len(hit))
                items.append(sorted(found))
                spans.append(original_spans(t, hit) if len(hit) else [])
                hits.append(hit.tobytes())
            new = [n_words, n_hit, items, spans, hits]
            old = [b.column(c).cast(schema.field(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays(old + [pa.array(x, type=schema.field(len(keep) + i).type) for i, x in enumerate(new)], schema=schema)

    return run


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    found = decontaminate(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, window: int = 8) -> DataFrame:
    """Documents with `window` or more words inside the items' windows go: one whole window of any item, or short items
    of as many words together. A short item alone (a yes, a name) condemns no document. The rest stay as they are."""
    columns = docs.columns
    marked = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    found = decontaminate(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=window)
    return found.where(F.col("n_hit") < window).select([F.col("row")[c].alias(c) for c in columns])
