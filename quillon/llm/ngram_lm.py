"""Language-model scores: an interpolated modified Kneser-Ney model, counted and looked up in shards, order by order.

A round for each order from the highest (3 for op2) to 2: each block of documents sends its distinct n-grams to the
shards of their contexts, in the highest order with their counts in training documents. A shard adds them up to
sorted hash arrays (contexts; words; counts) and answers each block for its n-grams: the count, and the context's
total and numbers of continuations seen once, twice, more often. It sends the numbers of distinct n-grams by what
is left of them without their first word on to the shards of the next order, where they are the counts; those of
order 2 go by word. Then blocks send their words with their counts to the words' shards and ask for counts and
numbers of contexts. Last, with all answers at hand, and the discounts from a few totals that the driver adds up,
a block computes the probabilities of its distinct n-grams and adds their logarithms up by document.

While it answers, a shard holds its arrays in a memory-mapped file that is deleted as soon as it is mapped, and
takes one block's question at a time. The model grows with the corpus and is never sent to the driver or
broadcast. Identities are hashes: 48 bits for a word, the shard and 40 bits for a context (about two in a million
contexts share theirs, at every size, as shards grow in number, not in size).

Before a text stand as many start tokens as contexts have words. Texts are split once, to blocks of word numbers. A
round takes several passes over ranges of shards; what a pass shuffled is dropped after it.

Defined results: null text is empty, and so is one end token; a null doc_id is training data; without training
documents every token is as likely as any; repeated rows are scored and counted each; other columns are ignored.
"""

from __future__ import annotations

import bisect
import ctypes
import gc
import os
import pickle
import tempfile
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import ask, mix, pack, shard_slices, word_hashes
from .common import cut, documents, drop, enter, held_out, shuffle_partitions

END, START = b"\n", np.uint64(0x9E6C63D0876A9A47)
SALT = np.uint64(0xD6E8FEB86659FD93)
#: Passes of a round over the shards.
PASSES = 6


def squeeze(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps([(a.dtype.str, a.tobytes()) for a in arrays], protocol=5))


def unsqueeze(data: bytes) -> list[np.ndarray]:
    return [np.frombuffer(b, d) for d, b in pickle.loads(zstandard.ZstdDecompressor().decompress(data))]


def small(x: np.ndarray) -> np.ndarray:
    """Non-negative numbers in the narrowest type."""
    most = int(x.max()) if len(x) else 0
    return x.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8")


def cut_bits(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """The low 40 or 48 bits as two arrays."""
    return [x.astype("<u4"), ((x >> np.uint64(32)) & np.uint64((1 << (bits - 32)) - 1)).astype("<u1" if bits == 40 else "<u2")]


def join_bits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def add_up(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts) if len(starts) else np.empty(0, x.dtype)


def bits_of(n: int) -> int:
    """Bits that hold numbers below n."""
    return max(1, (n - 1).bit_length())


def order_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of keys of so many bits in ascending order, equal ones as they stand. Where a key leaves bits for its
    place the two are sorted as one number, several times as fast as places by their keys."""
    place = bits_of(len(keys))
    if bits + place > 64:
        return np.argsort(keys, kind="stable")
    both = (keys << np.uint64(place)) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << place) - 1)).astype(np.int64)


def seats(context: np.ndarray, shards: int) -> np.ndarray:
    """A context's identity: its shard, and its low 40 bits."""
    return ((((context >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)) << np.uint64(40)) | (context & np.uint64((1 << 40) - 1))


def mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays, read from a mapped file that has no name any more."""
    out, at = [], 0
    fd, path = tempfile.mkstemp(prefix="quillon-")
    with os.fdopen(fd, "wb") as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    whole = np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.empty(0, np.uint8)
    os.unlink(path)
    for a in arrays:
        out.append(whole[at : at + a.nbytes].view(a.dtype))
        at += a.nbytes
    return out


def trim() -> None:
    """Give back what a worker holds from earlier tasks: words of blocks, and freed arrays that the C library keeps."""
    enter("ngram_lm")
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


# ---------------------------------------------------------------- a block


class Grams:
    """Distinct n-grams, sorted by context and word; `word` are places in `vocabulary`, of 48 bits each, `suffix` is
    the context without its first word, if any."""

    def __init__(self, context: np.ndarray, shards: int, word: np.ndarray, vocabulary: np.ndarray, trained: np.ndarray, suffix: np.ndarray | None):
        seat = seats(context, shards)
        self.least = int(seat.min()) >> 40 << 40 if len(seat) else 0
        seat -= np.uint64(self.least)
        order = order_of(seat, 64 if shards >> 24 else bits_of(int(seat.max()) + 1) if len(seat) else 1)
        new = np.ones(len(seat), bool)
        new[1:] = (by := seat[order])[1:] != by[:-1]
        number = np.cumsum(new) - 1
        self.contexts = by[new]
        wide = bits_of(max(len(vocabulary), 1))
        # words within contexts: the numbers of these are few, so that both fit a key
        key = (number.astype(np.uint64) << np.uint64(wide)) | word[order].astype(np.uint64)
        del seat, by, new, number
        again = order_of(key, wide + bits_of(max(len(self.contexts), 1)))
        order, key = order[again], key[again]
        at = runs(key)
        self.gram = np.empty(len(order), np.int64)
        self.gram[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        self.count = add_up(trained[order].astype(np.int64), at)
        self.word, self.vocabulary = (key[at] & np.uint64((1 << wide) - 1)).astype(np.int64), vocabulary
        first = runs(key[at] >> np.uint64(wide))
        self.first = np.append(first, len(at))
        self.sizes = np.diff(self.first)
        self.suffix = None if suffix is None else suffix[order[at[first]]]

    def slices(self, shards: int):
        """(shard, contexts from, to, n-grams from, to)"""
        of = (self.contexts + np.uint64(self.least)) >> np.uint64(40)
        at = np.searchsorted(of, np.arange(shards + 1, dtype=np.uint64))
        return [(s, int(a), int(b), int(self.first[a]), int(self.first[b])) for s, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]

    def messages(self, shards: int, counts: bool):
        """(shard, message); without counts it only asks."""
        for s, c0, c1, g0, g1 in self.slices(shards):
            words, which = np.unique(self.word[g0:g1], return_inverse=True)
            suffixes, of = (np.empty(0, np.uint64),) * 2 if self.suffix is None else np.unique(self.suffix[c0:c1], return_inverse=True)
            count = self.count[g0:g1] if counts else np.zeros(g1 - g0, np.int64)
            steps = np.diff(self.contexts[c0:c1] & np.uint64((1 << 40) - 1), prepend=np.uint64(0))
            yield s, squeeze(*cut_bits(steps, 40), small(self.sizes[c0:c1]), *cut_bits(self.vocabulary[words], 48), small(which), small(count), suffixes, small(of))


def encode(table: pa.Table) -> pa.Table:
    """Of texts: ids, which of them are null, numbers of tokens, distinct words in order, and which each token is."""
    # white space of ASCII and no other, as bytes.split() has it; at a text's ends it leaves an empty word
    split = pc.ascii_split_whitespace(pc.ascii_lower(table.column("text").cast(pa.string()).fill_null("")).combine_chunks())
    flat = pc.dictionary_encode(split.flatten())
    full = (of := flat.indices.to_numpy()) != (empty if (empty := pc.index(flat.dictionary, "").as_py()) >= 0 else len(of))
    n = np.bincount(pc.list_parent_indices(split).to_numpy()[full], minlength=len(split))
    h, _ = word_hashes([[*flat.dictionary.cast(pa.binary()).to_pylist(), END]])
    token = np.full(n.sum() + len(n), len(h) - 1)
    ends = np.cumsum(n + 1) - 1
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = of[full]
    seen = np.zeros(len(h), bool)
    seen[token] = True
    words, place = np.unique(mix(h[seen]), return_inverse=True)
    back = np.zeros(len(h), np.int64)
    back[seen] = place
    which = back[token]
    ids = table.column("doc_id")
    return pa.table({"tokens": pa.array([squeeze(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), n + 1, words, small(which))], pa.binary())})


class Block:
    """Words and n-grams of a block, the same whenever they are computed."""

    def __init__(self, table: pa.Table, mod: int, remainder: int):
        trim()
        ids, null, self.n, words, which = unsqueeze(table.column("tokens")[0].as_py())
        self.ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        first = np.cumsum(self.n) - self.n
        self.place = np.arange(len(which)) - np.repeat(first, self.n)
        self.held = np.array([held_out(i, mod, remainder) for i in self.ids], bool)
        self.trained = np.repeat(~self.held, self.n)
        self.before = np.empty(len(which), np.uint64)
        self.before[1:] = mix(words ^ SALT)[which[:-1]]
        self.before[first] = START
        self.words, self.which = words >> np.uint64(16), which

    def context(self, length: int) -> np.ndarray:
        """Of the `length` words before each word."""
        out = self.before
        for back in range(1, length):
            older = np.full(len(out), START)
            older[back:] = self.before[:-back]
            older[self.place < back] = START
            out = mix(mix(out) ^ older)
        return out

    def grams(self, length: int, shards: int, first: int, end: int) -> tuple[Grams, np.ndarray]:
        """N-grams with contexts of `length` words in some shards, and the places of their tokens."""
        context = self.context(length)
        of = ((context >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        some = np.flatnonzero((of >= first) & (of < end))
        context, suffix = context[some], None
        del of
        if length > 1:
            suffix = self.context(length - 1)[some]
        return Grams(context, shards, self.which[some], self.words, self.trained[some], suffix), some


def word_slices(words: np.ndarray, shards: int):
    return shard_slices(words << np.uint64(16), shards)


# ---------------------------------------------------------------- shards

ROW = "kind int, shard int, block long, data binary"
#: Kinds of rows; what goes to the order below is BELOW and more, by the pass that reads it.
TO_BLOCK, TOTALS, BELOW = 0, 1, 2
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def passes_of(shards: int, length: int) -> list[int]:
    """Where each pass over the shards begins, and the end, in the round of contexts of `length` words."""
    n = min(shards, PASSES) if length else 1
    return [shards * k // n for k in range(n + 1)]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, block, data = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(block, pa.int64()), pa.array(data, pa.binary())], ["kind", "shard", "block", "data"])


def _ones(x: np.ndarray) -> np.ndarray:
    """How many are 1, 2, 3, 4."""
    return np.array([(x == i).sum() for i in (1, 2, 3, 4)], np.int64)


def _count_grams(shards: int, length: int):
    """Questions of blocks, and counts from the shards of the order above (block -1), to answers, counts for the
    order below and totals."""
    begin = passes_of(shards, length - 1)
    of = lambda shard: BELOW + bisect.bisect(begin, shard) - 1

    def run(table: pa.Table) -> pa.Table:
        trim()
        asked = [(s, b, unsqueeze(d)) for s, b, d in zip(table.column("shard").to_pylist(), table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True)]
        vocabulary = np.unique(np.concatenate([join_bits(q[3], q[4]) for _, _, q in asked]))
        wide, size = bits_of(len(vocabulary)), np.cumsum([0, *(len(q[5]) for _, _, q in asked)])
        key = np.empty(size[-1], np.uint64)
        for i, (_, _, q) in enumerate(asked):
            key[size[i] : size[i + 1]] = np.repeat(np.cumsum(join_bits(q[0], q[1])), q[2])
        # the contexts of one shard: 40 bits, and as many as there are numbers for their words
        number = None
        if 40 + wide > 64:
            number, key = np.unique(key, return_inverse=True)
            key = key.astype(np.uint64)
        key <<= np.uint64(wide)
        for i, (_, _, q) in enumerate(asked):
            key[size[i] : size[i + 1]] |= np.searchsorted(vocabulary, join_bits(q[3], q[4])).astype(np.uint64)[q[5]]
        count = np.concatenate([q[6] for _, _, q in asked])
        order = np.argsort(key, kind="stable")  # blocks send sorted runs
        key = key[order]
        at = runs(key)
        gram = np.empty(len(order), np.int32 if len(order) < 1 << 31 else np.int64)
        gram[order] = np.repeat(np.arange(len(at), dtype=gram.dtype), np.diff(np.append(at, len(order))))
        count, key = add_up(count[order].astype(np.int64), at), key[at]
        del order, at
        first = runs(key >> np.uint64(wide))
        total = add_up(count, first)
        n = [add_up((count == 1).astype(np.int64), first), add_up((count == 2).astype(np.int64), first), add_up((count > 2).astype(np.int64), first)]
        keys, starts, context_total, n1, n2, n3, counts = mapped(key, small(np.append(first, len(key))), *map(small, (total, *n)), small(count))
        totals = _ones(count)
        contexts = len(first)
        context_of = np.repeat(np.arange(contexts, dtype=gram.dtype), np.diff(np.append(first, len(key))))
        del number, key, count, first, total, n
        suffix = np.zeros(contexts, np.uint64)
        out = [(TOTALS, 0, -1, squeeze(totals))]
        for i, (s, block, q) in enumerate(asked):
            if block < 0:
                continue
            mine = gram[size[i] : size[i + 1]]  # where this block's n-grams are among all
            c = context_of[mine[np.cumsum(q[2], dtype=np.int64) - q[2]]]
            if length > 1:
                suffix[c] = q[7][q[8]]
            out.append((TO_BLOCK, s, block, squeeze(small(counts[mine]), *(small(x[c]) for x in (context_total, n1, n2, n3)))))
        del gram, context_of
        seen = counts > 0
        word = (keys[seen] & np.uint64((1 << wide) - 1)).astype(np.int64)
        if length > 1:
            below = Grams(np.repeat(suffix, np.diff(starts.astype(np.int64)))[seen], shards, word, vocabulary, np.ones(len(word), bool), None)
            out += [(of(s), s, -1, data) for s, data in below.messages(shards, True)]
        else:
            kinds = np.bincount(word, minlength=len(vocabulary))
            known, kinds = vocabulary[kinds > 0], kinds[kinds > 0]
            out += [(of(s), s, -1, squeeze(*cut_bits(known[a:b], 48), small(np.zeros(b - a, np.int64)), small(kinds[a:b]))) for s, a, b in word_slices(known, shards)]
        return pa.Table.from_batches([_rows(out)])

    return run


def _count_words(table: pa.Table) -> pa.Table:
    """Words with counts of blocks, and with numbers of contexts, to answers and totals."""
    rows = [(s, b, unsqueeze(d)) for s, b, d in zip(table.column("shard").to_pylist(), table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True)]
    word = np.concatenate([join_bits(p[0], p[1]) for _, _, p in rows])
    raw = np.concatenate([p[2].astype(np.int64) for _, _, p in rows])
    kinds = np.concatenate([p[3].astype(np.int64) if len(p) > 3 else np.zeros(len(p[0]), np.int64) for _, _, p in rows])
    order = np.argsort(word, kind="stable")
    at = runs(word[order])
    words, raw, kinds = mapped(word[order][at], add_up(raw[order], at), add_up(kinds[order], at))
    out = [(TOTALS, 0, -1, squeeze(_ones(kinds), np.array([(raw > 0).sum(), raw.sum(), kinds.sum(), (kinds > 2).sum()], np.int64)))]
    for s, block, p in rows:
        if block >= 0:
            i = np.searchsorted(words, join_bits(p[0], p[1]))
            out.append((TO_BLOCK, s, block, squeeze(small(raw[i]), small(kinds[i]))))
    return pa.Table.from_batches([_rows(out)])


# ---------------------------------------------------------------- probabilities


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from how many counts are 1, 2, 3, 4; a half where these can't tell."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if n1 == 0 or n2 == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def _less(count: np.ndarray, d: tuple) -> np.ndarray:
    return np.where(count == 0, 0, np.where(count == 1, d[0], np.where(count == 2, d[1], d[2])))


class Model:
    """What is the same for all texts."""

    def __init__(self, grams: list[np.ndarray], words: np.ndarray, totals: np.ndarray):
        """grams: by length of contexts, from one word on."""
        self.more, self.one = [discounts(x) for x in grams], discounts(words)
        self.v, self.n, self.kinds, more = (int(x) for x in totals)
        self.rest = self.one[0] * float(words[0]) + self.one[1] * float(words[1]) + self.one[2] * more

    def unigram(self, kinds: np.ndarray) -> np.ndarray:
        """By number of contexts; what the discounts leave goes to all words and one unknown alike."""
        if not self.kinds:
            return np.full(len(kinds), 1 / (self.v + 1))
        return (np.maximum(kinds - _less(kinds, self.one), 0) + self.rest / (self.v + 1)) / self.kinds

    def longer(self, length: int, count, total, n1, n2, n3, lower) -> np.ndarray:
        """Of n-grams with contexts of `length` words, from what they are without the first."""
        seen, d = np.maximum(total, 1), self.more[length - 1]
        left = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / seen, 1.0)
        return np.maximum(count - _less(count, d), 0) / seen + left * lower

    def base(self, raw: np.ndarray) -> np.ndarray:
        return np.log10((raw + 0.1) / (self.n + 0.1 * (self.v + 1)))


def _counted(asked: DataFrame, count, name: str) -> DataFrame:
    """Messages counted by shard, in a table by kind; what they shuffled is deleted when it is written."""
    conf = asked.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return cut(asked.groupBy("shard").applyInArrow(count, ROW), name, "kind")
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def _totals(counted: DataFrame) -> list[np.ndarray]:
    """What the shards' totals add up to: one row of a few numbers from each."""
    rows = [unsqueeze(r.data) for r in counted.where(F.col("kind") == TOTALS).select("data").collect()]
    return [sum(x, np.zeros(4, np.int64)) for x in zip(*rows, strict=True)] or [np.zeros(4, np.int64)] * 2


def _release(spark: SparkSession) -> None:
    """Spark deletes files of shuffles once nothing refers to them, which it else finds out only by chance."""
    gc.collect()
    spark._jvm.System.gc()


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mod: int = 10, remainder: int = 0, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row, by n-grams
    of up to `order` (2 or more) words; learns from rows whose crc32(doc_id as text) mod `mod` is not `remainder`."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    shards = shuffle_partitions(spark)
    blocks = pack(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), encode=encode)

    def grams(length, first, end):
        def send(number, table, _):
            for s, data in Block(table, mod, remainder).grams(length, shards, first, end)[0].messages(shards, length == order - 1):
                yield _rows([(TO_BLOCK, s, number, data)])

        return send

    def words(number, table, _):
        b = Block(table, mod, remainder)
        known, which = b.words, b.which
        raw = np.bincount(which[b.trained], minlength=len(known))
        for s, i, j in word_slices(known, shards):
            yield _rows([(TO_BLOCK, s, number, squeeze(*cut_bits(known[i:j], 48), small(raw[i:j])))])

    rounds, tables = {}, {}
    for length in range(order - 1, -1, -1):
        done, begin = [], passes_of(shards, length)
        for k, (first, end) in enumerate(zip(begin, begin[1:], strict=False)):
            asked = ask(blocks, None, grams(length, first, end) if length else words, ROW)
            if length < order - 1:
                asked = asked.unionByName(rounds[length + 1].where(F.col("kind") == BELOW + k))
            done.append(_counted(asked, _count_grams(shards, length) if length else _count_words, f"grams{length}"))
            del asked
            for above in tables[length + 1] if length < order - 1 else ():
                drop(above, f"kind={BELOW + k}")
            _release(spark)
        tables[length] = done
        rounds[length] = reduce(DataFrame.unionByName, done)
    model = Model([_totals(rounds[length])[0] for length in range(1, order)], *_totals(rounds[0]))

    def scored(_, table, answers):
        b = Block(table, mod, remainder)
        known = b.words
        raw, kinds = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        for s, i, j in word_slices(known, shards):
            raw[i:j], kinds[i:j] = unsqueeze(answers.pop((0, s)))
        own, p = raw[b.which], model.unigram(kinds)[b.which]  # of each token, by ever longer contexts
        for length in range(1, order):
            longer, begin = np.empty(len(p)), passes_of(shards, length)
            for first, end in zip(begin, begin[1:], strict=False):  # a range of shards at a time takes a part of the memory
                g, some = b.grams(length, shards, first, end)
                lower, q = np.empty(len(g.word)), np.empty(len(g.word))
                lower[g.gram] = p[some]
                for s, c0, c1, g0, g1 in g.slices(shards):
                    count, *context = unsqueeze(answers.pop((length, s)))
                    q[g0:g1] = model.longer(length, count.astype(np.int64), *(np.repeat(x.astype(np.int64), g.sizes[c0:c1]) for x in context), lower[g0:g1])
                longer[some] = q[g.gram]
                del g, some, lower, q
            p = longer
        doc = np.repeat(np.arange(len(b.n)), b.n)
        total = np.bincount(doc, np.log10(p), len(b.n))
        yield pa.RecordBatch.from_arrays([
            pa.array(b.ids, pa.int64()), pa.array(b.held), pa.array(b.n, pa.int64()), pa.array(np.bincount(doc, own > 0, len(b.n)).astype(np.int64)),
            pa.array([model.n] * len(b.n), pa.int64()), pa.array(np.bincount(doc, model.base(own), len(b.n))), pa.array(total), pa.array(10 ** np.minimum(-total / b.n, 300)),
        ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    answers = [t.where(F.col("kind") == TO_BLOCK).select("block", F.lit(r).alias("round"), "shard", F.col("data").alias("answer")) for r, t in rounds.items()]
    return ask(blocks, reduce(DataFrame.unionByName, answers), scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (and perplexity) of every document."""
    return score(documents(spark, sf_dir), order=3)
