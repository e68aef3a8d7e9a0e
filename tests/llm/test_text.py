"""Operators that keep rows as they come: byte-level BPE, decontamination, the store of ids."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from quillon.llm import byte_bpe, decontaminate, store

TEXTS = ["", " ", "  \n \n x", "a" * 2000, "ab" * 900, " " * 50 + "x", "don't I'LL", "x\x85\xa0y \x1c z", "İ! ς' aΣ"]


def _random(n, alphabet, size=200, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


def own_tiktoken():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op6_digests_equal_tiktoken(spark):
    want, sf = own_tiktoken(), "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in byte_bpe.op6(spark, sf).collect():
        ids = want.encode_ordinary(texts.pop(r.doc_id))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(want.decode_bytes(ids)).hexdigest()
    assert not texts


def test_bpe_equals_tiktoken():
    want = own_tiktoken()
    ranks = want._mergeable_ranks
    model = byte_bpe.ByteBpe(ranks, P.PATTERN)
    texts = TEXTS + _random(300, "aabbcd  \n\t'sé漢1!́😀\x85\xa0\x1c")
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == want.encode_ordinary(t)
        assert model.decode(ids) == t.encode()


def test_bpe_long_pieces_by_heap_equal_matrices():
    model = byte_bpe.ByteBpe(byte_bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), P.PATTERN)
    for t in _random(60, "theandofxyz", 120, 3):
        if t and t.encode() not in model.ranks:
            m = model.bytes[np.frombuffer(t.encode(), np.uint8)][None]
            assert model.merge_long(t.encode()).tolist() == model.merge_matrix(m, np.array([len(t)]))[0].tolist()


def test_bpe_rows(hard, empty):
    rows = byte_bpe.encode_documents(hard).collect()
    assert len(rows) == hard.count() and all(r.decoded == (r.text or "") for r in rows)
    assert byte_bpe.encode_documents(empty).count() == 0
    by = byte_bpe.encode_documents(hard, keep=["doc_id"], digest=True).collect()
    assert {r.n_tokens for r in by if r.doc_id in (2, 3)} == {0}


def _hits(text, items, window=8):
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, ids = low(text), set(), set()
    for i, t in items:
        p = low(t)
        for a in range(max(1, len(p) - window + 1) if p else 0):
            q = p[a : a + window]
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    hit.update(range(k, k + len(q)))
                    ids.add(i)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("group", [4 << 20, 40])
def test_decontaminate(spark, hard, empty, group):
    items = [(1, "fox jumps"), (2, "p1 p2 p3 p4 p5 p6 p7 p8 p9"), (3, None), (4, ""), (5, "É"), (6, "P50 P51 P52 p53 p54 p55 p56 p57, p58"), (7, "éÀÜ 漢字"), (2, "fox jumps")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(hard, bench, group_bytes=group).collect()
    for r in got:
        n, h, ids = _hits(r.text, items)
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, h, ids), r
        for s in r.spans:
            assert r.text[s.start : s.end].strip() == r.text[s.start : s.end]
    spans = next(r.spans for r in got if r.doc_id == 1)
    assert [r[0:2] for r in spans] == [(16, 25)]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(hard, bench.where("false")).selectExpr("sum(n_hit)").first()[0] == 0


def test_store(spark, hard, empty, tmp_path):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    e = store.WordEncoder(open(P.path("word_bpe_49k.json")).read())
    for s in TEXTS + _random(300, "aàbΣσςdİ  \n\t'sé漢1!́😀\x85\xa0\x1c<|", 60):
        assert np.frombuffer(e.encode(s.encode()), "<u2").tolist() == t.encode(s, add_special_tokens=False).ids
    tiny = store.WordEncoder(open(P.path("word_bpe_49k.json")).read(), most=1 << 12)
    for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert np.frombuffer(tiny.encode(x.text.encode()), "<u2").tolist() == t.encode(x.text, add_special_tokens=False).ids
    with pytest.raises(ValueError, match="fit"):
        store.WordEncoder(open(P.path("word_bpe_49k.json")).read(), 1).encode(b"hippopotamus")
    store.write_store(hard, f"file://{tmp_path}/s")
    rows = store.read_store(spark, f"file://{tmp_path}/s").collect()
    want = sorted(((r.doc_id, r.text) for r in hard.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    rows.sort(key=lambda r: r.start)
    at, bag = 0, []
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        at += r.n_tokens
        bag.append((r.doc_id, tuple(r.ids)))
    assert [b[0] for b in bag] == [w[0] for w in want]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(bag, key=key) == sorted(((i, (*t.encode(x or "", add_special_tokens=False).ids, 1)) for i, x in want), key=key)
    by = {(r.doc_id, r.start): r for r in store.read_store(spark, f"file://{tmp_path}/s", ids=False).collect()}
    assert all((by[r.doc_id, r.start].n_tokens, by[r.doc_id, r.start].ids_crc32) == (r.n_tokens, r.ids_crc32) for r in rows) and len(by) == len(rows)
    assert not [x.name for x in spark.catalog.listTables() if x.name.startswith("quillon_chunks")]
    store.write_store(empty, f"file://{tmp_path}/e")
    assert store.read_store(spark, f"file://{tmp_path}/e").count() == 0


def test_store_finds_damage(spark, hard, tmp_path):
    path = f"file://{tmp_path}/s"
    store.write_store(hard.where("doc_id in (1, 11)"), path)
    spark.read.parquet(f"{path}/documents").selectExpr("part", "doc_id + 1 AS doc_id", "start", "n_tokens", "root").write.parquet(f"{path}/other")
    import shutil

    shutil.rmtree(f"{tmp_path}/s/documents")
    shutil.move(f"{tmp_path}/s/other", f"{tmp_path}/s/documents")
    with pytest.raises(ValueError, match="manifest"):
        store.read_store(spark, path)
    path = f"file://{tmp_path}/t"
    store.write_store(hard.where("doc_id in (1, 11)"), path)
    chunks = spark.read.parquet(f"{path}/chunks").collect()
    shutil.rmtree(f"{tmp_path}/t/chunks")
    spark.createDataFrame([(c.digest, bytes(c.ids)[::-1]) for c in chunks], "digest binary, ids binary").write.bucketBy(4, "digest").option("path", f"{path}/chunks").saveAsTable("damaged")
    with pytest.raises(Exception, match="damaged"):
        store.read_store(spark, path).collect()
    spark.sql("DROP TABLE damaged")


def test_chunks_follow_content():
    r = np.random.default_rng(0)
    a = r.integers(0, 49000, 6000).astype(np.uint32)
    b = np.concatenate([r.integers(0, 49000, 777).astype(np.uint32), a])

    def cut(x):
        ends = store.cuts(x, np.array([0, len(x)]))[0]
        return {hashlib.md5(x[s:e].tobytes()).digest() for s, e in zip([0, *ends[:-1]], ends, strict=True)}

    assert len(cut(a) & cut(b)) > 0.7 * len(cut(a))
