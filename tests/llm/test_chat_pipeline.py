"""Chat formatting, and the pipeline's stages on hard rows."""

import random
import re

import numpy as np
import public_tokenizers as P

from quillon.llm import chat


def test_round_trip():
    t = chat.load(open(P.path("byte_bpe_50k.json")).read())
    r = random.Random(3)
    bits = ["<", "|", "\\", "/s>", "[", "INST]", "/INST]", "é", "😀", " ", "\n", "!", "a", "<|end|>", "<s>", "<<SYS>>"]
    for _ in range(400):
        turns = [(r.choice(["user", "assistant", "<|text|>\n"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(1, 4))]
        text, spans = chat.render(turns)
        assert chat.parse(text) == turns
        o = np.array(t.encode(text, add_special_tokens=False).offsets).reshape(-1, 2)
        m = chat.mask(o[:, 0], o[:, 1], spans)
        assert chat.masked_text(text, o[:, 0], o[:, 1], m) == "".join(x for a, x in turns if a == "assistant")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, None, None, "x"), (2, 0, "assistant", ""), (None, 0, "assistant", "n"), (3, 0, "user", "u" * 5000)] + [(4, k, "assistant", f"{k} ") for k in range(1300)] + [(1, 1, "assistant", "b"), (5, 0, "user", "far"), (5, 600, "assistant", "apart"), (5, -3, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "2 AS mask", "3 AS segment")
    parts = chat.format_chats(df)
    assert parts.where("conv_id = 4").count() == 3
    assert [chat.parse(r.formatted) for r in parts.where("conv_id = 5").collect()] == [[("user", "first"), ("user", "far"), ("assistant", "apart")]]
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[2].loss_chars == 0
    assert got[4].n_turns == 1300 and got[4].loss_chars == sum(len(f"{k} ") for k in range(1300))
    assert chat.digests(chat.format_chats(df.where("false"))).count() == 0


def test_stages(spark, hard, empty):
    import corpus_pipeline

    for docs in (hard, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() == docs.count()


def test_each_stage_takes_what_is_planted(spark):
    """Every stage by itself: what it must take goes, and what it must leave stays."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    r = random.Random(5)
    items = [x.text for x in spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(3).collect()]
    prose = lambda n: " ".join(r.choice("abcdefgh") + str(r.randrange(10**6)) for _ in range(n))
    passage = prose(60)
    rows = {
        1: prose(80), 2: f"{prose(30)} {items[0].upper()} {prose(30)}", 3: items[1], 4: f"{prose(40)} {' '.join(items[2].split()[:7])} {prose(40)}",
        5: f"{prose(20)} {passage} {prose(20)}", 6: f"{prose(20)} {passage} {prose(20)}", 8: "", 9: None,
    }
    rows[7] = rows[1]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in rows.items()], "doc_id long, text string, lang string, source string")
    left = {name: {x.doc_id: x.text for x in stages[name](spark, docs, sf).collect()} for name in ("simhash", "substring_dedup", "decontaminate")}
    assert set(left["decontaminate"]) == set(rows) - {2, 3}
    assert left["decontaminate"] == {i: rows[i] for i in left["decontaminate"]}
    assert set(left["simhash"]) == set(rows) - {7, 9}
    assert left["substring_dedup"][5] == rows[5] and passage not in left["substring_dedup"][6] and left["substring_dedup"][1] == rows[1]
    assert left["substring_dedup"][6].split() == rows[6].split()[:20] + rows[6].split()[-20:]


def test_run_equals_brute_force(spark):
    """Of the documents that toxicity's scores leave, what every other stage does by definition."""
    import hashlib

    import corpus_pipeline
    from test_dedup import _classes, _print, _substring
    from test_text import own_tiktoken

    from quillon.llm import toxicity

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    scores = {r.doc_id: r.score for r in toxicity.op1(spark, sf).collect()}
    docs = {i: t for i, t in docs.items() if scores[i] < 0.3}
    prints = {i: _print(t) for i, t in docs.items()}
    nodes = sorted(set(prints.values()))
    classes, first = _classes(nodes, [(x, y) for x in nodes for y in nodes if (x ^ y).bit_count() <= 2]), {}
    for i in sorted(docs):
        first.setdefault(classes[prints[i]], i)
    docs = {i: docs[i] for i in first.values()}
    docs = {i: kept if gone else docs[i] for i, _, gone, kept in _substring(sorted(docs.items()), 50)}
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = low(r.text)
        windows.update(tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7)))
    assert {len(w) for w in windows} == {8}
    clean = {i for i, t in docs.items() if not any(tuple(w[k : k + 8]) in windows for w in [low(t)] for k in range(len(w) - 7))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == clean and len(clean) < len(docs) < len(scores)
    encoding = own_tiktoken()
    for i, r in got.items():
        ids = encoding.encode_ordinary(docs[i])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[i].encode()).hexdigest()
