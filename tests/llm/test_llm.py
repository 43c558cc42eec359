"""Operators of recframe.llm against plain re-statements, and their edge cases."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from recframe.llm import ann, bpe, chat, decontaminate, license_scan, ngram_join, recompress, shard, suffix_dedup, toxicity  # noqa: E402
from recframe.llm.license_rules import ANCHORS, RULES  # noqa: E402
from recframe.llm.queries import tokenizer_files  # noqa: E402

SCHEMA = "doc_id long, text string"


def corpus():
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(60)] + ["é", "Über", "ñ", "MIT", "License", "the", "of"]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randint(30, 300))) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[i] + " tail %d" % i) for i in range(8)]  # near copies
    rows += [(40 + i, base[0]) for i in range(5)]  # exact copies
    rows += [(50 + i, rng.choice(base)[:500] + " x%d " % i + base[3][100:900]) for i in range(6)]  # shared passages
    rows += [(60, None), (61, ""), (62, "  \n"), (63, "one"), (64, "one two three four"), (65, "ly. " * 900), (66, "a b " * 700), (67, "ly. " * 500),
             (68, "z" * 2000), (69, base[2].upper())]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def ordered(rows):
    return sorted(rows, key=repr)


def test_contamination(spark, docs):
    items = [(1, corpus()[0][1]), (2, "w1"), (None, "the of"), (2, "w2 w3"), (5, None), (6, ""), (7, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    assert rows_of(decontaminate.contamination(docs, bench)) == ordered(brute.contamination(corpus(), items))
    # many blocks of phrases, one pass each; repeated items; a phrase that thousands of words match
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(decontaminate, "BLOCK_WORDS", 400)
        again = spark.createDataFrame(items + items, "item_id int, text string")
        assert rows_of(decontaminate.contamination(docs, again)) == ordered(brute.contamination(corpus(), items))
    common = [(1, "ly"), (3, "LY ly"), (2, "a b a")]
    assert rows_of(decontaminate.contamination(docs, spark.createDataFrame(common, "item_id int, text string"))) == ordered(brute.contamination(corpus(), common))
    none = spark.createDataFrame([], "item_id int, text string")
    assert not any(r[5] for r in rows_of(decontaminate.contamination(docs, none)))


def test_wordwise_and_bytewise_dedup(docs, monkeypatch):
    want5, want9 = ordered(brute.word_window_dedup(corpus())), ordered(brute.byte_dedup(corpus()))
    assert rows_of(recompress.dedup_digest(docs)) == want5
    assert rows_of(suffix_dedup.dedup_digest(docs)) == want9
    # many buckets and parts, and anchors split over several suffix arrays
    for module in (recompress, suffix_dedup):
        monkeypatch.setattr(module, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 2500)
    assert rows_of(recompress.dedup_digest(docs)) == want5
    assert rows_of(suffix_dedup.dedup_digest(docs)) == want9


def test_bytewise_dedup_of_a_repeated_line_at_the_head(spark):
    rng = random.Random(11)
    rand = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = []
    for i in range(100):
        passage = (rand(rng.randint(200, 230)) * 3)[:rng.randint(420, 520)]
        rows += [(2 * i, passage + rand(900)), (2 * i + 1, rand(700) + passage + rand(500))]
    assert rows_of(suffix_dedup.dedup_digest(spark.createDataFrame(rows, SCHEMA))) == ordered(brute.byte_dedup(rows))


def test_jaccard_components(docs, monkeypatch):
    want = ordered(brute.components(corpus()))
    assert rows_of(ngram_join.components(docs)) == want
    monkeypatch.setattr(ngram_join, "AGREE", ngram_join.MIN_HASHES + 1)  # no families: the join alone finds all links
    assert rows_of(ngram_join.components(docs)) == want
    kept = [r[0] for r in ngram_join.keep_one(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def test_license_scan(docs):
    got = {r.doc_id: tuple(r)[:6] for r in license_scan.license_digest(docs).collect()}
    assert all(got[e[0]] == e for e in brute.license_base(corpus()))
    assert len(RULES) > 200
    for rule in RULES:  # each match contains the keyword and an anchor
        plain = rule.regex.pattern
        assert any(a in rule.keyword or a in plain for a in ANCHORS), rule.name
    found = license_scan.scan_text(b"Licensed under the Apache License, Version 2.0")
    assert found[5] == "apache" and [d.rule.name for d in found[7]] == ["apache-licensed-0"]


def test_shards(docs):
    rows = shard.shard_digest(docs).collect()
    assert len(rows) == len(corpus())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1
    text = dict(corpus())
    assert all(r.text_crc32 == brute.crc(text[r.doc_id]) and r.size == len((text[r.doc_id] or "").encode()) + 8 for r in rows)


def test_hypergeometric_law():
    rng = random.Random(1)
    draws = [shard.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.1 and 0 <= min(draws) and max(draws) <= 20
    m = shard.communication_matrix([5, 0, 17, 3], 6, 2)
    assert [sum(r) for r in m] == [5, 0, 17, 3] and [sum(c) for c in zip(*m, strict=True)] == [5, 4, 4, 4, 4, 4]


def test_bpe_round_trip(docs):
    rank, pattern = tokenizer_files()
    enc = bpe.encoding(rank, pattern)
    for r in bpe.round_trip(docs, rank, pattern).collect():
        text = dict(corpus())[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))
    text = "word  two\n three's  x" * 50 + " é ü  9" * 40
    assert bpe.encode(enc, text, limit=37) == enc.encode_ordinary(text)


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    words = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam", "nostrud"]
    rows, labels = [], []
    for i in range(600):
        ws = [rng.choice(words) + rng.choice(["", "um", "is"]) for _ in range(30)]
        bad = i % 5 == 0
        if bad:
            ws[rng.randrange(30)] = rng.choice(["scumbag", "idiot"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "such an id-iot, idxiot")]
    got = {r.doc_id: r for r in toxicity.toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert all(got[i].predicted == y for i, y in labels if got[i].held_out)
    assert got[1000].predicted == got[1001].predicted == 0 and got[1002].predicted == 1


def test_toxicity_sees_all_of_a_long_word():
    rng = random.Random(6)
    words = ["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "aliqua", "veniam", "nostrud"]
    texts = [" ".join(rng.choice(words) for _ in range(30)) + (rng.choice([" scumbag", " idiot"]) if i % 4 == 0 else "") for i in range(200)]
    model = toxicity.fit([t.encode() for t in texts], [int(i % 4 == 0) for i in range(200)])
    plain = "loremipsumdoloramettemporveniamnostrud"
    for insult in ("scumbag", "idiot"):
        for at in (26, 31, len(plain)):
            clean, bad = model.scores([plain.encode(), (plain[:at] + insult + plain[at:]).encode()])
            assert clean < 0.5 <= bad
    chain = "lorem-ipsum,dolor/amet-tempor,magna-idiot"
    assert model.scores([chain.encode()])[0] >= 0.5


def test_ann_recall_and_ties(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    x[300:340] = x[7]  # a group of equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (920, [1.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(600), -score))[:5]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
    assert hits >= 0.9 * 5 * len(got)


def test_ann_repeated_ids_take_one_place(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.standard_normal((16, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1, (x[0] * 3).tolist())] * 40  # one row again and again
    rows += [(2, (x[0] * 2 + rng.standard_normal(8) / 50).tolist()) for _ in range(40)]  # unlike rows of one id
    rows += [(0, x[0].tolist())] * 40  # the query itself
    got = {r.vec_id: (r.rank, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=10).collect()}
    best = {}
    for i, v in rows[:16] + rows[16:]:
        if i:
            best[i] = max(best.get(i, -np.inf), float(np.dot(v, x[0])))
    want = sorted(best, key=lambda i: (-best[i], i))[:10]
    assert [i for i, _ in sorted(got.items(), key=lambda g: g[1][0])] == want
    assert all(abs(got[i][1] - best[i]) < 1e-9 for i in want)


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "yo"), (2, 0, "system", "x")]
    got = {r.perspective: r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert sorted(got) == ["ann", "bob", "unknown"]
    assert got["ann"].rendered == "<|system|>\ns<|end|>\n<|assistant|>\nhi<|end|>\n<|user:bob|>\n<|end|>\n<|user:unknown|>\nyo<|end|>\n"
    a, b = map(int, got["unknown"].mask.split("-"))
    assert got["unknown"].rendered[a:b] == "yo"


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for df in (recompress.dedup_digest(empty), suffix_dedup.dedup_digest(empty), ngram_join.components(empty), shard.shard_digest(empty),
               license_scan.license_digest(empty), decontaminate.contamination(empty, spark.createDataFrame([(1, "a b")], "item_id int, text string"))):
        assert df.count() == 0
    odd = spark.createDataFrame([(1, "a b c", 1, "r"), (1, "a b c", 1, "r"), (None, None, 2, "q")], "doc_id long, text string, key int, bucket string")
    odd = odd.withColumn("row", F.lit(1)).withColumn("raw", F.lit("x")).withColumn("_key", F.lit(2))
    for f in (suffix_dedup.dedup, recompress.dedup, ngram_join.keep_one, shard.shuffle_to_shards):
        assert set(odd.columns) <= set(f(odd).columns) and f(odd).count() == (2 if f is ngram_join.keep_one else 3)
