"""The corpus pipeline as a whole, and methods against direct re-statements."""

import os
import random
import sys
import time

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(__file__))))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from recframe.llm import ann, bpe, license_scan, ngram_join, recompress, suffix_dedup, toxicity, warc  # noqa: E402
from recframe.llm.license_rules import Rule  # noqa: E402
from recframe.llm.queries import QUERIES, tokenizer_files  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def cut(docs, width, min_words):
    """[(doc_id, text left)]"""
    count = {}
    for _, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - width + 1):
            count[raw[i:i + width]] = count.get(raw[i:i + width], 0) + 1
    out = []
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if count[raw[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        runs, left, at = [], b"", 0
        for i in range(len(raw) + 1):
            if i < len(raw) and gone[i] and not (i and gone[i - 1]):
                runs.append(i)
            if (i == len(raw) or not gone[i]) and i and gone[i - 1]:
                s = runs.pop()
                if len(raw[s:i].split()) >= min_words:
                    left, at = left + raw[at:s], i
        left += raw[at:]
        out.append((doc, None if text is None else left.decode("utf-8", "ignore")))
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) + rng.choice(["", "", "", "é", "."])
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short = text(70), text(35)
    rows = [text(rng.randint(60, 160)) for _ in range(150)]
    toxic = [i for i in range(0, 150, 4)]
    for i in toxic:
        ws = rows[i].split(" ")
        ws.insert(rng.randrange(len(ws)), rng.choice(["scumbag", "idiot"]))
        rows[i] = " ".join(ws)
    for i in (1, 2, 3, 5):
        rows[i] = rows[i][:200] + " " + passage + " " + rows[i][200:]
    for i in (6, 7):
        rows[i] += " " + short
    rows[9], rows[10] = rows[9], rows[9] + " tail"
    rows[11], rows[13] = None, ""
    bench = [(1, " ".join(rows[14].split()[:40])), (2, "never seen " * 9)]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)], [(i, 1, int(i in toxic)) for i in range(150)], bench


def test_pipeline(spark, tmp_path):
    docs, labels, bench = corpus()
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert sum(predicted[i] for i, _, y in labels if y) >= 36 and not any(predicted[i] for i, _, y in labels if not y)
    left = [(d[0], d[1]) for d in docs if not predicted[d[0]]]
    left = [(d, t) for d, t in left if d in {c for _, _, c in brute.components(left)}]
    left = cut(left, corpus_pipeline.REPEAT_BYTES, corpus_pipeline.REPEAT_WORDS)
    assert len(dict(left)[1]) < len(dict((d[0], d[1]) for d in docs)[1]) - 300 and dict(left)[6] == docs[6][1]
    dirty = {r[0] for r in brute.contamination(left, bench) if r[5]}
    assert dirty == {14}
    enc = bpe.encoding(*tokenizer_files())
    want = {d: enc.encode_ordinary(t or "") for d, t in left if d not in dirty}
    assert {d: r.ids for d, r in got.items()} == want
    assert all(r.decoded_sha256 == brute.sha(dict(left)[d] or "") for d, r in got.items())


def test_building_a_query_changes_no_setting(spark, tmp_path):
    docs, labels, bench = corpus()
    spark.createDataFrame(docs[:40], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "http://a/b", "x" * 120)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = spark.conf.getAll
    for name, query in QUERIES.items():
        query(spark, str(tmp_path))
        assert {k: v for k, v in spark.conf.getAll.items() if before.get(k) != v} == {} and all(spark.conf.get(k) == before[k] for k in keys if k in before), name


@pytest.mark.parametrize("width", [60, 200])
def test_dedup_of_other_widths(spark, width, monkeypatch):
    rng = random.Random(width)
    rand = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [rand(rng.randint(40, 320)) for _ in range(12)]
    docs = [(i, rand(rng.randint(0, 300)) + rng.choice(shared) + rand(rng.randint(0, 200)) + rng.choice([rng.choice(shared), ""])) for i in range(60)] + [(70, None), (71, "ab " * 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for words in (0, 9):
        for shard in (suffix_dedup.SHARD_BYTES, 3000):  # anchors split over several suffix arrays
            monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
            assert sorted((r.doc_id, r.text) for r in suffix_dedup.dedup(df, width, words).collect()) == cut(docs, width, words)


def test_license_matches_without_number():
    """Linear in the matches; containment as by comparing all pairs."""
    start = time.time()
    found = license_scan.scan_text(b"MIT License " * 100_000)
    assert found[:4] == (200_000, 100_000, 0, 199_998) and time.time() - start < 30
    rng = random.Random(1)
    rules = [Rule(f"r{i}", f"l{i}", rng.randint(1, 4), b"", None, 0.5) for i in range(9)]
    for _ in range(200):
        found = [license_scan.Detection(a := rng.randint(0, 30), a + rng.randint(1, 9), rng.choice(rules)) for _ in range(rng.randint(0, 40))]
        kept = []
        for d in sorted(found, key=lambda d: (-d.rule.priority, d.first - d.last, d.first, d.rule.name)):
            if not any(k.first <= d.first and d.last <= k.last for k in kept):
                kept.append(d)
        assert license_scan.resolve(found) == kept


@pytest.mark.parametrize("text, label, rule", [
    ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl", "mpl-obtain"),
    ("This License Agreement is between the Python Software Foundation (PSF), and the Individual or Organization", "psf", "psf-group"),
    ("Redistributions of source code must retain the above copyright notice", "bsd", "bsd-retain"),
    ("The Software shall be used for Good, not Evil.", "json", "json-evil"),
    ("Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "gpl", "gpl-verbatim"),
    ("the author disclaims copyright to this source code", "public-domain", "pd-copyright"),
])
def test_license_wording(text, label, rule):
    found = license_scan.scan_text(text.encode())
    assert label in found[5].split(",") and rule in {d.rule.name for d in found[7]}


def test_a_larger_licence_name_suppresses_the_smaller():
    kept = license_scan.scan_text(b"licensed under the GNU Affero General Public License version 3")[7]
    assert all(d.rule.label != "gpl" for d in kept if not d.rule.name.startswith("base-")) and any(d.rule.label == "agpl" for d in kept)


def test_kernel_is_the_gap_weighted_one():
    """Triples of a word's classes, found one by one."""
    def features(word):
        chars = [0, *(toxicity._CLASS[b] for b in word)]
        out = {}
        for i in range(len(chars)):
            for j in range(i + 1, len(chars)):
                for k in range(j + 1, len(chars)):
                    if k - i < toxicity.SPAN:
                        t = (chars[i], chars[j], chars[k])
                        out[t] = out.get(t, 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    def direct(a, b):
        x, y = features(a), features(b)
        norm = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
        k = sum(v * y.get(t, 0.0) for t, v in x.items()) / norm if norm else 0.0
        return k ** toxicity.SHARP if k >= toxicity.FLOOR else 0.0

    rng = random.Random(3)
    marks = toxicity.Landmarks.of([b"idiot", b"scumbag", b"moron"])
    words = [b"idiot", b"idi0t", b"iddiot", b"idxiot", b"scumbags", b"scum", b"tidio", b"a", b"moronic", "idiöt".encode()]
    words += ["".join(rng.choice("idotscumbagrn") for _ in range(rng.randint(1, 12))).encode() for _ in range(200)]
    found, values = marks.kernel(words)
    got = np.zeros((len(words), 3))
    got[found] = values
    want = np.array([[direct(w, m) for m in marks.words] for w in words])
    assert np.abs(got - want).max() < 1e-5


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ann_recall_on_the_given_vectors(spark, sf):
    table = pq.read_table(f"/root/testdata/{sf}/embeddings.parquet")
    ids, x = table.column("vec_id").to_numpy(), np.array(table.column("embedding").to_pylist(), np.float64)
    got = {}
    for r in ann.nearest(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in got:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(got)


def test_clashing_columns_and_long_texts(spark):
    docs, labels, _ = corpus()
    odd = [(1, "word " * 300_000, "x", 1, "y"), (2, "z" * 1_000_000, "x", 1, "y"), (None, None, None, None, None), (3, "mit license", "a", 2, "b")]
    df = spark.createDataFrame(odd, "doc_id long, text string, raw string, found int, row string")
    assert license_scan.license_digest(df).count() == license_scan.scan(df).count() == 4
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(df, marks).count() == 4
    model = toxicity.train(spark.createDataFrame(docs, DOCS), marks)
    assert set(toxicity.score(df, model, keep="clean").columns) == set(df.columns)
    assert bpe.round_trip(df, *tokenizer_files()).count() == 4
    assert ngram_join.components(df).count() == recompress.dedup_digest(df).count() == 4
    assert warc.MIN_REVISIT == 100
