"""Encoder facts: vocabularies, bucketize, cyclical, z-score, quantiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recframe.operators import encoders as E
from recframe.operators import ranking
from recframe.operators.ordering import exact_quantiles, global_prefix


def test_string_vocab_lookup(spark):
    vals = spark.createDataFrame([("apple",), ("banana",), ("cherry",), (None,)], "v string")
    vocab = E.string_vocab(vals, "v")
    assert vocab.count() == 5
    probe = spark.createDataFrame([("apple",), ("zzz",), (None,)], "v string")
    got = {r.v: r.idx for r in E.lookup_string(probe, "v", vocab, "idx").collect()}
    assert got["apple"] >= 2 and got["zzz"] == 1 and got[None] == 0


def test_start_mask(spark):
    vals = spark.createDataFrame([("a",), ("-",), ("b",)], "v string")
    vocab = E.string_vocab(vals, "v", include_start=True, mask_value="-")
    probe = spark.createDataFrame([("-",), ("a",)], "v string")
    got = {r.v: r.i for r in E.lookup_string(probe, "v", vocab, "i", include_start=True, mask_value="-").collect()}
    assert got["-"] == 2 and got["a"] == 3


def test_bucketize_and_cyclical(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (25.0,), (35.0,)], "x double")
    assert [r.b for r in df.select(E.bucketize("x", [10, 20, 30]).alias("b")).collect()] == [0, 1, 2, 3]
    s, c = E.cyclical(F.lit(6), 24)
    r = df.limit(1).select(s.alias("s"), c.alias("c")).first()
    assert abs(r.s - 1) < 1e-9 and abs(r.c) < 1e-9


def test_zscore_population_std(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (30.0,), (40.0,), (50.0,)], "x double")
    z = E.ZScore.fit(df, "x")
    std = df.select(z.std.alias("s")).first().s
    assert abs(std - 14.142135623730951) < 1e-9


def test_hash_bucket_matches_python(spark):
    import hashlib
    df = spark.createDataFrame([(f"exp:{i}",) for i in range(200)], "k string")
    got = [r.b for r in df.select(E.hash_bucket("k", 10000).alias("b")).collect()]
    exp = [int(hashlib.md5(f"exp:{i}".encode()).hexdigest(), 16) % 10000 for i in range(200)]
    assert got == exp


def test_exact_quantiles_and_global_index(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=500), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(vals)], "v double, id long")
    qs = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {r.q: r.value for r in exact_quantiles(df, "v", qs).collect()}
    for q in qs:
        assert abs(got[q] - np.quantile(vals, q)) < 1e-12
    idx = [r._gidx for r in global_prefix(df, ["v", "id"], partitions=3).orderBy("v", "id").collect()]
    assert idx == list(range(len(vals)))


@pytest.mark.parametrize("batch_rows", [100, 1000])
def test_running_sums_over_many_arrow_batches(spark, batch_rows):
    """Each partition holds five batches and more."""
    rng = np.random.default_rng(5)
    n = 24_000
    score, label = rng.permutation(n) / n, rng.integers(0, 2, n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    try:
        df = spark.createDataFrame(list(zip(score.tolist(), label.tolist(), range(n), strict=True)), "score double, label int, id long")
        sums = global_prefix(df, ["score", "id"], weight="label", partitions=4).orderBy("score").select("_gidx", "_gcum").collect()
        by_score = label[np.argsort(score)]
        assert [r[0] for r in sums] == list(range(n))
        assert [r[1] for r in sums] == (np.cumsum(by_score) - by_score).tolist()
        qs = [0.1, 0.5, 0.9, 0.999]
        got = {r.q: r.value for r in exact_quantiles(df, "score", qs).collect()}
        assert all(abs(got[q] - np.quantile(score, q)) < 1e-12 for q in qs)
        ranks = np.empty(n)
        ranks[np.argsort(score)] = np.arange(1, n + 1)
        pos = int(label.sum())
        want = (ranks[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
        assert abs(ranking.auc(df, "score", "label").first()[0] - want) < 1e-12
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
