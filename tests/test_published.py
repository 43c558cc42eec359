"""Published tables, the embedding cache, the retraining job and the block-pair search."""

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from recframe.operators import datasets as DS
from recframe.operators import ordering as O
from recframe.operators import recommend as RC
from recframe.operators import sampling as S
from recframe.operators import vectors as V
from recframe.sources import io as IO
from recframe.sources.published import PublishedTable, key_bucket


def _table(spark):
    return PublishedTable(spark, os.path.join(tempfile.mkdtemp(prefix="rf-published-", dir="/tmp"), "t"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_and_a_failed_write(spark):
    t = _table(spark)
    assert t.read() is None and t.current() is None
    assert t.publish(spark.range(5).withColumn("p", F.col("id") % 2), ["p"]) == 1
    assert t.publish(spark.range(9).withColumn("p", F.col("id") % 2), ["p"]) == 2
    assert rows(t.read()) == [(i, i % 2) for i in range(9)] and rows(t.read(1)) == [(i, i % 2) for i in range(5)]
    # a writer that dies after its data, before its commit, leaves the old version
    with pytest.raises(Exception):  # noqa: B017
        t.publish(spark.range(3).withColumn("p", F.raise_error(F.lit("lost"))), ["p"])
    spark.range(3).write.parquet(f"{t.path}/data/000000000003-dead/p=0")
    assert rows(t.read()) == [(i, i % 2) for i in range(9)]
    assert t.publish(spark.range(2).withColumn("p", F.lit(0).cast("long")), ["p"]) == 3
    gone = t.vacuum(keep=1)
    assert "000000000003-dead" in gone and rows(t.read()) == [(0, 0), (1, 0)]


def test_upsert_rewrites_touched_partitions_only(spark):
    t = _table(spark)
    df = spark.range(200).select("id", F.lit("old").alias("v"), F.lit(1).alias("o")).withColumn("b", key_bucket("id", 8))
    t.upsert(df, ["id"], ["o"], ["b"])
    before = t.current()["folders"]
    new = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (999, "z", 1)], "id long, v string, o int").withColumn("b", key_bucket("id", 8))
    t.upsert(new, ["id"], ["o"], ["b"])
    after = t.current()["folders"]
    touched = {f"b={r.b}" for r in new.select("b").distinct().collect()}
    assert {p for p in after if after[p] != before.get(p)} == touched
    got = {r.id: r.v for r in t.read().collect()}
    assert got == {**{i: "old" for i in range(200)}, 3: "y", 999: "z"}
    t.compact()
    assert {r.id: r.v for r in t.read().collect()} == got


def test_feature_store_keeps_the_later_row(spark):
    t = _table(spark)
    schema = "k long, v string, updated_at int"
    IO.publish_upsert(t, spark.createDataFrame([(1, "a", 5), (2, "b", 5)], schema), "k")
    IO.publish_upsert(t, spark.createDataFrame([(1, "c", 4), (2, "d", 5), (3, "e", 1)], schema), "k")
    assert rows(t.read().drop("bucket")) == [(1, "a", 5), (2, "d", 5), (3, "e", 1)]


def test_stored_recommendations(spark):
    import datetime as dt
    t, now = _table(spark), dt.datetime(2024, 1, 1, 12)
    make = lambda users, v, minute: spark.createDataFrame([(u, 1, v, 0.5, now - dt.timedelta(minutes=minute)) for u in users], "user_id long, rank int, video_id long, score double, ts timestamp_ntz")
    RC.store_recommendations(t, make([1, 2, 3], 7, 61))
    RC.store_recommendations(t, make([2], 8, 60))
    assert [(r.user_id, r.video_id) for r in RC.stored_recommendations(t, now).collect()] == [(2, 8)]
    assert t.read().count() == 3


def test_embedding_cache_computes_new_texts_only(spark):
    cache = V.EmbeddingCache(_table(spark), dim=8, compact_after=2)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id long, text string")
    first = cache.embed(df, "id", "text")
    assert {r.id: r.cached for r in first.collect()} == {1: False, 2: False, 3: False, 4: False}
    assert cache.table.read().count() == 3  # one vector a text
    more = spark.createDataFrame([(5, "b"), (6, "c"), (7, "")], "id long, text string")
    assert {r.id: r.cached for r in cache.embed(more, "id", "text").collect()} == {5: True, 6: False, 7: True}
    version = cache.table.current()["version"]
    assert all(r.cached for r in cache.embed(more, "id", "text").collect()) and cache.table.current()["version"] == version
    cache.embed(spark.createDataFrame([(8, "d")], "id long, text string"), "id", "text")
    assert max(len(n) for n in cache.table.current()["folders"].values()) == 1  # compacted
    assert cache.table.read().count() == 5


def test_retraining_gate_and_summary(spark):
    import datetime as dt
    n = 120
    df = spark.createDataFrame([(f"r{i}", i % 7, i % 11, int(i % 3 == 0), dt.datetime(2024, 1, 1), "watch") for i in range(n)],
                               "record_id string, user_id long, video_id long, label int, feedback_timestamp timestamp_ntz, label_source string")
    t = _table(spark)
    assert S.retraining_dataset(df, t, "record_id", min_samples=n + 1) is None and t.current() is None
    r = S.retraining_dataset(df, t, "record_id", min_samples=n).first()
    assert (r.total_samples, r.positive_samples, r.negative_samples) == (80, 40, 40)
    assert (r.train_samples, r.val_samples, r.test_samples) == (64, 8, 8)
    assert S.merge_gate(df, df, n + 1).count() == 0 and S.merge_gate(df, df, n).count() == n


def test_cuts_equal_a_sort(spark):
    rng = random.Random(3)
    data = [(rng.choice([0, 5, 10 ** 15, -7, rng.randint(-10 ** 6, 10 ** 6)]), i, rng.choice("abc")) for i in range(900)] + [(5, 1000 + i, "hot") for i in range(600)]
    df = spark.createDataFrame(data, "k long, id long, g string").repartition(5)
    ranks = lambda sizes: sizes.select("g", F.explode(F.array(*[F.struct(F.lit(f"c{p}").alias("cut"), F.floor(F.col("n") * p / 10).alias("rank")) for p in (0, 3, 8, 10)])).alias("c")).select("g", "c.*")
    for group in (None, "g"):
        cuts = O.order_cuts(df, F.col("k"), ["id"], ranks, group)
        out = O.with_cuts(df, cuts, ["c0", "c3", "c8", "c10"], F.col("k"), ["id"], group).collect()
        for g in ({None} if group is None else {d[2] for d in data}):
            order = sorted(d[:2] for d in data if g is None or d[2] == g)
            for p in (0, 3, 8, 10):
                before = {(r.k, r.id) for r in out if (g is None or r.g == g) and r[f"_before_c{p}"]}
                assert before == set(order[:int(len(order) * p / 10)])
    empty = df.limit(0)
    assert S.random_split(empty, ["id"]).count() == 0 and S.balance_labels(empty.withColumn("label", F.lit(1)), ["id"]).count() == 0


def test_negatives_of_users_with_hardly_a_pool(spark):
    pos = [(f"p{u}-{v}", u, v) for u in (1, 2, 3) for v in range(60) if not (u == 1 and v in (5, 6)) and not (u == 3 and v > 2)]
    ctx = "previously_watched_category string, interaction_time_day string, interaction_time_hour int, device string"
    df = spark.createDataFrame([(*p, "c", "d", 1, "m") for p in pos], f"interaction_id string, user_id long, video_id long, {ctx}")
    videos = spark.createDataFrame([(v,) for v in range(60)], "id long")
    got = {}
    for r in S.negatives_per_positive(df, videos, 3).collect():
        got.setdefault((r.user_id, r.source_interaction_id), []).append(r.video_id)
    taken = {(u, v) for _, u, v in pos}
    assert all(len(set(vs)) == len(vs) and not any((k[0], v) in taken for v in vs) for k, vs in got.items())
    assert all(sorted(got[1, p]) == [5, 6] for p, u, _ in pos if u == 1)  # the whole pool
    assert not any(k[0] == 2 for k in got)  # no pool
    assert all(len(got[3, p]) == 3 for p, u, _ in pos if u == 3)


def test_block_pair_search_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    x[50:120] = x[3]  # a group of equal vectors
    items = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, embedding array<float>")
    queries = items.where("id % 3 = 0").select(F.col("id").alias("query_id"), "embedding")
    unit = x.astype(np.float64) / (np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True) + V.EPS)
    for block, tile in ((V.BLOCK_BYTES, V.TILE_BYTES), (8 * 8 * 40, 8 * 90)):  # 8 item blocks, tiles of a few rows
        got = {}
        for r in V.vector_topk_exact(queries, items, 12, block_bytes=block, tile_bytes=tile).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.item_id))
        assert sorted(got) == [i for i in range(0, 300, 3)]
        for q, found in got.items():
            score = (unit * unit[q]).sum(axis=1)
            assert [i for _, i in sorted(found)] == np.lexsort((np.arange(300), -score))[:12].tolist()
    assert V.vector_topk_exact(queries, items.limit(0), 5).count() == 0


def test_masking_in_arrays_and_maps(spark):
    schema = """id int, steps array<struct<name:string,password:string,notes:array<string>>>,
                by map<string,struct<token:string,n:int,text:string>>, plain map<string,int>, deep array<map<string,array<string>>>"""
    df = spark.createDataFrame([(1, [("a", "p", ["x" * 1200])], {"api_key": ("t", 3, "s"), "ok": ("t", 4, "u")}, {"secret": 1, "k": 2},
                                 [{"auth": ["q"], "fine": ["r"]}])], schema)
    r = DS.mask_sensitive(df).first()
    assert r.steps[0].password == DS.MASK and r.steps[0].name == "a" and r.steps[0].notes[0] == "x" * 1000 + "...(1200 chars)"
    assert tuple(r.by["ok"]) == (DS.MASK, 4, "u") and tuple(r.by["api_key"]) == (DS.MASK, None, DS.MASK)
    assert r.plain == {"secret": None, "k": 2} and r.deep == [{"auth": [DS.MASK], "fine": ["r"]}]


def test_capture_sample(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("request_id"), F.lit("i").alias("input_features"), F.lit("o").alias("output_predictions"))
    kept = DS.capture_sample(df, 10.0, inputs=False)
    assert 300 < kept.count() < 500 and kept.where("input_features is not null or output_predictions is null").count() == 0
    assert rows(DS.capture_sample(df, 100.0).select("request_id")) == rows(df.select("request_id"))
