"""What steps keep on the disks, send to the driver and hold in Python."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recframe.operators import datasets as DS
from recframe.operators import encoders as E
from recframe.operators import features as FT
from recframe.operators import models as M
from recframe.operators import ordering as O
from recframe.operators import sampling as S
from recframe.operators import vectors as V
from recframe.plans import recommend as P
from recframe.queries.common import rounded
from recframe.session import store


@pytest.fixture
def no_estimates(spark):
    """Only joins that say so are broadcast."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffle_files(spark) -> set[str]:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
    return {f.rpartition("/")[2] for f in files.split(",") if "/shuffle_" in f}


def test_stored_steps_leave_no_shuffle_files(spark):
    df = spark.range(5000).groupBy((F.col("id") % 900).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    assert store(df).agg(F.sum("n")).first()[0] == 5000
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    assert spark.conf.get(key, "false") == "false"  # as before
    left = shuffle_files(spark) - before
    assert len({f.split("_")[1] for f in left}) <= 1  # those of the sum above only


def test_vectors_are_not_broadcast(spark):
    pairs = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "user_id long, video_id long")
    v = spark.createDataFrame([(1, [0.5, 0.5])], "id long, embedding array<double>")
    out = FT.video_embeddings(pairs, v, v)
    assert "BroadcastHashJoin" not in physical(out) and physical(out).count("SortMergeJoin") >= 2
    assert sorted(map(tuple, out.collect())) == [(1, 1, [.5, .5], [.5, .5]), (2, 1, [.5, .5], [.5, .5]), (3, 9, [0., 0.], [0., 0.])]


def test_exploded_tags_are_not_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(1, "x|y"), (2, "none")], "id long, tags string")
    tags = spark.createDataFrame([("x", [3.0]), ("y", [1.0])], "tag string, vector array<double>")
    small = V.tag_embedding(items, tags, dim=1)
    monkeypatch.setattr(V, "SENT_VECTORS", 1)
    large = V.tag_embedding(items, tags, dim=1)
    assert "BuildLeft" not in physical(small) and "SortMergeJoin [tag" in physical(large)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_probed_vectors_leave_python_once(spark):
    rng = np.random.default_rng(5)
    x, cents = rng.standard_normal((50, 4)).astype(np.float32), rng.standard_normal((7, 4))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "query_id long, embedding array<float>").coalesce(1)
    want = {(i, int(c)) for i, s in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)) @ cents.T) for c in np.argsort(-s)[:3]}
    for tile in (V.TILE_BYTES, 8 * 7 * 4):
        got = V._nearest_centroids(q, cents, 3, "query_id", "embedding", tile)
        assert got.columns == ["query_id", "_q", "cluster"] and {(r.query_id, r.cluster) for r in got.collect()} == want
    plan = physical(got)
    assert plan.index("Generate explode(_near") < plan.index("MapInArrow")  # rows are made of the lists after Python


def test_positives_without_hits_are_not_exchanged(spark, no_estimates):
    ctx = "previously_watched_category string, interaction_time_day string, interaction_time_hour int, device string"
    df = spark.createDataFrame([(f"p{i}", i % 50, i, "c", "d", 1, "m") for i in range(200)], f"interaction_id string, user_id long, video_id long, {ctx}")
    out = S.negatives_per_positive(df, spark.range(20000), 3)
    assert "hashpartitioning(interaction_id" not in physical(out.where(F.col("user_id") >= 0)).split("Union")[0]
    assert out.count() == 600
    taken = {(i % 50, i) for i in range(200)}
    assert not any((r.user_id, r.video_id) in taken for r in out.collect())


def test_names_are_the_same_by_exchange(spark, monkeypatch):
    ctx = "previously_watched_category string, interaction_time_day string, interaction_time_hour int, device string"
    df = spark.createDataFrame([(f"p{i}", i % 5, i, "c", "d", 1, "m") for i in range(60)], f"interaction_id string, user_id long, video_id long, {ctx}")
    videos = spark.range(70).select((F.col("id") * 3).alias("id"))
    sent = sorted(map(str, S.negatives_per_positive(df, videos, 3).collect()))
    monkeypatch.setattr(S, "_SENT", 1)
    assert sorted(map(str, S.negatives_per_positive(df, videos, 3).collect())) == sent


def test_vocabularies_are_sent(spark, no_estimates):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, None)], "s string, n long")
    assert "SortMergeJoin" not in physical(E.lookup_string(df, "s", E.string_vocab(df, "s"), "i"))
    vocabs = spark.createDataFrame([("s", "a", 2), ("n", "2", 2)], "vocab string, value string, idx long")
    out = E.apply_vocabs(df, vocabs, ["s", "n"], null_index=0)
    assert "SortMergeJoin" not in physical(out)
    assert sorted((r.s_idx, r.n_idx) for r in out.collect()) == [(0, 0), (1, 2), (2, 1)]


def test_pairs_meet_videos_before_users(spark, no_estimates):
    from recframe.operators.interactions import two_tower_pairs
    pos = spark.createDataFrame([(1, 1, 5, "i", "c")], "user_id long, video_id long, ts_epoch long, interaction_id string, previously_watched_category string")
    users = spark.createDataFrame([(1, "FR", "en", 30)], "id long, country_code string, preferred_language string, age int")
    videos = spark.createDataFrame([(1, "c", "t", 60, "low", "en", "x")], "id long, category string, title string, duration int, popularity string, language string, manual_tags string")
    out = two_tower_pairs(pos.repartition("video_id"), users, videos)
    assert physical(out).count("hashpartitioning(video_id") == 2  # the positives' and the videos'; their join needs no other


def test_cuts_of_stored_rows_store_no_ties(spark):
    df = store(spark.range(400).select((F.col("id") % 9).alias("k"), F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 2).alias("g")))
    ranks = lambda sizes: sizes.select("g", F.lit("c").alias("cut"), F.floor(F.col("n") / 3).alias("rank"))
    one, two = (sorted(map(str, O.order_cuts(df, F.col("k"), ["id"], ranks, "g", stored=x).collect())) for x in (False, True))
    assert one == two and len(one) == 2
    split = lambda stored: sorted(map(str, S.stratified_split(df, "g", ["id"], stored=stored).collect()))
    assert split(True) == split(False)


def test_ranker_set_in_parts(spark, monkeypatch):
    from recframe.queries import q_models as Q
    from tests.conftest import SF
    rows = lambda: sorted(map(str, rounded(Q.ranker_set(spark, SF)).collect()))
    whole = rows()
    monkeypatch.setattr(Q, "JOINED_ROWS", 5000)
    assert rows() == whole


def test_tables_are_counted_one_by_one(spark):
    df = spark.range(10).select((F.col("id") % 4).alias("k"), F.lit("train").alias("split"))
    out = DS.catalogue_counts({"a": (df, "k"), "b": (df.limit(0), "k")}, {"s": (df, "k")})
    assert sorted(map(tuple, out.collect())) == [("a", 10, 4), ("b", 0, 0), ("s_train", 10, 4)]
    assert "Aggregate" not in physical(out)


def test_contexts_share_their_searches(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i % 5) - 2, 1.0, float(i)], "c") for i in range(12)], "id long, embedding array<double>, category string")
    c = spark.createDataFrame([(u, f"q{k}", "primary", None, k, (u + k) % 3) for u in range(20) for k in range(2)],
                              "user_id long, query_id string, query_type string, category string, query_index int, vec_id long")
    searched = []
    exact = V.vector_topk_exact
    monkeypatch.setattr(V, "vector_topk_exact", lambda q, *a, **k: searched.append(q.count()) or exact(q, *a, **k))
    got = P.search_contexts(c, items, 4)
    assert searched == [3] and got.groupBy("user_id", "query_id").count().select("count").distinct().collect()[0][0] == 4
    want = exact(c.where("user_id = 0").select("query_id", "vec_id").join(items.select(F.col("id").alias("vec_id"), "embedding"), "vec_id"), items, 4)
    assert {(r.query_id, r.video_id) for r in got.where("user_id = 0").collect()} == {(r.query_id, r.item_id) for r in want.collect()}


def test_als_drops_what_it_exchanged(spark):
    pos = spark.createDataFrame([(u, v) for u in range(30) for v in range(u % 7 + 1)], "user_id long, video_id long")
    spark.sparkContext._jvm.System.gc()
    before = shuffle_files(spark)
    M.retrieval_factors(pos, rank=4, max_iter=8)
    left = {f.split("_")[1] for f in shuffle_files(spark) - before}
    assert len(left) < 16  # two exchanges an iteration, and those of the blocks


def test_frequent_shingles_are_found_by_slots(spark):
    from recframe.llm import ngram_join as N
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(60)).encode() for i in range(1, 20)]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tokens = np.unique(N.Sets(data, offs).tokens)
    for bits in (20, 34):
        keys = np.unique(tokens[::3] >> np.uint64(63 - bits))
        s = N.Sets(data, offs, (bits, keys, N._slots(bits, keys)))
        assert sorted(s.tokens[~s.rare()]) == sorted(s.tokens[np.isin(s.tokens >> np.uint64(63 - bits), keys)])


def test_prefixes_are_gathered_before_they_are_packed(monkeypatch):
    from recframe.llm import ngram_join as N
    batch = lambda k: pa.RecordBatch.from_arrays([pa.array([bytes(8 * k)] * k), pa.array(range(k))], ["prefix", "grp"])
    sizes = [3, 4, 0, 5, 11, 2]
    assert [len(b) for b in N._gathered(iter(map(batch, sizes)))] == [25]
    monkeypatch.setattr(N, "ENTRY_GROUPS", 8)
    got = list(N._gathered(iter(map(batch, sizes))))
    assert [len(b) for b in got] == [7, 5, 8, 5]
    assert [x for b in got for x in b.column("grp").to_pylist()] == [x for k in sizes for x in range(k)]
    monkeypatch.setattr(N, "ENTRY_BYTES", 1)
    assert [len(b) for b in N._gathered(iter(map(batch, sizes)))][:2] == [3, 4] and not list(N._gathered(iter([batch(0)])))
