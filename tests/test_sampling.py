"""Invariants for the rows-only samplers and the splits (on sf0.001 data)."""

from pyspark.sql import functions as F

from recframe.operators import interactions as I
from recframe.operators import sampling as S
from recframe.sources import adapters as A
from tests.conftest import SF


def _pos(spark):
    e = I.enrich_interactions(A.interactions(spark, SF), A.videos(spark, SF))
    return I.positives(e)


def test_negatives_per_positive_invariants(spark):
    pos = _pos(spark)
    neg = S.negatives_per_positive(pos, A.videos(spark, SF), ratio=3)
    # never a positive pair of the same user
    clash = neg.join(pos.select("user_id", "video_id").distinct(), ["user_id", "video_id"])
    assert clash.count() == 0
    # exactly min(ratio, pool) per positive (pool is large here) and no repeats
    per = neg.groupBy("source_interaction_id").agg(F.count("*").alias("n"),
                                                    F.count_distinct("video_id").alias("d"))
    assert per.where("n != 3 OR d != 3").count() == 0
    assert per.count() == pos.select("interaction_id").distinct().count()
    # deterministic under a different partitioning
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    again = S.negatives_per_positive(pos, A.videos(spark, SF), ratio=3)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again.exceptAll(neg).count() == 0


def test_negatives_global_invariants(spark):
    inter = A.interactions(spark, SF)
    neg = S.negatives_global(inter, A.users(spark, SF), A.videos(spark, SF), 500)
    assert neg.count() == 500
    assert neg.select("user_id", "video_id").distinct().count() == 500
    assert neg.join(inter.select("user_id", "video_id"), ["user_id", "video_id"]).count() == 0


def test_split_sizes(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("label"))
    sizes = {r.split: r["count"] for r in S.random_split(df, ["k"]).groupBy("split").count().collect()}
    assert sizes == {"train": 80, "val": 10, "test": 10}
    strat = S.stratified_split(df, "label", ["k"]).groupBy("split", "label").count().collect()
    assert all(r["count"] > 0 for r in strat) and len(strat) == 6


def test_balance(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).alias("label"))
    b = S.balance_labels(df, ["k"], 1.0)
    got = {r.label: r["count"] for r in b.groupBy("label").count().collect()}
    assert got == {0: 10, 1: 10}
    skew = spark.range(30).select(F.col("id").cast("string").alias("k"),
                                  F.when(F.col("id") < 10, 1).otherwise(0).alias("label"))
    got = {r.label: r["count"] for r in S.balance_labels(skew, ["k"], 1.0).groupBy("label").count().collect()}
    assert got == {0: 10, 1: 10}


def test_global_negatives_fill_a_dense_target(spark):
    from recframe.operators.sampling import negatives_global
    users = spark.createDataFrame([(i,) for i in range(8)], "id long")
    videos = spark.createDataFrame([(i,) for i in range(6)], "id long")
    inter = spark.createDataFrame([(i, i % 6) for i in range(8)], "user_id long, video_id long")
    got = negatives_global(inter, users, videos, 40)
    assert got.select("user_id", "video_id").distinct().count() == 40
    assert got.join(inter, ["user_id", "video_id"]).count() == 0
    try:
        negatives_global(inter, users, videos, 41)
        raise AssertionError("a pool that is too small must raise")
    except ValueError:
        pass
