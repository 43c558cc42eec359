"""Queries: ranking maths and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from recframe.operators import ranking as R
from recframe.queries.common import query, rounded
from recframe.sources import adapters as A

POS = ["click", "like", "complete"]


def scored(spark, d, by: str = "request_id"):
    """One row per (list, video): score = max watch time / 500, binary label,
    graded gain = number of positive events."""
    o = A.online_interactions(spark, d)
    is_pos = F.col("interaction_type").isin(*POS)
    keys = ["request_id", "user_id"] if by == "request_id" else ["user_id"]
    return (o.groupBy(*keys, "video_id")
            .agg((F.max("watch_time_seconds") / 500.0).alias("score"),
                 F.max(F.when(is_pos, 1.0).otherwise(0.0)).alias("label"),
                 F.count(F.when(is_pos, 1)).cast("double").alias("gain"))
            .withColumnRenamed("video_id", "item_id")
            .withColumnRenamed(keys[0], "query_id" if by == "request_id" else "user_id"))


@query("w01_rank_topk")
def w01(spark, d):
    return R.rank_topk(scored(spark, d), 5).select("query_id", "item_id", "rank")


@query("a27_precision_at_k")
def a27(spark, d):
    return rounded(R.precision_at_k(scored(spark, d), 5))


@query("a28_mrr")
def a28(spark, d):
    return rounded(R.mrr(scored(spark, d)))


@query("a29_ndcg_at_k")
def a29(spark, d):
    return rounded(R.ndcg_at_k(scored(spark, d), 5, label="gain"))


@query("a30_map_at_k")
def a30(spark, d):
    return rounded(R.map_at_k(scored(spark, d), 5))


@query("w09_running_precision")
def w09(spark, d):
    return rounded(R.running_precision(scored(spark, d), None)
                   .select("query_id", "item_id", "rank", "running_precision"))


@query("a33_weighted_metrics")
def a33(spark, d):
    s = scored(spark, d)
    p = R.precision_at_k(s, 5)
    w = s.groupBy("query_id").agg((F.lit(1.0) + F.first("user_id") % 3).alias("w"))
    return rounded(R.weighted_mean(p.join(w, "query_id"), "precision", "w"))


@query("a32_per_user_ranking_eval")
def a32(spark, d):
    return rounded(R.per_user_eval(scored(spark, d, by="user"), group="user_id"))


@query("a25_accuracy")
def a25(spark, d):
    return rounded(R.accuracy(scored(spark, d)))


@query("a26_auc")
def a26(spark, d):
    return rounded(R.auc(scored(spark, d)))


@query("w10_quantile_bins")
def w10(spark, d):
    return R.quantile_bins(scored(spark, d), "score", 10).select("query_id", "item_id", "bin")


@query("a24_lift_table")
def a24(spark, d):
    return rounded(R.lift_table(scored(spark, d), "score", "label", 10))


@query("m04_ranker_eval")
def m04(spark, d):
    return rounded(R.ranking_summary(scored(spark, d), 10))
