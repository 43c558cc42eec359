"""Queries: A/B assignment and analysis, exploration sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from recframe.operators import experiments as X
from recframe.operators import ranking as R
from recframe.queries.common import query, rounded
from recframe.queries.q_ranking import scored
from recframe.sources import adapters as A

VARIANTS = [X.Variant("control", "v1", 0.5), X.Variant("treatment", "v2", 0.5)]


@query("f01_ab_assign")
def f01(spark, d):
    return rounded(X.ab_assign(A.users(spark, d), "exp_1", VARIANTS))


@query("a09_variant_metrics")
def a09(spark, d):
    return rounded(X.variant_metrics(A.online_interactions(spark, d), "exp_1", VARIANTS))


@query("a10_two_proportion_test")
def a10(spark, d):
    vm = X.variant_metrics(A.online_interactions(spark, d), "exp_1", VARIANTS)
    return rounded(X.two_proportion_test(vm, "control", "treatment"))


@query("a11_experiment_report")
def a11(spark, d):
    return rounded(X.experiment_report(A.online_interactions(spark, d), "exp_1", VARIANTS))


@query("a11_experiment_report_no_data")
def a11_no_data(spark, d):
    """An experiment that none of the interactions belongs to."""
    return rounded(X.experiment_report(A.online_interactions(spark, d), "exp_0", VARIANTS))


def _ranked(spark, d):
    s = scored(spark, d, by="user").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("request_id"),
                                           F.col("item_id").alias("video_id"), F.col("score").alias("ranker_score"))
    return R.rank_topk(s, None, "request_id", "ranker_score", "video_id", "rank")


def _shown_feedback(spark, d):
    shown = X.inject_exploration(_ranked(spark, d))
    o = A.online_interactions(spark, d).withColumn("request_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return X.sample_feedback(shown, o)


@query("w12_inject_exploration")
def w12(spark, d):
    return X.inject_exploration(_ranked(spark, d))


@query("j23_sample_feedback")
def j23(spark, d):
    return rounded(_shown_feedback(spark, d))


@query("a12_sampled_quality")
def a12(spark, d):
    fb = _shown_feedback(spark, d)
    top = fb.where(~F.col("is_sample"))
    tk = top.select(F.count(F.when(F.col("was_clicked"), 1)) / F.count(F.lit(1))).scalar()
    return rounded(X.sampled_quality(fb, tk))


@query("a13_rank_tier_metrics")
def a13(spark, d):
    fb = _shown_feedback(spark, d)
    sc = _ranked(spark, d).select("request_id", "video_id", "ranker_score")
    return rounded(X.rank_tier_metrics(fb.join(sc, ["request_id", "video_id"], "left")))
