"""Queries: labels, attribution, merges, rollups, splits and sampling."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recframe.operators import feedback as FB
from recframe.operators import interactions as I
from recframe.operators import sampling as S
from recframe.queries.common import query, rounded
from recframe.queries.q_encoders import pairs
from recframe.queries.q_labels import enriched
from recframe.session import store
from recframe.sources import adapters as A
from recframe.sources import io as IO
from recframe.sources.published import PublishedTable


def labels(spark, d):
    return FB.make_labels(A.feedback(spark, d))


def merged(spark, d):
    return FB.merge_predictions_labels(A.predictions(spark, d), labels(spark, d))


@query("p06_label_rules")
def p06(spark, d):
    return labels(spark, d).select("interaction_id", "label")


@query("p07_label_event")
def p07(spark, d):
    return FB.label_event(A.feedback(spark, d)).select("feedback_id", "label")


@query("p08_validate_event")
def p08(spark, d):
    ok, bad = FB.validate_event(A.feedback(spark, d), zero_is_missing=True)
    return ok.select(F.lit("passed").alias("status"), "feedback_id").unionByName(
        bad.select(F.lit("failed").alias("status"), "feedback_id")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


@query("p09_label_filter")
def p09(spark, d):
    return FB.label_filter(labels(spark, d), include_negative=False, min_confidence=0.5).select("interaction_id")


@query("j10_labels_with_prediction")
def j10(spark, d):
    j = FB.labels_with_prediction(labels(spark, d), A.predictions(spark, d))
    return rounded(j.select("interaction_id", "inference_timestamp", "predicted_score", "model_version", "experiment_id"))


@query("w02_latest_label")
def w02(spark, d):
    return FB.latest_label(labels(spark, d)).select("inference_id", "video_id", "interaction_id", "label")


@query("j06_merge_predictions_labels")
def j06(spark, d):
    return rounded(merged(spark, d))


@query("a16_merge_stats")
def a16(spark, d):
    return rounded(FB.merge_stats(merged(spark, d), labels(spark, d)))


@query("j07_merge_windowed")
def j07(spark, d):
    return rounded(FB.merge_windowed(A.predictions(spark, d), labels(spark, d), 12))


@query("j08_merge_sql")
def j08(spark, d):
    return rounded(FB.merge_sql(spark, A.predictions(spark, d), labels(spark, d), 12))


@query("p18_ttl_filter")
def p18(spark, d):
    return FB.ttl_filter(A.predictions(spark, d), dt.datetime(2024, 1, 20)).select("inference_id")


@query("w05_user_predictions")
def w05(spark, d):
    return FB.user_predictions(A.predictions(spark, d), dt.datetime(2024, 1, 20), 3).select("user_id", "inference_id")


@query("j09_attribute_feedback")
def j09(spark, d):
    return FB.attribute_feedback(A.feedback(spark, d), A.predictions(spark, d), dt.datetime(2024, 1, 10)).select(
        "feedback_id", "attributed_inference_id")


@query("a14_feedback_rollup")
def a14(spark, d):
    return rounded(FB.feedback_rollup(A.feedback(spark, d)))


@query("a15_collection_stats")
def a15(spark, d):
    return FB.collection_stats(A.feedback(spark, d), labels(spark, d))


@query("a17_retrain_summary")
def a17(spark, d):
    return FB.retrain_summary(merged(spark, d))


@query("a47_label_weighted_confidence")
def a47(spark, d):
    return rounded(FB.label_confidence_by_source(labels(spark, d)))


@query("p10_flatten_features")
def p10(spark, d):
    m = merged(spark, d).select("inference_id", "video_id", "user_id")
    u = A.users(spark, d)
    j = m.join(u, m.user_id == u.id, "left").select(
        "inference_id", "video_id",
        F.create_map(F.lit("country"), F.col("country_code"), F.lit("language"), F.col("preferred_language"),
                     F.lit("age"), F.col("age").cast("string")).alias("user_features"),
        F.create_map(F.lit("device"), F.lit("Mobile"), F.lit("hour"), F.lit("12")).alias("context_features"))
    return FB.flatten_features(j, {"user_features": "user", "context_features": "context"})


@query("x01_random_split")
def x01(spark, d):
    return S.random_split(labels(spark, d), ["interaction_id"]).select("interaction_id", "split")


@query("w13_time_split")
def w13(spark, d):
    return S.time_split(labels(spark, d), "feedback_timestamp", ["interaction_id"]).select("interaction_id", "split")


@query("x02_stratified_split")
def x02(spark, d):
    return S.stratified_split(labels(spark, d), "label", ["interaction_id"]).select("interaction_id", "label", "split")


@query("x03_two_stage_split")
def x03(spark, d):
    return S.stratified_split(pairs(spark, d), "popularity", ["user_id", "video_id"], 0.7, 0.15, 0.15).select(
        "user_id", "video_id", "split")


@query("x04_bernoulli_split")
def x04(spark, d):
    return S.bernoulli_split(pairs(spark, d), ["user_id", "video_id"]).select("user_id", "video_id", "split")


@query("x05_balance_labels")
def x05(spark, d):
    return S.balance_labels(labels(spark, d), ["interaction_id"], 1.0).select("interaction_id", "label")


def _retraining(spark, d):
    m = merged(spark, d).withColumn("record_id", F.concat_ws(":", "inference_id", F.col("video_id").cast("string")))
    table = PublishedTable(spark, IO.scratch_dir(spark, "x06"))
    return table, S.retraining_dataset(m, table, "record_id")


@query("x06_retraining_dataset")
def x06(spark, d):
    return _retraining(spark, d)[0].read().select("record_id", "label", "split")


@query("x06_retraining_summary")
def x06_summary(spark, d):
    return _retraining(spark, d)[1].select("total_samples", "positive_samples", "negative_samples", "unique_users", "unique_videos",
                                           "train_samples", "val_samples", "test_samples")


@query("x07_merge_gate")
def x07(spark, d):
    return S.merge_gate(merged(spark, d).select("inference_id", "video_id", "label"), labels(spark, d), min_labels=100)


def _positives(spark, d):
    return I.positives(enriched(spark, d))


@query("j18_negatives_per_positive")
def j18(spark, d):
    return S.negatives_per_positive(_positives(spark, d), A.videos(spark, d), ratio=3)


@query("j19_negatives_global")
def j19(spark, d):
    pos = _positives(spark, d)
    return S.negatives_global(A.interactions(spark, d), A.users(spark, d), A.videos(spark, d),
                              pos.count())


@query("j20_ranker_dataset")
def j20(spark, d):
    from recframe.operators.features import ranker_star_join
    pos = store(_positives(spark, d), "positives")  # the samples and their negatives
    neg = S.negatives_per_positive(pos, A.videos(spark, d), ratio=3, stored=True)
    u = S.union_samples(pos.withColumn("label", F.lit(1)).drop("is_positive"),
                        neg.withColumn("label", F.lit(0)).drop("is_positive"))
    return ranker_star_join(u, A.users(spark, d), A.videos(spark, d), A.channels(spark, d), users_first=True)


@query("u01_union_samples")
def u01(spark, d):
    e = enriched(spark, d)
    pos = I.positives(e).select("interaction_id", "user_id", "video_id", "device", F.lit(1).alias("label"))
    neg = I.negatives(e).select("interaction_id", "user_id", F.lit(0).alias("label"))
    return S.union_samples(pos, neg)


@query("u02_candidate_difference")
def u02(spark, d):
    return S.candidate_difference(A.videos(spark, d).select(F.col("id").alias("video_id")), A.interactions(spark, d))


@query("u03_shared_vocab_union")
def u03(spark, d):
    return (A.users(spark, d).select(F.col("preferred_language").alias("language"))
            .union(A.videos(spark, d).select("language")).distinct())


@query("u04_distinct_pairs")
def u04(spark, d):
    i = A.interactions(spark, d).select("user_id", "video_id", "ts_epoch", "interaction_id", "interaction_type")
    return S.distinct_pairs(i, ["user_id", "video_id"], ["ts_epoch", "interaction_id"])


@query("u05_category_universe")
def u05(spark, d):
    f = A.feature_records(spark, d)
    base = f.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 16))).groupBy("category").agg(F.count(F.lit(1)).alias("b"))
    cur = f.where(F.col("ts") >= F.lit(dt.datetime(2024, 1, 16))).groupBy("category").agg(F.count(F.lit(1)).alias("c"))
    return base.join(cur, "category", "full_outer").select("category", F.coalesce("b", F.lit(0)).alias("base_count"),
                                                          F.coalesce("c", F.lit(0)).alias("current_count"))
