"""Queries: candidate filtering family."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recframe.operators import filters as FL
from recframe.queries.common import query, rounded
from recframe.sources import adapters as A

NOW = dt.datetime(2024, 1, 31)


def candidates(spark, d):
    """Exploded predictions (one row per recommended video) with metadata."""
    p = A.predictions(spark, d)
    c = p.select("inference_id", "user_id", "video_scores",
                 F.explode("recommended_video_ids").alias("video_id"))
    c = c.select("inference_id", "user_id", "video_id",
                 F.element_at("video_scores", F.col("video_id")).alias("score"))
    v = A.videos(spark, d).select(F.col("id").alias("video_id"), "category", "title",
                                  F.col("duration").alias("video_duration"), "view_count",
                                  "like_count", "channel_id", "language")
    return (c.join(v, "video_id", "left")
            .withColumn("is_nsfw", F.col("video_id") % 50 == 0)
            .withColumn("quality_score", (F.col("view_count") % 100) / 100.0))


def user_prefs(spark, d):
    u = A.users(spark, d)
    return u.select(F.col("id").alias("user_id"),
                    F.when(F.col("id") % 3 == 0, F.lit(600)).alias("min_duration"),
                    F.when(F.col("id") % 3 == 1, F.lit(1800)).alias("max_duration"),
                    F.when(F.col("id") % 5 == 0, F.array(F.lit("ECONOMY"))).alias("blocked_categories"))


def completes(spark, d):
    o = A.online_interactions(spark, d)
    return o.where(F.col("interaction_type") == "complete").select("user_id", "video_id")


CFG = FL.FilterConfig(blocked_categories=["PROMO"], min_views=1000, blocked_channel_ids=[1, 2, 3])


@query("p11_business_rules")
def p11(spark, d):
    v = A.videos(spark, d).withColumn("is_active", F.col("id") % 7 != 0)
    return FL.business_rules(v, ["PROMO"], {"language": "FURNITURE", "min_duration": 600,
                                            "max_duration": 2400}).select("id")


@query("p12_filter_reason")
def p12(spark, d):
    return FL.filter_reason(candidates(spark, d), CFG, exclusions=completes(spark, d)).select(
        "inference_id", "video_id", "reason")


@query("p13_filter_prefs")
def p13(spark, d):
    return FL.filter_reason(candidates(spark, d), CFG, exclusions=completes(spark, d),
                            prefs=user_prefs(spark, d)).select("inference_id", "video_id", "reason")


@query("p14_duration_preference")
def p14(spark, d):
    c = candidates(spark, d)
    pref = (F.when(F.col("user_id") % 4 == 0, "short").when(F.col("user_id") % 4 == 1, "medium")
            .when(F.col("user_id") % 4 == 2, "long").otherwise("any"))
    return FL.duration_preference(c, pref).select("inference_id", "video_id")


@query("p15_custom_filters")
def p15(spark, d):
    cfg = FL.FilterConfig(filter_nsfw=False, filter_low_quality=False, custom_filters=[
        ("ring in title", F.col("title").contains("ring")),
        ("odd channel", F.col("channel_id") % 2 == 1)])
    return FL.filter_reason(candidates(spark, d), cfg).select("inference_id", "video_id", "reason")


@query("p16_exclusion_filter")
def p16(spark, d):
    blocked = A.videos(spark, d).where(F.col("id") % 10 == 0).select(F.col("id").alias("video_id"))
    return FL.exclusion_filter(candidates(spark, d), completes(spark, d), blocked=blocked).select(
        "inference_id", "video_id")


@query("j21_watched_exclusion")
def j21(spark, d):
    return FL.watched_exclusion(A.feedback(spark, d), NOW, days=7)


@query("a21_filter_stats")
def a21(spark, d):
    f = FL.filter_reason(candidates(spark, d), CFG, exclusions=completes(spark, d),
                         prefs=user_prefs(spark, d))
    return rounded(FL.filter_stats(f))


@query("p25_popularity_tier")
def p25(spark, d):
    v = A.videos(spark, d)
    return v.select("id", "view_count", A.popularity_tier(F.col("view_count")).alias("popularity"))


@query("p26_channel_tier")
def p26(spark, d):
    from recframe.functions.scalar import channel_tier
    c = A.channels(spark, d)
    return c.select("id", "subscriber_count", channel_tier(F.col("subscriber_count")).alias("tier"))
