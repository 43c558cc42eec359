"""Queries: labelling, enrichment and training pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from recframe.functions import labels as L
from recframe.operators import interactions as I
from recframe.queries.common import query, rounded
from recframe.sources import adapters as A


def enriched(spark, d):
    return I.enrich_interactions(A.interactions(spark, d), A.videos(spark, d))


@query("p02_watch_ratio")
def p02(spark, d):
    return rounded(enriched(spark, d).select("interaction_id", "watch_ratio"))


@query("p03_is_positive")
def p03(spark, d):
    return enriched(spark, d).select("interaction_id", "interaction_type", "is_positive")


@query("p04_positives")
def p04p(spark, d):
    return I.positives(enriched(spark, d)).select("interaction_id", "user_id", "video_id")


@query("p04_negatives")
def p04n(spark, d):
    return I.negatives(enriched(spark, d)).select("interaction_id", "user_id", "video_id")


@query("p05_is_positive_simple")
def p05(spark, d):
    i = A.interactions(spark, d)
    return i.select("interaction_id", L.is_positive_simple("interaction_type").alias("is_positive"))


@query("f06_time_features")
def f06(spark, d):
    i = A.interactions(spark, d)
    ts = L.event_time(F.col("ts_epoch"))
    return i.select("interaction_id", L.day_name_upper(ts).alias("interaction_time_day"),
                    F.hour(ts).alias("interaction_time_hour"))


@query("j01_prev_category")
def j01(spark, d):
    return I.prev_category(A.interactions(spark, d), A.videos(spark, d)).select(
        "interaction_id", "previously_watched_category")


@query("j02_enrich_interactions")
def j02(spark, d):
    return rounded(enriched(spark, d))


@query("j04_two_tower_pairs")
def j04(spark, d):
    return I.two_tower_pairs(I.positives(enriched(spark, d)), A.users(spark, d), A.videos(spark, d))


@query("a22_label_distribution")
def a22(spark, d):
    return I.label_distribution(enriched(spark, d), "is_positive")
