"""Interaction enrichment and training pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recframe import constants as C
from recframe.functions import labels as L


def first_by(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One row per key: the row with the smallest ``order`` tuple.

    ``min(struct(order…, payload…))`` aggregates partially on the map side, so
    a hot key is reduced before the shuffle instead of being sorted in one task.
    """
    packed = F.min(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
                            *[F.col(c) for c in payload])).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in payload])


def prev_category(inter: DataFrame, videos: DataFrame) -> DataFrame:
    """Category of ``previously_watched_video``; "-" if null or unknown."""
    v = videos.select(F.col("id").alias("_pv_id"), F.col("category").alias("_pv_cat"))
    return (inter.join(v, inter.previously_watched_video == v._pv_id, "left")
            .withColumn("previously_watched_category", F.coalesce("_pv_cat", F.lit("-")))
            .drop("_pv_id", "_pv_cat"))


def enrich_interactions(inter: DataFrame, videos: DataFrame) -> DataFrame:
    """Previous category, day / hour, watch ratio and the P03 label."""
    dur = videos.select(F.col("id").alias("_d_id"), F.col("duration").alias("_d_dur"))
    j = prev_category(inter, videos)
    j = j.join(dur, j.video_id == dur._d_id, "left")
    ts = L.event_time(F.col("ts_epoch"))
    ratio = L.watch_ratio("interaction_type", "interaction_value",
                          F.coalesce(F.col("_d_dur"), F.lit(C.DEFAULT_VIDEO_DURATION)))
    return (j.withColumn("interaction_time_day", L.day_name_upper(ts))
            .withColumn("interaction_time_hour", F.hour(ts))
            .withColumn("watch_ratio", ratio)
            .withColumn("is_positive", L.is_positive("interaction_type", "watch_ratio"))
            .drop("_d_id", "_d_dur"))


def positives(enriched: DataFrame) -> DataFrame:
    """Rows labelled positive by P03."""
    return enriched.where("is_positive")


def negatives(enriched: DataFrame) -> DataFrame:
    """The complement of ``positives``."""
    return enriched.where("NOT is_positive")


def two_tower_pairs(pos: DataFrame, users: DataFrame, videos: DataFrame) -> DataFrame:
    """Positives ⟕ users ⟕ videos → the 12 pair columns, one row per
    (user, video): the earliest interaction wins (T19)."""
    first = first_by(pos, ["user_id", "video_id"], ["ts_epoch", "interaction_id"],
                     ["previously_watched_category"])
    u = users.select(F.col("id").alias("user_id"), F.col("country_code").alias("country"),
                     F.col("preferred_language").alias("user_language"), "age")
    v = videos.select(F.col("id").alias("video_id"), "category", "title",
                      F.col("duration").alias("video_duration"), "popularity",
                      F.col("language").alias("video_language"), F.col("manual_tags").alias("tags"))
    # enriched rows lie by video already: videos first, and only one exchange, by user
    return (first.join(v, "video_id", "left").join(u, "user_id", "left")
            .select("user_id", "country", "user_language", "age", "previously_watched_category",
                    "video_id", "category", "title", "video_duration", "popularity",
                    "video_language", "tags"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives, negatives and total of a labelled set."""
    lab = F.col(label).cast("int")
    return df.agg(F.count(F.when(lab == 1, 1)).alias("positive"),
                  F.count(F.when(lab == 0, 1)).alias("negative"),
                  F.count(F.lit(1)).alias("total"))
