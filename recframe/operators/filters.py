"""Candidate filtering.

The rule chain of P12 is one ``CASE`` expression evaluated in rule order; the
first failing rule names the reason and ``reason IS NULL`` means the candidate
passed.  Exclusions and per-user preferences are joins, never driver-side sets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe import constants as C


@dataclass
class FilterConfig:
    blocked_categories: list[str] = field(default_factory=list)
    enable_duration_filter: bool = True
    min_duration_seconds: int = 0
    max_duration_seconds: int = 7200
    filter_old_videos: bool = False
    max_video_age_days: int = 365
    filter_nsfw: bool = True
    filter_low_quality: bool = True
    min_quality_score: float = 0.3
    min_views: int = 0
    min_likes: int = 0
    blocked_channel_ids: list[int] = field(default_factory=list)
    # Ordered (reason, predicate) pairs; predicate true = filter out.
    custom_filters: list[tuple[str, Column]] = field(default_factory=list)


def business_rules(videos: DataFrame, blocked_categories=(), filters: dict | None = None,
                   now=None, max_video_age_days: int = 365) -> DataFrame:
    """Keep active, young enough, not blocked, and equal to the optional
    category / language filters and inside min / max duration."""
    cond = F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in videos.columns else F.lit(True)
    if now is not None and "upload_date" in videos.columns and max_video_age_days > 0:
        age_ok = F.col("upload_date").isNull() | (
            F.col("upload_date") >= F.lit(now) - F.expr(f"INTERVAL {int(max_video_age_days)} DAYS"))
        cond = cond & age_ok
    if blocked_categories:
        cond = cond & ~F.coalesce(F.col("category"), F.lit("")).isin(*blocked_categories)
    f = filters or {}
    if "category" in f:
        cond = cond & (F.col("category") == f["category"])
    if "language" in f:
        cond = cond & (F.col("language") == f["language"])
    if "min_duration" in f:
        cond = cond & (F.coalesce(F.col("duration"), F.lit(0)) >= f["min_duration"])
    if "max_duration" in f:
        cond = cond & (F.col("duration").isNull() | (F.col("duration") <= f["max_duration"]))
    return videos.where(cond)


def with_preferences(cands: DataFrame, prefs: DataFrame | None, cfg: FilterConfig) -> DataFrame:
    """Per-user min / max duration and blocked categories, falling back
    to the configured defaults."""
    default_blocked = F.array(*[F.lit(c) for c in cfg.blocked_categories]).cast("array<string>")
    if prefs is None:
        return cands.select("*", F.lit(cfg.min_duration_seconds).alias("_min_dur"),
                            F.lit(cfg.max_duration_seconds).alias("_max_dur"),
                            default_blocked.alias("_blocked"))
    p = prefs.select(F.col("user_id").alias("_p_uid"), F.col("min_duration").alias("_p_min"),
                     F.col("max_duration").alias("_p_max"), F.col("blocked_categories").alias("_p_blk"))
    j = cands.join(p, cands.user_id == p._p_uid, "left")
    return j.select(*cands.columns,
                    F.coalesce("_p_min", F.lit(cfg.min_duration_seconds)).alias("_min_dur"),
                    F.coalesce("_p_max", F.lit(cfg.max_duration_seconds)).alias("_max_dur"),
                    F.coalesce("_p_blk", default_blocked).alias("_blocked"))


def filter_reason(cands: DataFrame, cfg: FilterConfig, exclusions: DataFrame | None = None,
                  prefs: DataFrame | None = None, now=None) -> DataFrame:
    """Add ``reason`` (NULL = passed) to each candidate row.

    ``cands`` holds user_id, video_id and the metadata columns category,
    video_duration, view_count, like_count, channel_id and optionally
    is_nsfw, quality_score, upload_date.  ``exclusions`` is (user_id, video_id).
    """
    df = cands
    if exclusions is not None:
        ex = (exclusions.select(F.col("user_id").alias("_x_uid"), F.col("video_id").alias("_x_vid"))
              .distinct().withColumn("_excluded", F.lit(True)))
        df = (df.join(ex, (df.user_id == ex._x_uid) & (df.video_id == ex._x_vid), "left")
              .drop("_x_uid", "_x_vid"))
    else:
        df = df.withColumn("_excluded", F.lit(None).cast("boolean"))
    df = with_preferences(df, prefs, cfg)
    cols = set(df.columns)
    cat = F.coalesce(F.col("category"), F.lit(""))
    dur = F.coalesce(F.col("video_duration"), F.lit(0))
    chain = F.when(F.col("_excluded"), F.lit("exclusion: recently watched or blocked"))
    chain = chain.when(F.array_contains("_blocked", cat), F.concat(F.lit("category: blocked ("), cat, F.lit(")")))
    if cfg.enable_duration_filter:
        chain = (chain.when((dur > 0) & (dur < F.col("_min_dur")),
                            F.concat(F.lit("duration: too short ("), dur.cast("string"), F.lit("s)")))
                 .when((dur > 0) & (dur > F.col("_max_dur")),
                       F.concat(F.lit("duration: too long ("), dur.cast("string"), F.lit("s)"))))
    if cfg.filter_old_videos and now is not None and "upload_date" in cols:
        age = F.floor((F.unix_micros(F.lit(now).cast("timestamp"))
                       - F.unix_micros(F.col("upload_date").cast("timestamp"))) / 86_400_000_000)
        chain = chain.when(F.col("upload_date").isNotNull() & (age > cfg.max_video_age_days),
                           F.concat(F.lit("age: too old ("), age.cast("string"), F.lit(" days)")))
    if cfg.filter_nsfw and "is_nsfw" in cols:
        chain = chain.when(F.coalesce(F.col("is_nsfw"), F.lit(False)), F.lit("content: NSFW flagged"))
    if cfg.filter_low_quality and "quality_score" in cols:
        q = F.coalesce(F.col("quality_score"), F.lit(1.0))
        chain = chain.when(q < cfg.min_quality_score,
                           F.concat(F.lit("quality: low score ("), F.format_string("%.2f", q), F.lit(")")))
    if cfg.min_views > 0:
        v = F.coalesce(F.col("view_count"), F.lit(0))
        chain = chain.when(v < cfg.min_views, F.concat(F.lit("engagement: low views ("), v.cast("string"), F.lit(")")))
    if cfg.min_likes > 0:
        lk = F.coalesce(F.col("like_count"), F.lit(0))
        chain = chain.when(lk < cfg.min_likes, F.concat(F.lit("engagement: low likes ("), lk.cast("string"), F.lit(")")))
    if cfg.blocked_channel_ids:
        ch = F.col("channel_id")
        chain = chain.when(ch.isNotNull() & (ch != 0) & ch.isin(*cfg.blocked_channel_ids),
                           F.concat(F.lit("channel: blocked ("), ch.cast("string"), F.lit(")")))
    for reason, pred in cfg.custom_filters:
        chain = chain.when(pred, F.lit(f"custom: {reason}"))
    return df.withColumn("reason", chain).drop("_excluded", "_min_dur", "_max_dur", "_blocked")


def duration_preference(df: DataFrame, pref, duration_col: str = "video_duration") -> DataFrame:
    """Short 0–300, medium 300–1200, long ≥ 1200, any; both ends
    inclusive; an unknown preference means any.  ``pref`` is a literal or a
    column (per-user preference)."""
    p = F.lit(pref) if isinstance(pref, str) else pref
    d = F.coalesce(F.col(duration_col), F.lit(0))
    lo = (F.when(p == "short", 0).when(p == "medium", 300).when(p == "long", 1200).otherwise(0))
    hi = F.when(p == "short", 300).when(p == "medium", 1200)
    return df.where((d >= lo) & (hi.isNull() | (d <= hi)))


def exclusion_filter(cands: DataFrame, excluded: DataFrame, keys=("user_id", "video_id"),
                     blocked: DataFrame | None = None) -> DataFrame:
    """Drop per-user excluded pairs and globally blocked ids (anti joins)."""
    out = cands.join(excluded.select(*keys).distinct(), list(keys), "left_anti")
    if blocked is not None:
        out = out.join(blocked.select("video_id").distinct(), "video_id", "left_anti")
    return out


def watched_exclusion(interactions: DataFrame, now, days: int = 30,
                      watch_types=("watch",), ts_col: str = "ts") -> DataFrame:
    """(user_id, video_id) watched in the last ``days`` days before ``now``."""
    lo = F.lit(now) - F.expr(f"INTERVAL {int(days)} DAYS")
    return (interactions.where(F.col("interaction_type").isin(*watch_types)
                               & (F.col(ts_col) >= lo) & (F.col(ts_col) <= F.lit(now)))
            .select("user_id", "video_id").distinct())


def filter_stats(filtered: DataFrame, request_col: str | None = None) -> DataFrame:
    """Input / passed / filtered totals, pass rate and counts by reason
    prefix, as (metric, value) rows."""
    prefix = F.split(F.col("reason"), ":").getItem(0)
    totals = filtered.agg(F.count(F.lit(1)).alias("total_input"),
                          F.count(F.when(F.col("reason").isNull(), 1)).alias("total_passed"),
                          F.count("reason").alias("total_filtered"))
    long = totals.select(F.explode(F.array(
        F.struct(F.lit("total_input").alias("metric"), F.col("total_input").cast("double").alias("value")),
        F.struct(F.lit("total_passed").alias("metric"), F.col("total_passed").cast("double").alias("value")),
        F.struct(F.lit("total_filtered").alias("metric"), F.col("total_filtered").cast("double").alias("value")),
        F.struct(F.lit("pass_rate").alias("metric"),
                 F.when(F.col("total_input") > 0, F.col("total_passed") / F.col("total_input"))
                 .otherwise(F.lit(0.0)).alias("value")))).alias("m")).select("m.*")
    by = (filtered.where(F.col("reason").isNotNull()).groupBy(prefix.alias("p"))
          .agg(F.count(F.lit(1)).cast("double").alias("value"))
          .select(F.concat(F.lit("filtered:"), F.col("p")).alias("metric"), "value"))
    return long.unionByName(by)
