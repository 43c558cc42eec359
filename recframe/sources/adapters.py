"""Entity views over the driver tables.

The operators take canonical entity columns (users, channels, videos,
interactions, online interactions, predictions, feedback).  These functions
derive those entities from the TPC-H-like tables with plain projections and
joins, so every operator's work grows with the input tables.  The same rules
are written as DuckDB SQL for the oracle (``recframe.queries.oracle``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe.sources.tables import load_table


def _day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def users(spark: SparkSession, d: str) -> DataFrame:
    c = load_table(spark, d, "customer")
    n = load_table(spark, d, "nation")  # fixed 25-row dimension
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("id"),
                    F.col("n_name").alias("country_code"),
                    F.col("c_mktsegment").alias("preferred_language"),
                    (F.lit(13) + F.col("c_custkey") % 68).cast("int").alias("age")))


def channels(spark: SparkSession, d: str) -> DataFrame:
    s = load_table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("id"),
                    F.floor(F.abs("s_acctbal") * 100).cast("bigint").alias("subscriber_count"))


def popularity_tier(views: Column) -> Column:
    """P25: >1e6 viral, >1e5 high, >1e4 medium, else low."""
    return (F.when(views > 1_000_000, "viral").when(views > 100_000, "high")
            .when(views > 10_000, "medium").otherwise("low"))


def videos(spark: SparkSession, d: str) -> DataFrame:
    p = load_table(spark, d, "part")
    n_channels = load_table(spark, d, "supplier").select(F.count(F.lit(1))).scalar()
    lang = (F.when(F.col("p_partkey") % 5 == 0, "AUTOMOBILE")
            .when(F.col("p_partkey") % 5 == 1, "BUILDING")
            .when(F.col("p_partkey") % 5 == 2, "FURNITURE")
            .when(F.col("p_partkey") % 5 == 3, "HOUSEHOLD").otherwise("MACHINERY"))
    base = p.select(
        F.col("p_partkey").alias("id"),
        (F.lit(1) + F.col("p_partkey") % n_channels).alias("channel_id"),
        (F.col("p_size") * 60).alias("duration"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("title"),
        F.replace("p_name", F.lit(" "), F.lit("|")).alias("manual_tags"),
        F.replace("p_name", F.lit(" "), F.lit("|")).alias("child_categories"),
        lang.alias("language"),
        F.floor(F.col("p_retailprice") * (F.col("p_partkey") % 1000)).cast("bigint").alias("view_count"))
    return base.select(
        "*", popularity_tier(F.col("view_count")).alias("popularity"),
        F.floor(F.col("view_count") / 20.0).cast("bigint").alias("like_count"),
        F.floor(F.col("view_count") / 200.0).cast("bigint").alias("comment_count"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """lineitem ⋈ orders → one interaction per line item.

    ``interaction_id`` (order, line, part, supplier, ship day, price in cents)
    is the row key and the tie-break the reference's input order provided
    implicitly; (order, line) alone repeats in the generated data.
    """
    li = load_table(spark, d, "lineitem")
    o = load_table(spark, d, "orders")
    rf, ls, ln = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    itype = (F.when((rf == "N") & (ls == "O"), "watch").when(rf == "N", "impression")
             .when((rf == "R") & (ls == "O"), "watch").when(rf == "R", "click")
             .when(ls == "O", "like").when(ln % 2 == 0, "dislike").otherwise("comment"))
    base = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), ln.cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"),
                    F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")).alias("interaction_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("video_id"),
        F.col("l_quantity"),
        itype.alias("interaction_type"),
        F.when(ln % 3 == 0, F.lit(None).cast("bigint")).otherwise(F.col("l_suppkey"))
         .alias("previously_watched_video"),
        (F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + ln * 3600).alias("ts_epoch"),
        F.when(ln % 4 == 0, "Mobile").when(ln % 4 == 1, "Desktop")
         .when(ln % 4 == 2, "Laptop").otherwise("Tablet").alias("device"))
    value = (F.when(F.col("interaction_type") == "watch",
                    F.concat(F.floor(F.col("l_quantity") * 40).cast("int").cast("string"),
                             F.lit(" seconds")))
             .when(F.col("interaction_type") == "comment", F.lit("Great video!"))
             .otherwise(F.lit("-")))
    return base.select("interaction_id", "user_id", "video_id", "interaction_type",
                       value.alias("interaction_value"), "previously_watched_video",
                       "ts_epoch", "device")


def _event_video(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def online_interactions(spark: SparkSession, d: str) -> DataFrame:
    """events → online interactions (impression / click / complete / like / dislike)."""
    e = load_table(spark, d, "events")
    et = F.col("event_type")
    itype = (F.when(et == "view", "impression").when(et == "click", "click")
             .when(et == "purchase", "complete").when(et == "signup", "like")
             .otherwise("dislike"))
    vid = _event_video(F.col("props"))
    return e.select(
        F.col("event_id").alias("interaction_id"),
        F.col("user_id"),
        vid.alias("video_id"),
        F.concat(F.lit("req_"), F.col("user_id").cast("string"), F.lit("_"), _day_key(F.col("ts")))
         .alias("request_id"),
        F.col("ts"),
        itype.alias("interaction_type"),
        F.col("value").alias("watch_time_seconds"),
        (F.lit(60.0) * (F.lit(1) + vid % 50)).alias("video_duration_seconds"),
        (F.lit(1) + F.col("event_id") % 10).cast("int").alias("position_in_list"),
        F.concat(F.lit("v"), (F.lit(1) + F.col("user_id") % 2).cast("string")).alias("model_version"),
        F.lit("exp_1").alias("experiment_id"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Tracked predictions: one per (user, day) of events.

    The recommended list is the sorted set of videos the user met that day and
    the score of a video is its largest event value.
    """
    e = load_table(spark, d, "events")
    day = F.to_timestamp_ntz(F.date_trunc("day", F.col("ts")))
    per_video = (e.select("user_id", day.alias("day"), _event_video(F.col("props")).alias("video_id"),
                          "value")
                 .groupBy("user_id", "day", "video_id").agg(F.max("value").alias("score")))
    key = F.concat(F.col("user_id").cast("string"), F.lit("_"), _day_key(F.col("day")))
    return (per_video.groupBy("user_id", "day")
            .agg(F.array_sort(F.collect_list("video_id")).alias("recommended_video_ids"),
                 F.map_from_entries(F.collect_list(F.struct("video_id", "score"))).alias("video_scores"))
            .select(F.concat(F.lit("inf_"), key).alias("inference_id"),
                    F.concat(F.lit("req_"), key).alias("request_id"),
                    "user_id", "recommended_video_ids", "video_scores",
                    F.col("day").alias("ts"),
                    (F.col("day") + F.expr("INTERVAL 48 HOURS")).alias("expires_at"),
                    F.concat(F.lit("v"), (F.lit(1) + F.col("user_id") % 2).cast("string")).alias("model_version"),
                    F.lit("exp_1").alias("experiment_id")))


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Feedback events: each event answers the user's prediction of that day.

    Every fourth event points at a video outside all recommended lists
    (id + 100) so attribution and merge have misses.
    """
    e = load_table(spark, d, "events")
    et = F.col("event_type")
    k = _event_video(F.col("props"))
    vid = F.when(F.col("event_id") % 4 == 0, k + 100).otherwise(k)
    dur = F.lit(60.0) * (F.lit(1) + k % 50)
    itype = (F.when(et == "view", "watch").when(et == "click", "click")
             .when(et == "purchase", "complete").when(et == "signup", "like").otherwise("skip"))
    return e.select(
        F.concat(F.lit("fb_"), F.col("event_id").cast("string")).alias("feedback_id"),
        F.col("event_id"),
        F.col("user_id"),
        vid.alias("video_id"),
        F.concat(F.lit("inf_"), F.col("user_id").cast("string"), F.lit("_"), _day_key(F.col("ts")))
         .alias("inference_id"),
        itype.alias("interaction_type"),
        F.col("ts"),
        F.col("value").alias("watch_time_seconds"),
        dur.alias("video_duration_seconds"),
        (F.col("value") / dur).alias("watch_percentage"),
        F.when(F.col("event_id") % 4 == 0, "Mobile").when(F.col("event_id") % 4 == 1, "Desktop")
         .when(F.col("event_id") % 4 == 2, "Laptop").otherwise("Tablet").alias("device"),
        (F.lit(1) + F.col("event_id") % 10).cast("int").alias("position_in_list"))


def item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as items: id, vector, category (label as text)."""
    e = load_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding"),
                    F.concat(F.lit("Cat"), F.col("label").cast("string")).alias("category"))


def inference_log(spark: SparkSession, d: str) -> DataFrame:
    """Inference records, one per (user, day) request of events: latency from
    the request's event count and largest value, stage latencies as shares,
    recommendations = the viewed / clicked videos (empty → an error)."""
    e = load_table(spark, d, "events")
    rec = F.when(F.col("event_type").isin("view", "click"),
                 F.struct(_event_video(F.col("props")).alias("video_id"),
                          (F.col("value") / 500.0).alias("score"),
                          (F.col("value") / 1000.0).alias("retrieval_score"),
                          (F.col("value") / 400.0).alias("ranker_score")))
    g = e.groupBy(F.concat(F.lit("req_"), F.col("user_id").cast("string"), F.lit("_"),
                           _day_key(F.col("ts"))).alias("request_id")).agg(
        F.min("ts").alias("ts"), F.count(F.lit(1)).alias("_n"), F.max("value").alias("_mx"),
        F.collect_list(rec).alias("recommendations"))
    lat = F.lit(10.0) * F.col("_n") + F.col("_mx")
    return g.select("request_id", "ts", lat.alias("inference_latency_ms"),
                    (lat * 0.3).alias("retrieval_latency_ms"), (lat * 0.5).alias("ranking_latency_ms"),
                    "recommendations")


def feature_records(spark: SparkSession, d: str) -> DataFrame:
    """Logged model inputs: online events with the user's age (missing for
    every 13th event) and country, and the video's duration and category."""
    o = online_interactions(spark, d)
    u = users(spark, d).select(F.col("id").alias("_uid"), "age", F.col("country_code").alias("country"))
    v = videos(spark, d).select(F.col("id").alias("_vid"), "duration", "category")
    j = o.join(u, o.user_id == u._uid, "left").join(v, o.video_id == v._vid, "left")
    return j.select(F.col("interaction_id").alias("request_id"), "ts",
                    F.when(F.col("interaction_id") % 13 == 0, F.lit(None).cast("int")).otherwise(F.col("age")).alias("age"),
                    "duration", "country", "category")
