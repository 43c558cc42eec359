"""Transformations shared by streaming jobs and their batch replays (ST01–ST13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe import constants as C
from recframe.functions import labels as L
from recframe.streaming import state

# ST01: fields of one event payload (JSON, base64 encoded in the stream).
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("video_id", T.LongType()), T.StructField("inference_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("watch_percentage", T.DoubleType()), T.StructField("watch_time_seconds", T.DoubleType()),
    T.StructField("device", T.StringType()), T.StructField("position_in_list", T.IntegerType())])


def encode_events(events: DataFrame) -> DataFrame:
    """Raw stream records: base64(JSON) payloads, as a producer writes them."""
    return events.select(F.base64(F.to_json(F.struct(*events.columns)).cast("binary")).alias("data"),
                         F.col("timestamp").cast("timestamp_ntz").alias("arrival"))


def decode_events(raw: DataFrame, data_col: str = "data") -> DataFrame:
    """ST01 step 1: base64 → JSON → typed columns; undecodable rows keep
    ``_corrupt`` = the raw payload."""
    txt = F.unbase64(F.col(data_col)).cast("string")
    parsed = F.from_json(txt, EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    return raw.select(parsed.alias("e"), txt.alias("_raw")).select(
        "e.*", F.when(F.col("e").isNull() | F.col("e.event_type").isNull(), F.col("_raw")).alias("_corrupt"))


def validate_and_label(ev: DataFrame) -> DataFrame:
    """ST01 steps 2–3: P08 validation (ids present; optional fields
    defaulted) and P07 labels; ``status`` = ok / failed."""
    ok = F.col("_corrupt").isNull() & F.col("user_id").isNotNull() & F.col("video_id").isNotNull()
    return ev.select(
        "event_id", "user_id", "video_id", "inference_id", F.col("event_type").alias("interaction_type"),
        F.to_timestamp_ntz(F.col("timestamp")).alias("ts"),
        F.coalesce("watch_percentage", F.lit(0.0)).alias("watch_percentage"),
        F.coalesce("watch_time_seconds", F.lit(0.0)).alias("watch_time_seconds"),
        F.coalesce("device", F.lit("unknown")).alias("device"),
        F.coalesce("position_in_list", F.lit(0)).alias("position_in_list"),
        L.event_label(F.col("event_type"), F.coalesce("watch_percentage", F.lit(0.0))).alias("label"),
        F.when(ok, "ok").otherwise("failed").alias("status"))


def with_date_parts(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ST02 / S09: year / month / day partition columns from event time."""
    return df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts)).withColumn("day", F.dayofmonth(ts))


def windowed_metrics(inter: DataFrame, duration: str = "15 minutes", slide: str | None = None,
                     ts: str = "ts") -> DataFrame:
    """ST09: per event-time window impressions, clicks, completions, CTR,
    unique users (tumbling, or sliding when ``slide`` is given; half-open
    windows, T45)."""
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    t = F.col("interaction_type")
    g = inter.groupBy(w.alias("w")).agg(
        F.count(F.when(t == "impression", 1)).alias("impressions"),
        F.count(F.when(t == "click", 1)).alias("clicks"),
        F.count(F.when(t == "complete", 1)).alias("completions"),
        F.approx_count_distinct("user_id").alias("approx_users"),
        F.count(F.lit(1)).alias("events"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "impressions",
                    "clicks", "completions", "events", "approx_users",
                    F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(F.lit(0.0)).alias("ctr"))


def windowed_quality(records: DataFrame, feature: str, duration: str = "24 hours", slide: str = "2 hours",
                     min_samples: int = 100, ts: str = "ts", edges: list[float] | None = None) -> DataFrame:
    """ST10: per sliding window count, missing rate, mean and population std
    of a numeric feature and, with ``edges``, the values per bin; windows with
    fewer than ``min_samples`` rows skipped."""
    x = F.col(feature).cast("double")
    g = records.groupBy(F.window(ts, duration, slide).alias("w")).agg(
        F.count(F.lit(1)).alias("count"), F.count(F.when(x.isNull(), 1)).alias("missing"),
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), *([bin_counts(x, edges).alias("bins")] if edges else []))
    return g.where(F.col("count") >= min_samples).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "count",
        (F.col("missing") / F.col("count")).alias("missing_rate"), "mean", "std", *(["bins"] if edges else []))


def sessions(inter: DataFrame, gap: str = "30 minutes", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """ST11: session windows per user (a gap ≥ ``gap`` starts a new session)."""
    g = inter.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def attribution_join(feedback: DataFrame, predictions: DataFrame, max_delay_hours: int = 24) -> DataFrame:
    """ST04 / ST05 join: feedback ⋈ exploded predictions on (user, video) with
    pred_ts ≤ fb_ts ≤ pred_ts + max delay — the bounded interval lets a
    stream–stream join drop state once the watermark passes it."""
    p = predictions.select(F.col("user_id").alias("p_user"), F.col("inference_id").alias("p_inference"),
                           F.col("ts").alias("p_ts"), F.explode("recommended_video_ids").alias("p_video"))
    cond = ((F.col("user_id") == F.col("p_user")) & (F.col("video_id") == F.col("p_video"))
            & (F.col("p_ts") <= F.col("ts"))
            & (F.col("ts") <= F.col("p_ts") + F.expr(f"INTERVAL {int(max_delay_hours)} HOURS")))
    return feedback.join(p, cond)


def latest_attribution(joined: DataFrame) -> DataFrame:
    """ST04 / J09 by batch: the newest prediction per feedback."""
    best = joined.groupBy("feedback_id").agg(F.max(F.struct(F.col("p_ts"), F.col("p_inference"))).alias("b"))
    return best.select("feedback_id", F.col("b.p_inference").alias("inference_id"), F.col("b.p_ts").alias("inference_ts"))


def attribution_events(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """ST04 input: one keyed sequence of feedback and recommended videos."""
    f = feedback.select("user_id", "video_id", "ts", F.col("feedback_id"), F.lit(None).cast("string").alias("inference_id"))
    p = predictions.select("user_id", F.explode("recommended_video_ids").alias("video_id"), "ts", F.lit(None).cast("string").alias("feedback_id"), "inference_id")
    return f.unionByName(p).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def last_write(events: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """ST03 by batch: of the rows of one key the one that arrived last."""
    payload = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max(F.struct(F.col(arrival).alias("_a"), *payload)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in payload])


def late_labels(feedback: DataFrame, predictions: DataFrame, max_delay_hours: int = 24) -> DataFrame:
    """ST13: feedback whose matching prediction is older than the delay bound
    (it would arrive after the watermark and is not attributed)."""
    p = predictions.select(F.col("user_id").alias("p_user"), F.col("ts").alias("p_ts"),
                           F.explode("recommended_video_ids").alias("p_video"))
    j = feedback.join(p, (F.col("user_id") == F.col("p_user")) & (F.col("video_id") == F.col("p_video"))
                      & (F.col("p_ts") <= F.col("ts")))
    g = j.groupBy("feedback_id").agg(F.max("p_ts").alias("newest_prediction"), F.first("ts").alias("ts"))
    return g.where(F.col("ts") > F.col("newest_prediction") + F.expr(f"INTERVAL {int(max_delay_hours)} HOURS"))


def alert_cooldown(alerts: DataFrame, minutes: int = 30, key: str = "alert_type", ts: str = "ts", name: str = "request_id") -> DataFrame:
    """ST12: an alert fires unless one of its key fired within ``minutes`` before
    (a steady alarm fires again every ``minutes``).

    What fires depends on what fired before, so a key's alerts pass one task in
    time order; it holds the time of the last one only, and streams."""
    pause = minutes * 60_000_000
    kind = alerts.schema[key].dataType.simpleString()

    def run(batches):
        at, last = None, None
        for pdf in batches:
            keep = []
            for k, us, r in zip(pdf["_key"], pdf["_us"], pdf["_name"], strict=True):
                if k != at:
                    at, last = k, None
                last, out = state.fired(last, [(us, r)], pause)
                keep.append(bool(out))
            yield pdf[keep]

    slim = alerts.select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"), F.col(name).alias("_name"))
    out = (slim.repartition("_key").sortWithinPartitions("_key", "_us", "_name")
           .mapInPandas(run, f"_key {kind}, _us bigint, _name {alerts.schema[name].dataType.simpleString()}"))
    return out.select(F.col("_key").alias(key), F.timestamp_micros("_us").cast(alerts.schema[ts].dataType).alias(ts), F.col("_name").alias(name))


def recent_state(inter: DataFrame, rules: state.RecentState | None = None) -> DataFrame:
    """ST06 by batch: the state step over each user's events.

    Of a user only what the state can still hold reaches the step: the newest
    ``limit`` interactions and the ``most`` videos watched last, both since the
    last pause longer than their lifetime."""
    rules = rules or state.RecentState()
    ev = inter.select("user_id", "video_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    def since(ttl_us: int) -> DataFrame:
        gap = F.session_window(F.timestamp_micros("us"), f"{ttl_us // 1_000_000} seconds {ttl_us % 1_000_000 + 1} microseconds")
        # the count is carried along: without it the sessions would be optimised away before they merge
        pauses = ev.groupBy("user_id", gap.alias("s")).agg(F.count("*").alias("n"))
        start = pauses.groupBy(F.col("user_id").alias("_u")).agg(F.max(F.struct(F.col("s.start").alias("start"), "n")).alias("_s"))
        return ev.join(start, F.col("user_id") == F.col("_u")).where(F.col("us") >= F.unix_micros("_s.start")).drop("_u", "_s")

    newest = Window.partitionBy("user_id").orderBy(F.desc("us"), "video_id")
    recent = since(rules.recent_ttl).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= rules.limit)
    last = since(rules.watched_ttl).groupBy("user_id", "video_id").agg(F.max("us").alias("us"))
    watched = last.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= rules.most)
    # an interaction that is the last one of its video is in both
    only = watched.join(recent.select("user_id", "video_id", "us").distinct(), ["user_id", "video_id", "us"], "left_anti")
    bounded = recent.drop("_r").unionByName(only.drop("_r"))
    return bounded.groupBy("user_id").applyInPandas(state.recent_replay(rules), state.RECENT_OUT)


def window_drift(windows: DataFrame, baseline: DataFrame, feature: str) -> DataFrame:
    """ST10: A34 / A35 of every window against the baseline: ``drift_score`` from
    mean and standard deviation, ``psi_score`` from the shares of ``bins``.

    ``baseline`` has one row per feature: feature, mean, std, edges, bins."""
    b = baseline.where(F.col("feature") == feature)
    w = windows.select("*", *[b.select(F.first(c)).scalar().alias(n) for c, n in (("mean", "_m"), ("std", "_s"), ("bins", "_b"))])
    d = F.abs(F.col("mean") - F.col("_m")) / F.col("_s")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    share = lambda c: F.transform(c, lambda x: F.greatest(F.coalesce(x / F.nullif(total(F.col(c)), F.lit(0)), F.lit(0.0)), F.lit(C.PSI_FLOOR)))
    psi = F.aggregate(F.zip_with(share("bins"), share("_b"), lambda c, e: (c - e) * F.log(c / e)), F.lit(0.0), lambda a, x: a + x)
    return w.withColumn("drift_score", F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(F.least(1 - 1 / (1 + d), F.lit(1.0)))).withColumn(
        "psi_score", F.least(psi / C.PSI_SCALE, F.lit(1.0))).drop("_m", "_s", "_b")


def bin_counts(x: Column, edges: list[float]) -> Column:
    """Aggregate: values per bin (below the first edge, between two, from the last on)."""
    lows, highs = [None, *edges], [*edges, None]
    conds = [(F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x < hi) for lo, hi in zip(lows, highs, strict=True)]
    return F.array(*[F.count(F.when(c, 1)) for c in conds])


def quality_baseline(records: DataFrame, feature: str, edges: list[float]) -> DataFrame:
    """ST10: baseline row of a feature for ``window_drift``."""
    x = F.col(feature).cast("double")
    return records.agg(F.lit(feature).alias("feature"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), bin_counts(x, edges).alias("bins"))
