"""Queries: batch replays of the streaming operators (same transformations
the streaming jobs run per micro-batch / per window)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recframe.operators import datasets as DS
from recframe.operators import feedback as FB
from recframe.queries.common import query, rounded
from recframe.session import cut_lineage
from recframe.sources import adapters as A
from recframe.sources import io as IO
from recframe.sources.published import PublishedTable
from recframe.sources.tables import load_table
from recframe.streaming import jobs, ops


def stream_events(spark, d):
    """Event payloads as a producer would send them (every 97th corrupt)."""
    e = load_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    et = F.col("event_type")
    typ = (F.when(et == "view", "impression").when(et == "click", "click").when(et == "purchase", "watch")
           .when(et == "signup", "like").otherwise("dislike"))
    ev = e.select("event_id", "user_id", k.alias("video_id"),
                  F.concat(F.lit("inf_"), F.col("user_id").cast("string"), F.lit("_"),
                           F.date_format("ts", "yyyyMMdd")).alias("inference_id"),
                  typ.alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                  (F.col("value") / (F.lit(60.0) * (F.lit(1) + k % 50))).alias("watch_percentage"),
                  F.col("value").alias("watch_time_seconds"),
                  F.when(F.col("event_id") % 4 == 0, "Mobile").otherwise("Desktop").alias("device"),
                  (F.lit(1) + F.col("event_id") % 10).cast("int").alias("position_in_list"))
    bad = F.base64(F.lit("{broken").cast("binary"))
    return ev, bad


@query("st01_ingest_events")
def st01(spark, d):
    ev, bad = stream_events(spark, d)
    raw = ev.select(F.when(F.col("event_id") % 97 == 0, bad)
                    .otherwise(F.base64(F.to_json(F.struct(*ev.columns)).cast("binary"))).alias("data"))
    return rounded(ops.validate_and_label(ops.decode_events(raw)))


@query("st02_raw_archive")
def st02(spark, d):
    return ops.with_date_parts(A.online_interactions(spark, d)).select("interaction_id", "year", "month", "day")


@query("st03_keyed_upsert")
def st03(spark, d):
    """Three micro-batches into the published table, the last of them run twice."""
    o = A.online_interactions(spark, d).select("user_id", "ts", "video_id", "interaction_id")
    third = o.select((F.max("interaction_id") / 3).cast("bigint")).scalar()
    table = PublishedTable(spark, IO.scratch_dir(spark, "st03"))
    for batch_id in (0, 1, 2, 2):
        part = o.where(F.least(F.floor(F.col("interaction_id") / F.greatest(third, F.lit(1))), F.lit(2)) == batch_id)
        jobs.upsert_batch(table, part, batch_id, "st03", ["user_id", "ts", "video_id"], "interaction_id")
    return table.read().select("user_id", "ts", "video_id", "interaction_id")


@query("st04_stream_attribution")
def st04(spark, d):
    j = ops.attribution_join(A.feedback(spark, d), A.predictions(spark, d), 24)
    return ops.latest_attribution(j)


@query("st05_stream_merge")
def st05(spark, d):
    lab = FB.make_labels(A.feedback(spark, d))
    p = A.predictions(spark, d)
    j = lab.alias("l").join(p.alias("p"), (F.col("l.inference_id") == F.col("p.inference_id"))
                            & (F.col("p.ts") <= F.col("l.feedback_timestamp"))
                            & (F.col("l.feedback_timestamp") <= F.col("p.ts") + F.expr("INTERVAL 48 HOURS")))
    return j.select("l.inference_id", "l.video_id", "l.label", F.col("p.ts").alias("inference_timestamp"),
                    "l.feedback_timestamp", "p.model_version")


@query("st06_recent_state")
def st06(spark, d):
    r = ops.recent_state(A.online_interactions(spark, d))
    return r.select("user_id", "recent_videos", "watched_videos", F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_ts"))


@query("st07_inference_ttl")
def st07(spark, d):
    p = A.predictions(spark, d)
    wm = p.select(F.max("ts")).scalar()
    return p.where(F.col("ts") >= wm - F.expr("INTERVAL 48 HOURS")).select("inference_id")


@query("p17_capture_sample")
def p17(spark, d):
    lg = A.inference_log(spark, d).select("request_id", "ts", F.struct("inference_latency_ms").alias("input_features"),
                                          F.struct(F.size("recommendations").alias("n")).alias("output_predictions"))
    kept = DS.capture_sample(lg, 25.0, inputs=False)
    return kept.select("request_id", "ts", F.to_json("input_features").alias("input_features"), F.col("output_predictions.n").alias("n"))


@query("st08_capture_log")
def st08(spark, d):
    return A.inference_log(spark, d).select("request_id", "ts", "inference_latency_ms", F.size("recommendations").alias("n"))


@query("st09_windowed_metrics")
def st09(spark, d):
    return rounded(ops.windowed_metrics(A.online_interactions(spark, d), "15 minutes").drop("approx_users"))


@query("st09_sliding_metrics")
def st09s(spark, d):
    return rounded(ops.windowed_metrics(A.online_interactions(spark, d), "24 hours", "60 minutes").drop("approx_users"))


AGE_EDGES = [20.0, 30.0, 40.0, 50.0, 60.0, 70.0]


@query("st10_windowed_quality")
def st10(spark, d):
    """Windows of all records against the records before 16 January."""
    r = A.feature_records(spark, d)
    base = ops.quality_baseline(r.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 16))), "age", AGE_EDGES)
    return rounded(ops.window_drift(ops.windowed_quality(r, "age", edges=AGE_EDGES), cut_lineage(base), "age"))


@query("st11_session_window")
def st11(spark, d):
    return ops.sessions(A.online_interactions(spark, d))


def _alerts(spark, d):
    lg = A.inference_log(spark, d)
    return lg.select(F.when(F.size("recommendations") == 0, "no_recommendations")
                     .when(F.col("inference_latency_ms") > 450, "high_latency").alias("alert_type"), "ts", "request_id"
                     ).where(F.col("alert_type").isNotNull())


@query("st12_alert_cooldown")
def st12(spark, d):
    return ops.alert_cooldown(_alerts(spark, d), 30).select("alert_type", "ts", "request_id")


@query("st13_late_labels")
def st13(spark, d):
    return ops.late_labels(A.feedback(spark, d), A.predictions(spark, d), 24)
