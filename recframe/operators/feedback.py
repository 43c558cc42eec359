"""Feedback loop: labels, attribution, merge, rollups (P06–P10, P18, J06–J10,
W02, W05, A14–A17, A47, R05).

"Latest per key" is a ``min(struct(-time, tie, payload))`` aggregate: it is
combined on the map side, so a key with millions of labels never lands whole
in one task.  ``now`` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recframe import constants as C
from recframe.functions import labels as L


def _micros(ts) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def hours_between(later, earlier) -> Column:
    return (_micros(later) - _micros(earlier)) / 3.6e9


def make_labels(feedback: DataFrame, rules: dict | None = None) -> DataFrame:
    """P06 over feedback rows that carry an inference id: label 1 / 0, unknown
    dropped; label_source = interaction type; confidence 1.0."""
    lab = L.rule_label("interaction_type", "watch_percentage", "watch_time_seconds", rules)
    return (feedback.where(F.col("inference_id").isNotNull() & (F.col("inference_id") != ""))
            .select(F.concat(F.lit("labeled_"), F.col("feedback_id")).alias("interaction_id"), "event_id",
                    "inference_id", "user_id", "video_id", lab.alias("label"),
                    F.col("interaction_type").alias("label_source"), F.lit(1.0).alias("label_confidence"),
                    F.col("ts").alias("feedback_timestamp"), "watch_time_seconds", "watch_percentage",
                    F.col("position_in_list").alias("position_shown"))
            .where(F.col("label").isNotNull()))


def labels_with_prediction(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labels ⟕ their prediction: inference time, score (default 0),
    model and experiment."""
    p = predictions.select(F.col("inference_id").alias("_pid"), F.col("ts").alias("inference_timestamp"),
                           "video_scores", "model_version", "experiment_id")
    j = labels.join(p, labels.inference_id == p._pid, "left")
    return j.select(*labels.columns, "inference_timestamp",
                    F.coalesce(F.element_at("video_scores", F.col("video_id")), F.lit(0.0)).alias("predicted_score"),
                    "model_version", "experiment_id")


def label_filter(labels: DataFrame, include_positive: bool = True, include_negative: bool = True,
                 min_confidence: float = 0.0) -> DataFrame:
    """P09."""
    cond = F.col("label_confidence") >= min_confidence
    if not include_positive:
        cond = cond & (F.col("label") != 1)
    if not include_negative:
        cond = cond & (F.col("label") != 0)
    return labels.where(cond)


def latest_label(labels: DataFrame, keys=("inference_id", "video_id"), ts: str = "feedback_timestamp",
                 tie: str = "event_id", newest: bool = True) -> DataFrame:
    """The newest label per key, the earliest arrival on equal times.
    ``newest=False`` keeps the last arrival regardless of time (J07 rule)."""
    payload = [c for c in labels.columns if c not in keys]
    if newest:
        order = [(-_micros(ts)).alias("_o1"), F.col(tie).alias("_o2")]
    else:
        order = [(-F.col(tie)).alias("_o1"), F.lit(0).alias("_o2")]
    packed = F.min(F.struct(*order, *[F.col(c) for c in payload])).alias("_p")
    return labels.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in payload])


def merge_predictions_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Latest label per (inference, video) ⋈ prediction, kept only when
    the video was recommended; score (default 0), 1-based rank, delay."""
    lat = latest_label(labels)
    p = predictions.select(F.col("inference_id").alias("_pid"), F.col("ts").alias("inference_timestamp"),
                           "recommended_video_ids", "video_scores", "model_version", "experiment_id")
    j = lat.join(p, lat.inference_id == p._pid).where(F.array_contains("recommended_video_ids", F.col("video_id")))
    return j.select("inference_id", "user_id", "video_id", "inference_timestamp", "feedback_timestamp",
                    F.coalesce(F.element_at("video_scores", F.col("video_id")), F.lit(0.0)).alias("predicted_score"),
                    F.array_position("recommended_video_ids", F.col("video_id")).cast("int").alias("predicted_rank"),
                    "model_version", "experiment_id", "label", "label_source", "label_confidence",
                    "watch_time_seconds", "watch_percentage", "position_shown",
                    hours_between("feedback_timestamp", "inference_timestamp").alias("label_delay_hours"))


def merge_stats(merged: DataFrame, labels: DataFrame) -> DataFrame:
    """Merged, unmatched = labels − merged (duplicates count, T18),
    positives, negatives, mean delay; by model ('unknown' when empty) as
    (model_version, positive, negative, total) rows plus an 'ALL' row."""
    n_labels = labels.select(F.count(F.lit(1))).scalar()
    model = F.when(F.coalesce(F.col("model_version"), F.lit("")) == "", "unknown").otherwise(F.col("model_version"))
    aggs = [F.count(F.when(F.col("label") == 1, 1)).alias("positive"),
            F.count(F.when(F.col("label") == 0, 1)).alias("negative"), F.count(F.lit(1)).alias("total")]
    by = merged.groupBy(model.alias("model_version")).agg(*aggs).select(
        "model_version", "positive", "negative", "total",
        F.lit(None).cast("bigint").alias("records_unmatched"), F.lit(None).cast("double").alias("avg_label_delay_hours"))
    allr = merged.agg(*aggs, F.coalesce(F.avg("label_delay_hours"), F.lit(0.0)).alias("avg_label_delay_hours")).select(
        F.lit("ALL").alias("model_version"), "positive", "negative", "total",
        (n_labels - F.col("total")).alias("records_unmatched"), "avg_label_delay_hours")
    return allr.unionByName(by)


def merge_windowed(predictions: DataFrame, labels: DataFrame, join_window_hours: int = 48) -> DataFrame:
    """Last-arriving label per (inference, video) ⋈ prediction with
    label_ts − pred_ts ≤ window (upper bound only); no membership check."""
    lat = latest_label(labels.where(F.col("inference_id").isNotNull() & F.col("video_id").isNotNull()
                                    & (F.col("video_id") != 0)), newest=False)
    p = predictions.select(F.col("inference_id").alias("_pid"), F.col("ts").alias("inference_timestamp"),
                           "video_scores", "model_version")
    j = lat.join(p, lat.inference_id == p._pid)
    ok = F.col("feedback_timestamp").isNull() | F.col("inference_timestamp").isNull() | (
        _micros("feedback_timestamp") - _micros("inference_timestamp") <= F.lit(join_window_hours * 3_600_000_000))
    return j.where(ok).select("inference_id", "user_id", "video_id", "inference_timestamp", "feedback_timestamp",
                              F.coalesce(F.element_at("video_scores", F.col("video_id")), F.lit(0.0)).alias("predicted_score"),
                              "model_version", F.col("label").cast("int").alias("label"), "label_source",
                              F.coalesce(F.col("watch_time_seconds"), F.lit(0.0)).alias("watch_time_seconds"),
                              F.coalesce(F.col("watch_percentage"), F.lit(0.0)).alias("watch_percentage"))


def merge_sql(spark: SparkSession, predictions: DataFrame, labels: DataFrame, join_window_hours: int = 48) -> DataFrame:
    """The SQL form — inner join on inference id, whole-hour difference
    ≤ window, video contained in the list, score by map lookup."""
    return spark.sql(f"""
        SELECT p.inference_id, p.user_id, l.video_id, p.ts AS inference_timestamp,
               l.feedback_timestamp, element_at(p.video_scores, l.video_id) AS predicted_score,
               p.model_version, p.experiment_id, l.label, l.label_source,
               l.watch_time_seconds, l.watch_percentage
        FROM {{p}} p JOIN {{l}} l ON p.inference_id = l.inference_id
        WHERE timestampdiff(HOUR, p.ts, l.feedback_timestamp) <= {int(join_window_hours)}
          AND array_contains(p.recommended_video_ids, l.video_id)""", p=predictions, l=labels)


def ttl_filter(predictions: DataFrame, now) -> DataFrame:
    """Drop expired predictions (expires_at < now)."""
    return predictions.where(F.col("expires_at") >= F.lit(now))


def user_predictions(predictions: DataFrame, now, limit: int = 100) -> DataFrame:
    """Newest ≤ ``limit`` live predictions per user."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("inference_id"))
    return ttl_filter(predictions, now).withColumn("_rn", F.row_number().over(w)).where(
        F.col("_rn") <= limit).drop("_rn")


def attribute_feedback(feedback: DataFrame, predictions: DataFrame, now,
                       max_delay_hours: int = C.ATTRIBUTION_HOURS, newest: int | None = 100) -> DataFrame:
    """J09 (as-of join): the newest live prediction of the same user that
    recommended the video, with feedback − prediction ≤ max delay (upper bound
    only).  Only a user's ``newest`` live predictions are looked at, as W05 lists
    them; None looks at all.  Unattributed feedback gets NULL."""
    live = ttl_filter(predictions, now) if newest is None else user_predictions(predictions, now, newest)
    up = live.select(
        "user_id", F.col("inference_id").alias("attributed_inference_id"), F.col("ts").alias("_pts"),
        F.explode(F.array_distinct("recommended_video_ids")).alias("video_id"))
    fb = feedback.select("feedback_id", "user_id", "video_id", F.col("ts").alias("_fts"))
    j = fb.join(up, ["user_id", "video_id"]).where(
        _micros("_fts") - _micros("_pts") <= F.lit(max_delay_hours * 3_600_000_000))
    best = j.groupBy("feedback_id").agg(F.min(F.struct((-_micros("_pts")).alias("o"),
                                                       F.col("attributed_inference_id"))).alias("_b"))
    return (feedback.join(best, "feedback_id", "left")
            .select(*feedback.columns, F.col("_b.attributed_inference_id").alias("attributed_inference_id")))


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """Per (inference, video) total, sorted set of types, clicked /
    completed / liked / disliked, max and total watch time over > 0 values."""
    t = F.col("interaction_type")
    w = F.when(F.col("watch_time_seconds") > 0, F.col("watch_time_seconds"))
    return feedback.where(F.col("inference_id").isNotNull()).groupBy("inference_id", "video_id").agg(
        F.count(F.lit(1)).alias("total_interactions"),
        F.array_sort(F.collect_set("interaction_type")).alias("interaction_types"),
        F.bool_or(t == "click").alias("was_clicked"), F.bool_or(t == "complete").alias("was_completed"),
        F.bool_or(t == "like").alias("was_liked"), F.bool_or(t == "dislike").alias("was_disliked"),
        F.coalesce(F.max(w), F.lit(0.0)).alias("max_watch_time"), F.coalesce(F.sum(w), F.lit(0.0)).alias("total_watch_time"))


def collection_stats(feedback: DataFrame, labels: DataFrame) -> DataFrame:
    """Feedback totals, linked to an inference, by type; labels
    positive / negative — as (metric, value) rows."""
    fb = feedback.agg(F.count(F.lit(1)).alias("total_feedback"),
                      F.count(F.when(F.col("inference_id").isNotNull(), 1)).alias("linked_feedback"),
                      F.count_distinct("user_id").alias("unique_users"))
    lb = labels.agg(F.count(F.lit(1)).alias("total_labels"), F.count(F.when(F.col("label") == 1, 1)).alias("positive_labels"),
                    F.count(F.when(F.col("label") == 0, 1)).alias("negative_labels"))
    long = fb.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                         for c in fb.columns])).alias("m")).select("m.*")
    long = long.unionByName(lb.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                                          for c in lb.columns])).alias("m")).select("m.*"))
    by = feedback.groupBy("interaction_type").agg(F.count(F.lit(1)).alias("value")).select(
        F.concat(F.lit("by_type:"), F.col("interaction_type")).alias("metric"), "value")
    return long.unionByName(by)


def retrain_summary(ds: DataFrame) -> DataFrame:
    """Totals, positives / negatives, unique users / videos, date range,
    sorted label sources."""
    return ds.agg(F.count(F.lit(1)).alias("total_samples"),
                  F.count(F.when(F.col("label") == 1, 1)).alias("positive_samples"),
                  F.count(F.when(F.col("label") == 0, 1)).alias("negative_samples"),
                  F.count_distinct("user_id").alias("unique_users"), F.count_distinct("video_id").alias("unique_videos"),
                  F.min("feedback_timestamp").alias("date_start"), F.max("feedback_timestamp").alias("date_end"),
                  F.array_sort(F.collect_set("label_source")).alias("label_sources"))


def label_confidence_by_source(labels: DataFrame) -> DataFrame:
    """Mean confidence and counts per label source."""
    return labels.groupBy("label_source").agg(F.avg("label_confidence").alias("avg_confidence"),
                                              F.count(F.lit(1)).alias("count"),
                                              F.count(F.when(F.col("label") == 1, 1)).alias("positive"))


def label_event(events: DataFrame) -> DataFrame:
    """P07 on raw events."""
    return events.withColumn("label", L.event_label("interaction_type", "watch_percentage"))


def validate_event(events: DataFrame, zero_is_missing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows with defaults filled, rejected rows).  Ids must be
    present; 0 counts as missing only behind ``zero_is_missing`` (T41)."""
    ok = F.col("user_id").isNotNull() & F.col("video_id").isNotNull()
    if zero_is_missing:
        ok = ok & (F.col("user_id") != 0) & (F.col("video_id") != 0)
    filled = events.select(
        *[c for c in events.columns if c not in ("device", "watch_time_seconds", "watch_percentage", "position_in_list")],
        F.coalesce(F.col("device"), F.lit("unknown")).alias("device"),
        F.coalesce(F.col("watch_time_seconds"), F.lit(0.0)).alias("watch_time_seconds"),
        F.coalesce(F.col("watch_percentage"), F.lit(0.0)).alias("watch_percentage"),
        F.coalesce(F.col("position_in_list"), F.lit(0)).alias("position_in_list"))
    return filled.where(ok), events.where(~ok)


def flatten_features(df: DataFrame, map_cols: dict[str, str], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """P10: MAP columns → prefixed columns (``user_features`` → ``user_<k>``).

    Known keys are passed in; otherwise the distinct key set (bounded by the
    feature schema, not the data) is read once."""
    out = df
    for col, prefix in map_cols.items():
        ks = (keys or {}).get(col)
        if ks is None:
            ks = sorted(r[0] for r in df.select(F.explode(F.map_keys(col))).distinct().collect())
        out = out.select("*", *[F.element_at(col, F.lit(k)).alias(f"{prefix}_{k}") for k in ks]).drop(col)
    return out


def track_inference(recs: DataFrame, now_col: str = "ts", ttl_hours: int = C.PREDICTION_TTL_HOURS):
    """Deterministic inference id (md5 of request), expiry = ts + 48 h;
    returns (predictions, event log rows)."""
    pred = recs.select(F.concat(F.lit("inf_"), F.substring(F.md5(F.col("request_id")), 1, 16)).alias("inference_id"),
                       "*", (F.col(now_col) + F.expr(f"INTERVAL {int(ttl_hours)} HOURS")).alias("expires_at"))
    log = pred.select("inference_id", "request_id", "user_id", F.lit("prediction").alias("event_type"),
                      F.col(now_col).alias("ts"), F.size("recommended_video_ids").alias("num_recommendations"))
    return pred, log
