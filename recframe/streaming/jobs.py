"""Streaming jobs: source → transformation (``ops``, ``state``) → sink.

A job's checkpoint lies under ``streams/<name>`` of the folder that the cluster
names in ``spark.checkpoint.dir``, the same for every application, so a second
start goes on after the last committed micro-batch.  Batches are written by
their number (``batch=…`` folders, or a published table that knows its last
batch), so a batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from recframe.session import checkpoint_dir, cut_lineage
from recframe.sources import io as IO
from recframe.sources.published import PublishedTable
from recframe.streaming import ops, state


def _ckpt(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_dir(spark)
    return os.path.join(root, "streams", name)


def write_batch(batch: DataFrame, path: str, batch_id: int, partition_by: tuple[str, ...] = ()) -> None:
    """Write the rows of one micro-batch; run again, it replaces them."""
    (batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by, "batch").parquet(path))


def event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Watermark on ``col``; TIMESTAMP_NTZ event times are read as UTC
    TIMESTAMPs first (watermarks need a zoned timestamp)."""
    if dict(df.dtypes).get(col) == "timestamp_ntz":
        df = df.withColumn(col, F.col(col).cast("timestamp"))
    return df.withWatermark(col, delay)


def _trigger(w: DataStreamWriter, trigger: dict | None) -> DataStreamWriter:
    return w.trigger(**(trigger or {"processingTime": "10 seconds"}))


def read_raw(spark: SparkSession, path: str, fmt: str = "parquet", schema: str = "data string, arrival timestamp_ntz",
             max_files: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def ingest_events(spark: SparkSession, raw: DataFrame, out_dir: str, name: str = "ingest",
                  trigger: dict | None = None) -> StreamingQuery:
    """ST01: decode, validate, label; valid rows → ``out_dir/events``
    (year / month / day), rejected rows → ``out_dir/dead_letter``, ok / failed
    counts of each batch (observed as it is evaluated) → ``out_dir/counts``."""
    labelled = ops.validate_and_label(ops.decode_events(raw))

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = Observation(f"{name}-{batch_id}")
        ok = F.col("status") == "ok"
        staged = cut_lineage(batch.observe(counts, F.count(F.when(ok, 1)).alias("ok"), F.count(F.when(~ok, 1)).alias("failed")))  # one evaluation feeds both sinks
        write_batch(ops.with_date_parts(staged.where(ok)), os.path.join(out_dir, "events"), batch_id, ("year", "month", "day"))
        write_batch(staged.where(~ok), os.path.join(out_dir, "dead_letter"), batch_id)
        seen = counts.get
        write_batch(spark.createDataFrame([(int(seen["ok"]), int(seen["failed"]))], "ok bigint, failed bigint"), os.path.join(out_dir, "counts"), batch_id)

    w = labelled.writeStream.foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def raw_archive(spark: SparkSession, raw: DataFrame, out_dir: str, name: str = "archive",
                trigger: dict | None = None, ts: str = "arrival") -> StreamingQuery:
    """ST02: archive raw records as gzip JSON under year / month / day."""
    w = (ops.with_date_parts(raw, ts).writeStream.format("json").option("compression", "gzip")
         .partitionBy("year", "month", "day").option("path", out_dir)
         .option("checkpointLocation", _ckpt(spark, name)))
    return _trigger(w, trigger or {"processingTime": "60 seconds"}).start()


def upsert_batch(table: PublishedTable, batch: DataFrame, batch_id: int, name: str, keys: list[str], arrival: str) -> int | None:
    """One micro-batch of ST03; None if the table has it already.  Day
    partitions without a new row are not rewritten."""
    current = table.current()
    if current is not None and current["meta"].get("stream") == name and current["meta"]["batch"] >= batch_id:
        return None
    staged = cut_lineage(ops.with_date_parts(batch))
    if staged.isEmpty():
        return None
    return table.upsert(staged, keys, [arrival], ["year", "month", "day"], {"stream": name, "batch": batch_id})


def keyed_upsert(spark: SparkSession, events: DataFrame, table_dir: str, keys=("user_id", "ts", "video_id"), arrival: str = "interaction_id",
                 name: str = "upsert", trigger: dict | None = None) -> StreamingQuery:
    """ST03: the last write of a key wins - of a later micro-batch, or in one
    batch the greatest ``arrival``.  Every batch is a version of a published
    table that records the batch, so a batch that is run again changes nothing
    and readers never see half of one."""
    table = PublishedTable(spark, table_dir)

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(table, batch, batch_id, name, list(keys), arrival)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def stream_attribution(spark: SparkSession, feedback: DataFrame, predictions: DataFrame, sink_dir: str,
                       max_delay_hours: int = 24, ttl_hours: int = 48, lateness: str = "24 hours", name: str = "attribution",
                       trigger: dict | None = None) -> StreamingQuery:
    """ST04: state per (user, video) holds a feedback until the watermark has
    passed it and then emits it once, with its newest prediction: attributed
    (within the delay), late (ST13: older, but alive) or unmatched.  Rows that
    come later than ``lateness`` are taken out before by ``split_late``."""
    fb = event_time(feedback.select("user_id", "video_id", "ts", "feedback_id"), "ts", lateness)
    pr = event_time(predictions.select("user_id", "recommended_video_ids", "ts", "inference_id"), "ts", lateness)
    out = ops.attribution_events(fb, pr).groupBy("user_id", "video_id").applyInPandasWithState(
        state.attribution_fn(max_delay_hours, ttl_hours), state.ATTRIBUTION_OUT, state.ATTRIBUTION_STATE, "append", "EventTimeTimeout")
    rows = out.select("feedback_id", "inference_id", F.timestamp_micros("inference_us").alias("inference_ts"), "status")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, sink_dir, batch_id, ("status",))

    w = rows.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def split_late(spark: SparkSession, events: DataFrame, out_dir: str, lateness_hours: int = 24, ts: str = "ts", name: str = "split_late",
               trigger: dict | None = None) -> StreamingQuery:
    """ST13: rows on time → ``out_dir/on_time``, rows that come ``lateness_hours``
    or more after the newest row of the batches before (and rows without a time)
    → ``out_dir/late``; together they are the input.  The newest time of each
    batch is kept in ``out_dir/newest``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        staged = cut_lineage(batch)
        newest = os.path.join(out_dir, "newest")
        before = None
        if IO.exists(spark, newest):
            before = spark.read.parquet(newest).where(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        limit = F.lit(before).cast(batch.schema[ts].dataType) - F.expr(f"INTERVAL {int(lateness_hours)} HOURS")
        on_time = F.col(ts).isNotNull() & (F.lit(before is None) | F.coalesce(F.col(ts) > limit, F.lit(False)))
        write_batch(staged.where(on_time), os.path.join(out_dir, "on_time"), batch_id)
        write_batch(staged.where(~on_time), os.path.join(out_dir, "late"), batch_id)
        write_batch(staged.agg(F.max(ts).alias("newest")), newest, batch_id)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def stream_merge(spark: SparkSession, labels: DataFrame, predictions: DataFrame, sink_dir: str,
                 join_window_hours: int = 48, name: str = "merge", trigger: dict | None = None) -> StreamingQuery:
    """ST05: labels ⋈ predictions on inference id inside the join window."""
    lb = event_time(labels, "feedback_timestamp", f"{join_window_hours} hours").alias("l")
    pr = event_time(predictions, "ts", f"{join_window_hours} hours").alias("p")
    cond = ((F.col("l.inference_id") == F.col("p.inference_id"))
            & (F.col("p.ts") <= F.col("l.feedback_timestamp"))
            & (F.col("l.feedback_timestamp") <= F.col("p.ts") + F.expr(f"INTERVAL {int(join_window_hours)} HOURS")))
    j = lb.join(pr, cond).select("l.inference_id", "l.video_id", "l.label", F.col("p.ts").alias("inference_timestamp"),
                                 "l.feedback_timestamp", "p.model_version")
    w = (j.writeStream.format("parquet").option("path", sink_dir).outputMode("append")
         .option("checkpointLocation", _ckpt(spark, name)))
    return _trigger(w, trigger).start()


def recent_state(spark: SparkSession, inter: DataFrame, sink_dir: str, rules: state.RecentState | None = None, lateness: str = "1 hour",
                 name: str = "recent_state", trigger: dict | None = None) -> StreamingQuery:
    """ST06: per user the recent interactions and the watched videos, with their
    lifetimes (``RecentState``).  A user's newest row is their state; empty lists
    say that it has expired."""
    ev = event_time(inter.select("user_id", "video_id", "ts"), "ts", lateness).withColumn("us", F.unix_micros("ts"))
    out = ev.groupBy("user_id").applyInPandasWithState(
        state.recent_fn(rules or state.RecentState()), state.RECENT_OUT, state.RECENT_STATE, "update", "EventTimeTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, sink_dir, batch_id)

    w = out.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def alert_cooldown(spark: SparkSession, alerts: DataFrame, sink_dir: str, minutes: int = 30, name: str = "alert_cooldown",
                   trigger: dict | None = None) -> StreamingQuery:
    """ST12: the time of the last alert that fired, per alert type, is the state."""
    ev = alerts.select("alert_type", "request_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    out = ev.groupBy("alert_type").applyInPandasWithState(
        state.cooldown_fn(minutes, "alert_type"), "alert_type string, us bigint, request_id string", state.ALERT_STATE, "append", "NoTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select("alert_type", F.timestamp_micros("us").alias("ts"), "request_id"), sink_dir, batch_id)

    w = out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def windowed_metrics(spark: SparkSession, inter: DataFrame, sink_dir: str, duration: str = "15 minutes",
                     slide: str | None = None, watermark: str = "1 hour", name: str = "window_metrics",
                     trigger: dict | None = None) -> StreamingQuery:
    """ST09: event-time window partials; a window is emitted once the
    watermark (max event time − ``watermark``) passes its end."""
    agg = ops.windowed_metrics(event_time(inter, "ts", watermark), duration, slide)
    w = (agg.writeStream.format("parquet").option("path", sink_dir).outputMode("append")
         .option("checkpointLocation", _ckpt(spark, name)))
    return _trigger(w, trigger).start()


def windowed_quality(spark: SparkSession, records: DataFrame, feature: str, baseline: DataFrame, edges: list[float], sink_dir: str,
                     watermark: str = "2 hours", name: str = "window_quality", trigger: dict | None = None, min_samples: int = 100) -> StreamingQuery:
    """ST10: 24-hour windows every 2 hours with their drift (A34) and PSI
    against ``baseline``; windows under ``min_samples`` rows are skipped."""
    agg = ops.windowed_quality(event_time(records, "ts", watermark), feature, edges=edges, min_samples=min_samples)

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(ops.window_drift(batch, baseline, feature), sink_dir, batch_id)

    w = agg.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()


def sessions(spark: SparkSession, inter: DataFrame, sink_dir: str, gap: str = "30 minutes",
             watermark: str = "1 hour", name: str = "sessions", trigger: dict | None = None) -> StreamingQuery:
    """ST11: session windows, emitted when closed by the watermark."""
    agg = ops.sessions(event_time(inter, "ts", watermark), gap)
    w = (agg.writeStream.format("parquet").option("path", sink_dir).outputMode("append")
         .option("checkpointLocation", _ckpt(spark, name)))
    return _trigger(w, trigger).start()


def capture_log(spark: SparkSession, records: DataFrame, out_dir: str, name: str = "capture",
                records_per_file: int = 100, trigger: dict | None = None) -> StreamingQuery:
    """ST08: buffered JSON log — one flush per trigger (60 s), ≤ 100 records
    per file; ``trigger={'availableNow': True}`` drains and stops."""
    w = (records.writeStream.format("json").option("path", out_dir).option("maxRecordsPerFile", records_per_file)
         .option("checkpointLocation", _ckpt(spark, name)))
    return _trigger(w, trigger or {"processingTime": "60 seconds"}).start()


def inference_ttl(spark: SparkSession, predictions: DataFrame, sink_dir: str, ttl_hours: int = 48, lateness: str = "1 hour", name: str = "inference_ttl",
                  trigger: dict | None = None) -> StreamingQuery:
    """ST07: each prediction is state until the watermark has passed its
    lifetime; ``live`` and ``expired`` rows tell when (batch form: P18)."""
    ev = event_time(predictions.select("inference_id", "ts"), "ts", lateness).withColumn("us", F.unix_micros("ts"))
    out = ev.groupBy("inference_id").applyInPandasWithState(state.ttl_fn(ttl_hours), state.TTL_OUT, state.TTL_STATE, "append", "EventTimeTimeout")

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select("inference_id", F.timestamp_micros("us").alias("ts"), "status"), sink_dir, batch_id, ("status",))

    w = out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", _ckpt(spark, name))
    return _trigger(w, trigger).start()
