"""Streaming jobs = their batch replays (files source, availableNow trigger)."""

import datetime as dt
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from recframe.queries import q_streaming as QS
from recframe.sources import adapters as A
from recframe.sources.published import PublishedTable
from recframe.streaming import jobs, ops, state
from tests.conftest import SF


def _tmp():
    return tempfile.mkdtemp(prefix="rf-stream-", dir="/tmp")


def _name(base):
    return f"{base}-{uuid.uuid4().hex[:8]}"


def test_ingest_events_stream(spark):
    ev, bad = QS.stream_events(spark, SF)
    raw = ev.select(F.when(F.col("event_id") % 97 == 0, bad)
                    .otherwise(F.base64(F.to_json(F.struct(*ev.columns)).cast("binary"))).alias("data"),
                    F.to_timestamp_ntz("timestamp").alias("arrival"))
    src, out = _tmp(), _tmp()
    raw.repartition(2).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = jobs.read_raw(spark, os.path.join(src, "in"), max_files=1)
    q = jobs.ingest_events(spark, stream, out, _name("ingest"), trigger={"availableNow": True})
    q.awaitTermination(300)
    ok = spark.read.parquet(os.path.join(out, "events"))
    dead = spark.read.parquet(os.path.join(out, "dead_letter"))
    replay = ops.validate_and_label(ops.decode_events(raw))
    assert ok.count() == replay.where("status = 'ok'").count()
    assert dead.count() == replay.where("status != 'ok'").count() > 0
    assert ok.select("year", "month", "day").distinct().count() >= 1


def test_windowed_metrics_stream(spark):
    o = A.online_interactions(spark, SF)
    src, out = _tmp(), _tmp()
    o.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(o.schema).parquet(os.path.join(src, "in"))
    q = jobs.windowed_metrics(spark, stream, out, "15 minutes", watermark="1 hour", name=_name("wm"),
                              trigger={"availableNow": True})
    q.awaitTermination(300)
    got = spark.read.parquet(out).drop("approx_users")
    got = got.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.startswith("window") else F.col(c) for c in got.columns])
    batch = ops.windowed_metrics(o).drop("approx_users")
    # every emitted (closed) window equals the batch window exactly
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0


def _counts(path, spark):
    return spark.read.parquet(os.path.join(path, "counts")).agg(F.sum("ok"), F.sum("failed")).first()


def _files(spark, parts, src):
    """Parquet files that the stream takes one by one, in this order."""
    for i, df in enumerate(parts):
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"{i:02d}"))
        for f in os.listdir(os.path.join(src, f"{i:02d}")):
            os.utime(os.path.join(src, f"{i:02d}", f), (1_000_000 + 100 * i, 1_000_000 + 100 * i))


def _stream(spark, schema, src):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)


NOW = {"availableNow": True}


def test_ingest_counts_and_second_run(spark):
    ev, bad = QS.stream_events(spark, SF)
    raw = ev.select(F.when(F.col("event_id") % 97 == 0, bad).otherwise(F.base64(F.to_json(F.struct(*ev.columns)).cast("binary"))).alias("data"),
                    F.to_timestamp_ntz("timestamp").alias("arrival"))
    src, out, name = _tmp(), _tmp(), _name("ingest")
    raw.repartition(2).write.mode("overwrite").parquet(os.path.join(src, "in"))
    for _ in range(2):  # the second run finds nothing new
        jobs.ingest_events(spark, jobs.read_raw(spark, os.path.join(src, "in"), max_files=1), out, name, trigger=NOW).awaitTermination(300)
        ok, failed = _counts(out, spark)
        assert ok == spark.read.parquet(os.path.join(out, "events")).count()
        assert failed == spark.read.parquet(os.path.join(out, "dead_letter")).count() > 0 and ok + failed == raw.count()


def test_a_batch_run_again_replaces_its_rows(spark):
    out = _tmp()
    for _ in range(2):
        jobs.write_batch(spark.range(10).withColumn("day", F.col("id") % 3), out, 0, ("day",))
    jobs.write_batch(spark.range(5).withColumn("day", F.lit(1)), out, 1, ("day",))
    assert spark.read.parquet(out).count() == 15


def test_recent_state_stream(spark):
    o = A.online_interactions(spark, SF).select("user_id", "video_id", "ts")
    src, out = _tmp(), _tmp()
    cut = [o.where(F.col("ts") < F.lit(f"2024-01-{d}").cast("timestamp_ntz")) for d in ("10", "20")]
    _files(spark, [cut[0], cut[1].exceptAll(cut[0]), o.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))], src)
    jobs.recent_state(spark, _stream(spark, o.schema, src), out, state.RecentState(limit=5), lateness="90 days", name=_name("recent"), trigger=NOW).awaitTermination(300)
    rows = spark.read.parquet(out)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("recent_videos", "watched_videos", "last_us"), "batch").alias("s")).select("user_id", "s.*")
    want = ops.recent_state(o, state.RecentState(limit=5))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(last) == key(want) and last.where(F.size("recent_videos") > 5).count() == 0
    assert last.where(F.size("watched_videos") > F.size("recent_videos")).count() > 0


def test_recent_state_rules():
    rules = state.RecentState(limit=3, most=4, recent_ttl=10, watched_ttl=100)
    kept = rules.step(None, [(1, 7), (2, 8), (3, 7), (4, 9), (5, 1)])
    assert kept[0] == [1, 9, 7] and dict(zip(kept[2], kept[3], strict=True)) == {1: 5, 9: 4, 7: 3, 8: 2}
    kept = rules.step(kept, [(6, 2)])  # the video watched longest ago leaves
    assert set(kept[2]) == {1, 9, 7, 2} and kept[0] == [2, 1, 9]
    assert rules.step(kept, [(30, 3)])[0] == [3] and set(rules.step(kept, [(30, 3)])[2]) == {1, 9, 2, 3}
    assert rules.step(kept, [(200, 3)])[2] == [3]
    assert rules.expire(kept, 17)[0] == [] and rules.expire(kept, 17)[2] == kept[2] and rules.expire(kept, 107) is None
    assert rules.expire(kept, 16) == kept


def test_recent_state_expires(spark):
    schema = "user_id long, video_id long, ts timestamp_ntz"
    at = lambda day: dt.datetime(2024, 1, 1) + dt.timedelta(days=day)
    src, out = _tmp(), _tmp()
    _files(spark, [spark.createDataFrame([r], schema) for r in [(1, 5, at(0)), (2, 6, at(3)), (2, 7, at(40)), (2, 8, at(41))]], src)
    jobs.recent_state(spark, _stream(spark, spark.createDataFrame([], schema).schema, src), out, lateness="1 hour", name=_name("expire"), trigger=NOW).awaitTermination(300)
    first = [r for r in spark.read.parquet(out).where("user_id = 1").orderBy("batch").collect()]
    assert [(r.recent_videos, r.watched_videos) for r in first] == [([5], [5]), ([], [5]), ([], [])]


def test_keyed_upsert_last_write_wins(spark):
    o = A.online_interactions(spark, SF).select("user_id", "video_id", "ts", "interaction_type", "interaction_id")
    later = o.where("interaction_id % 3 = 0").withColumn("interaction_type", F.lit("changed")).withColumn("interaction_id", F.col("interaction_id") + 10 ** 6)
    src, path, name = _tmp(), os.path.join(_tmp(), "t"), _name("upsert")
    _files(spark, [o, later, o.limit(0)], src)
    keys = ["user_id", "ts", "video_id"]
    run = lambda: jobs.keyed_upsert(spark, _stream(spark, o.schema, src), path, name=name, trigger=NOW).awaitTermination(300)
    run()
    table = PublishedTable(spark, path)
    cols = [*keys, "interaction_type", "interaction_id"]
    want = ops.last_write(o.unionByName(later), keys, "interaction_id").select(*cols)
    got = table.read().select(*cols)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.where("interaction_type = 'changed'").count() > 0
    version = table.current()["version"]
    run()  # a second start
    assert jobs.upsert_batch(table, later, 1, name, keys, "interaction_id") is None  # a batch run again
    assert table.current()["version"] == version and table.read().count() == want.count()


def _attribution_inputs(spark, parts, shuffle):
    fb, pr = A.feedback(spark, SF), A.predictions(spark, SF)
    key = (lambda c: F.pmod(F.xxhash64(c), F.lit(parts))) if shuffle else (lambda c: F.least(F.floor(F.dayofmonth("ts") / 11), F.lit(parts - 1)))
    split = lambda df, c: [df.where(key(c) == i) for i in range(parts)]
    end = lambda df, c, day: df.limit(1).withColumn("ts", F.lit(dt.datetime(2024, 6, day))).withColumn(c, F.lit(f"end{day}")).withColumn("user_id", F.lit(-1).cast("long"))
    return (fb, [*split(fb, "feedback_id"), *(end(fb, "feedback_id", d) for d in (1, 2))]), (pr, [*split(pr, "inference_id"), *(end(pr, "inference_id", d) for d in (1, 2))])


@pytest.mark.parametrize("shuffle, lateness", [(True, "90 days"), (False, "1 hour")])
def test_attribution_stream_matches_replay(spark, shuffle, lateness):
    """Three files a side (in any order, or by time), then the end of time: each feedback comes out once."""
    (fb, fparts), (pr, pparts) = _attribution_inputs(spark, 3, shuffle)
    sf, sp, out = _tmp(), _tmp(), _tmp()
    _files(spark, fparts, sf)
    _files(spark, pparts, sp)
    jobs.stream_attribution(spark, _stream(spark, fb.schema, sf), _stream(spark, pr.schema, sp), out, 24, 48, lateness, name=_name("attr"), trigger=NOW).awaitTermination(600)
    got = spark.read.parquet(out).where("feedback_id not like 'end%'").withColumn("inference_ts", F.col("inference_ts").cast("timestamp_ntz"))
    assert got.count() == fb.count() and got.select("feedback_id").distinct().count() == fb.count()
    want = ops.latest_attribution(ops.attribution_join(fb, pr, 24))
    mine = got.where("status = 'attributed'").select(*want.columns)
    assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0
    late = ops.late_labels(fb, pr, 24).where("ts <= newest_prediction + interval 48 hours")
    seen = got.where("status = 'late'").select("feedback_id")
    assert seen.exceptAll(ops.late_labels(fb, pr, 24).select("feedback_id")).count() == 0 and late.select("feedback_id").exceptAll(seen).count() == 0
    if not shuffle:
        assert spark.read.parquet(out).select("batch").distinct().count() > 2  # emitted as time goes on


def test_attribution_rules():
    us = lambda h: h * state.HOUR
    got = state.attribute([(us(30), "a"), (us(100), "b"), (us(1), "c")], [(us(2), "p"), (us(10), "q"), (us(10), "r"), (us(31), "s")], us(24))
    assert got == [("a", "r", us(10), "attributed"), ("b", "s", us(31), "late"), ("c", None, None, "unmatched")]


def test_late_rows_go_to_their_side(spark):
    schema = "id long, ts timestamp_ntz"
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    batches = [[(1, 0), (2, 50)], [(3, 20), (4, 26), (5, 27), (6, None)], [(7, 200)], [(8, 176), (9, 177)]]
    src, out, name = _tmp(), _tmp(), _name("late")
    _files(spark, [spark.createDataFrame([(i, at(h)) for i, h in b], schema) for b in batches], src)
    for _ in range(2):
        jobs.split_late(spark, _stream(spark, spark.createDataFrame([], schema).schema, src), out, 24, name=name, trigger=NOW).awaitTermination(300)
        ids = lambda side: sorted(r.id for r in spark.read.parquet(os.path.join(out, side)).collect())
        assert ids("late") == [3, 4, 6, 8] and ids("on_time") == [1, 2, 5, 7, 9]


def test_inference_ttl(spark):
    schema = "inference_id string, ts timestamp_ntz"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    src, out = _tmp(), _tmp()
    _files(spark, [spark.createDataFrame([(n, at(h)) for n, h in b], schema) for b in ([("a", 0), ("b", 10)], [("c", 55)], [("d", 56)])], src)
    jobs.inference_ttl(spark, _stream(spark, spark.createDataFrame([], schema).schema, src), out, 48, "1 hour", name=_name("ttl"), trigger=NOW).awaitTermination(300)
    got = spark.read.parquet(out)
    assert sorted(r.inference_id for r in got.where("status = 'live'").collect()) == ["a", "b", "c", "d"]
    assert [r.inference_id for r in got.where("status = 'expired'").collect()] == ["a"]


def test_alert_cooldown_stream_matches_replay(spark):
    schema = "alert_type string, ts timestamp_ntz, request_id string"
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("steady", at(10 * i), f"r{i:03d}") for i in range(30)] + [("rare", at(200 * i), f"q{i}") for i in range(3)]
    df = spark.createDataFrame(rows, schema)
    want = sorted((r.alert_type, r.request_id) for r in ops.alert_cooldown(df, 30).collect())
    assert want == sorted([("steady", f"r{i:03d}") for i in range(0, 30, 3)] + [("rare", f"q{i}") for i in range(3)])  # a steady alarm fires again
    src, out = _tmp(), _tmp()
    _files(spark, [df.where(F.col("ts") < F.lit(at(95))), df.where((F.col("ts") >= F.lit(at(95))) & (F.col("ts") < F.lit(at(210)))), df.where(F.col("ts") >= F.lit(at(210)))], src)
    jobs.alert_cooldown(spark, _stream(spark, df.schema, src), out, 30, name=_name("alerts"), trigger=NOW).awaitTermination(300)
    assert sorted((r.alert_type, r.request_id) for r in spark.read.parquet(out).collect()) == want


def test_windowed_quality_stream_matches_replay(spark):
    r = A.feature_records(spark, SF)
    base = ops.quality_baseline(r.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 16))), "age", QS.AGE_EDGES)
    base.write.mode("overwrite").parquet(path := os.path.join(_tmp(), "base"))
    base = spark.read.parquet(path)
    src, out = _tmp(), _tmp()
    end = r.limit(1).withColumn("ts", F.lit(dt.datetime(2024, 6, 1)))
    _files(spark, [r, end, end], src)
    jobs.windowed_quality(spark, _stream(spark, r.schema, src), "age", base, QS.AGE_EDGES, out, name=_name("quality"), trigger=NOW, min_samples=20).awaitTermination(300)
    got = spark.read.parquet(out).drop("batch")
    got = got.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c.startswith("window") else F.col(c) for c in got.columns])
    want = ops.window_drift(ops.windowed_quality(r, "age", edges=QS.AGE_EDGES, min_samples=20), base, "age").select(*got.columns)
    close = lambda df: sorted((x.window_start, x["count"], x.bins, round(x.drift_score, 9), round(x.psi_score, 9), round(x["mean"], 9)) for x in df.collect())
    assert len(close(got)) > 10 and close(got) == close(want)
