"""Queries: sources, sinks, feature store, artifacts, dataset versions.

Writers run against a fresh folder under the shared checkpoint location and
return what they wrote, read back."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.operators import encoders as E
from recframe.operators import feedback as FB
from recframe.operators import sampling as S
from recframe.queries.common import query, rounded
from recframe.sources import adapters as A
from recframe.sources import io as IO
from recframe.sources.published import PublishedTable


@query("s01_load_entity")
def s01(spark, d):
    return IO.load_entity(spark, os.path.join(d, "customer.parquet"))


@query("s02_load_all")
def s02(spark, d):
    tabs = IO.load_all(spark, d, ("customer", "part", "supplier", "orders"))
    out = None
    for n, df in tabs.items():
        part = df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("s03_load_dir")
def s03(spark, d):
    p = IO.scratch_dir(spark, "s03")
    v = A.videos(spark, d).select("id", "category", "duration")
    v.write.parquet(os.path.join(p, "part.parquet.tmp"))
    IO.write_parquet(v, os.path.join(p, "dir"))
    got = IO.load_dir(spark, os.path.join(p, "dir"), v.schema)
    missing = IO.load_dir(spark, os.path.join(p, "missing"), v.schema)
    return got.unionByName(missing)


LOG_SCHEMA = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
                           T.StructField("inference_latency_ms", T.DoubleType())])


@query("s05_read_jsonl_log")
def s05(spark, d):
    p = IO.scratch_dir(spark, "s05")
    IO.write_jsonl_log(A.inference_log(spark, d).select("request_id", "ts", "inference_latency_ms"), p)
    return IO.read_jsonl_log(spark, p, LOG_SCHEMA, "ts", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 25))


@query("s06_write_jsonl_log")
def s06(spark, d):
    p = IO.scratch_dir(spark, "s06")
    IO.write_jsonl_log(FB.make_labels(A.feedback(spark, d)), p)
    return spark.read.json(p)


@query("s07_write_parquet")
def s07(spark, d):
    p = IO.scratch_dir(spark, "s07")
    IO.write_parquet(A.interactions(spark, d), p)
    return spark.read.parquet(p)


@query("s08_write_merged")
def s08(spark, d):
    p = IO.scratch_dir(spark, "s08")
    m = FB.merge_predictions_labels(A.predictions(spark, d), FB.make_labels(A.feedback(spark, d)))
    IO.write_merged(m.withColumn("ids", F.array("video_id")), p, "csv")
    return spark.read.option("header", True).csv(p)


@query("s09_write_partitioned_by_day")
def s09(spark, d):
    p = IO.scratch_dir(spark, "s09")
    IO.write_partitioned_by_day(A.feedback(spark, d), p, "ts")
    return spark.read.parquet(p)


@query("s10_write_split_set")
def s10(spark, d):
    p = IO.scratch_dir(spark, "s10")
    IO.write_split_set(S.random_split(FB.make_labels(A.feedback(spark, d)), ["interaction_id"]), p)
    return spark.read.parquet(p).groupBy("split").count()


@query("s11_embeddings_table")
def s11(spark, d):
    p = IO.scratch_dir(spark, "s11")
    IO.write_embeddings(A.item_vectors(spark, d), p)
    return spark.read.parquet(p)


def _profile(spark, d, day_lo, day_hi):
    u = A.users(spark, d)
    return u.select("id", "country_code", "age", F.lit(day_lo).alias("updated_at"))


@query("s12_feature_store_upsert")
def s12(spark, d):
    """The stored table, an update published as its next version, read back."""
    u = A.users(spark, d)
    cur = u.select(F.col("id").alias("user_id"), "country_code", "age", F.lit(dt.datetime(2024, 1, 1)).alias("updated_at"))
    upd = u.where(F.col("id") % 4 == 0).select(F.col("id").alias("user_id"), F.lit("XX").alias("country_code"),
                                                (F.col("age") + 1).alias("age"),
                                                F.when(F.col("id") % 8 == 0, F.lit(dt.datetime(2024, 1, 2)))
                                                .otherwise(F.lit(dt.datetime(2023, 12, 31))).alias("updated_at"))
    table = PublishedTable(spark, IO.scratch_dir(spark, "s12"))
    IO.publish_upsert(table, cur, "user_id")
    IO.publish_upsert(table, upd, "user_id")
    return table.read().select("user_id", "country_code", "age", "updated_at")


@query("s13_feature_store_read")
def s13(spark, d):
    feats = A.users(spark, d).select(F.col("id").alias("user_id"), "country_code", "age")
    ids = A.online_interactions(spark, d).select("user_id").union(spark.range(100000, 100005).select(F.col("id").alias("user_id")))
    return IO.feature_store_read(feats, ids, "user_id")


@query("s14_artifact_tables")
def s14(spark, d):
    p = IO.scratch_dir(spark, "s14")
    IO.save_artifact(E.string_vocab(A.users(spark, d), "country_code"), p, "vocabulary", "country")
    IO.save_artifact(E.normalization_stats(A.users(spark, d), ["age"]), p, "normalizer", "age")
    names = IO.list_artifacts(spark, p, "vocabulary") + IO.list_artifacts(spark, p, "normalizer")
    v = IO.load_artifact(spark, p, "vocabulary", "country")
    return v.withColumn("artifacts", F.lit(",".join(names)))


def _versions(spark, d):
    base = IO.scratch_dir(spark, "versions")
    lab = FB.make_labels(A.feedback(spark, d))
    split = lambda df: S.stratified_split(df, "label", ["interaction_id"])
    v1 = IO.write_version(lab.where(F.col("event_id") % 5 != 0), base, split, ts="feedback_timestamp")
    v2 = IO.write_version(lab, base, split, ts="feedback_timestamp")
    return base, v1, v2


@query("s15_dataset_version_write")
def s15(spark, d):
    base, _, _ = _versions(spark, d)
    return IO.list_versions(spark, base)


@query("s16_dataset_version_read")
def s16(spark, d):
    base, v1, v2 = _versions(spark, d)
    latest = IO.read_version(spark, base)
    IO.delete_version(spark, base, v1)
    return latest.withColumn("remaining_versions", F.lit(IO.list_versions(spark, base).count()))


@query("a19_version_diff")
def a19(spark, d):
    base, v1, v2 = _versions(spark, d)
    return IO.version_diff(spark, base, v1, v2)


@query("a18_version_stats")
def a18(spark, d):
    s = S.stratified_split(FB.make_labels(A.feedback(spark, d)), "label", ["interaction_id"])
    return IO.version_stats(s, ts="feedback_timestamp")


@query("a20_content_hash")
def a20(spark, d):
    return IO.content_hash(A.interactions(spark, d))


@query("s17_sharded_export")
def s17(spark, d):
    p = IO.scratch_dir(spark, "s17")
    IO.sharded_export(A.interactions(spark, d), p, 5000)
    return spark.read.parquet(p).select(F.input_file_name().alias("f")).groupBy("f").count()


@query("s18_video_catalog_publish")
def s18(spark, d):
    """Two versions published, the current one read back."""
    table = PublishedTable(spark, IO.scratch_dir(spark, "s18"))
    v, e = A.videos(spark, d).select("id", "category"), A.item_vectors(spark, d)
    IO.catalog_publish(v, e, "v6", table)
    IO.catalog_publish(v, e, "v7", table)
    return table.read().select("id", "category", F.col("embedding").isNotNull().alias("has_embedding"), "model_version")


@query("s20_baseline_store")
def s20(spark, d):
    p = IO.scratch_dir(spark, "s20")
    IO.save_baseline(E.normalization_stats(A.videos(spark, d), ["duration", "view_count"]), p, "b1")
    none = IO.load_baseline(spark, p, "b2")
    return rounded(IO.load_baseline(spark, p, "b1").withColumn("other_missing", F.lit(none is None)))


@query("s21_preprocess_outputs")
def s21(spark, d):
    from recframe.queries.q_misc import e24
    p = IO.scratch_dir(spark, "s21")
    IO.write_parquet(e24(spark, d), os.path.join(p, "processed"))
    IO.save_artifact(E.build_all_vocabs(A.users(spark, d), A.videos(spark, d)), p, "vocabulary", "all")
    return spark.read.parquet(os.path.join(p, "processed"))


@query("s22_scan_labels")
def s22(spark, d):
    p = IO.scratch_dir(spark, "s22")
    lab = FB.make_labels(A.feedback(spark, d))
    IO.write_partitioned_by_day(lab.withColumn("label", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("label"))),
                                p, "feedback_timestamp", mode="overwrite")
    return IO.scan_labels(spark, p, dt.date(2024, 1, 10), dt.date(2024, 1, 20)).drop("year", "month", "day")


@query("s23_activity_upsert")
def s23(spark, d):
    o = A.online_interactions(spark, d)
    last = lambda df: FB.latest_label(df.select("user_id", F.col("ts").alias("feedback_timestamp"),
                                                F.col("interaction_id").alias("event_id"), "video_id", "interaction_type"),
                                      keys=("user_id",))
    split = dt.datetime(2024, 1, 16)
    cur = last(o.where(F.col("ts") < split)).withColumnRenamed("feedback_timestamp", "updated_at")
    upd = last(o.where(F.col("ts") >= split)).withColumnRenamed("feedback_timestamp", "updated_at")
    table = PublishedTable(spark, IO.scratch_dir(spark, "s23"))
    IO.publish_upsert(table, cur.drop("event_id"), "user_id")
    IO.publish_upsert(table, upd.drop("event_id"), "user_id")
    return table.read().select("user_id", "updated_at", "video_id", "interaction_type")
