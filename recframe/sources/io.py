"""Sources and sinks (S01–S23) and dataset versions.

Readers take explicit schemas where the format has none; writers are
partitioned (day, split, version) so readers prune partitions.  Paths may be
any Hadoop-compatible URI; file-system calls go through the session's Hadoop
``FileSystem`` (metadata only, never data).
"""

from __future__ import annotations

import datetime as dt
import os
import uuid
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.session import checkpoint_dir

if TYPE_CHECKING:
    from recframe.sources.published import PublishedTable

FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local)."""
    return os.path.join(checkpoint_dir(spark), "recframe-io", f"{name}-{uuid.uuid4().hex[:10]}")


def load_entity(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet / csv / json(l) by extension; other extensions and
    missing paths raise."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file format: {ext or path}")
    if not exists(spark, path):
        raise FileNotFoundError(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if FORMATS[ext] == "csv":
        r = r.option("header", True)
        if schema is None:
            r = r.option("inferSchema", True)
    return r.format(FORMATS[ext]).load(path)


def load_all(spark: SparkSession, base: str, names=("users", "videos", "channels", "interactions"),
             ext: str = ".parquet") -> dict[str, DataFrame]:
    """The entity tables by name (lazy)."""
    return {n: load_entity(spark, os.path.join(base, n + ext)) for n in names}


def load_dir(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All parquet files of a folder, else all csv files; a missing
    folder gives an empty frame with ``schema``."""
    names = list_names(spark, path)
    if not names:
        return spark.createDataFrame([], schema)
    if any(n.endswith(".parquet") for n in names):
        return spark.read.schema(schema).parquet(os.path.join(path, "*.parquet"))
    if any(n.endswith(".csv") for n in names):
        return spark.read.schema(schema).option("header", True).csv(os.path.join(path, "*.csv"))
    return spark.read.schema(schema).parquet(path)


def read_jsonl_log(spark: SparkSession, path: str, schema: T.StructType, ts_col: str | None = None,
                   start=None, end=None, limit: int | None = None) -> DataFrame:
    """JSON lines with a declared schema; blank lines skipped, corrupt
    lines kept in ``_corrupt_record``; optional time range and limit."""
    sch = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    df = (spark.read.schema(sch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
          .json(path))
    if ts_col and start is not None:
        df = df.where(F.col(ts_col) >= F.lit(start))
    if ts_col and end is not None:
        df = df.where(F.col(ts_col) <= F.lit(end))
    return df.limit(limit) if limit else df


def write_jsonl_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Snappy parquet."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Complex columns → JSON text so the frame fits a CSV file."""
    return df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
                       for f in df.schema.fields])


def write_merged(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Merged records as parquet / jsonl / csv; anything else raises."""
    if fmt == "parquet":
        write_parquet(df, path, mode=mode)
    elif fmt in ("jsonl", "json"):
        df.write.mode(mode).json(path)
    elif fmt == "csv":
        flatten_for_csv(df).write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported output format: {fmt}")


def with_day_partition(df: DataFrame, ts_col: str) -> DataFrame:
    return df.withColumn("year", F.year(ts_col)).withColumn("month", F.month(ts_col)).withColumn("day", F.dayofmonth(ts_col))


def write_partitioned_by_day(df: DataFrame, path: str, ts_col: str, mode: str = "append") -> None:
    """year= / month= / day= layout from event time."""
    with_day_partition(df, ts_col).write.mode(mode).partitionBy("year", "month", "day").parquet(path)


def write_split_set(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """Train / val / test in one pass, one folder per split."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def write_embeddings(df: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding") -> None:
    """Id + ARRAY<FLOAT> vector table."""
    df.select(id_col, F.col(vec_col).cast("array<float>").alias(vec_col)).write.mode("overwrite").parquet(path)


def feature_store_upsert(current: DataFrame | None, updates: DataFrame, key: str, updated_at: str = "updated_at") -> DataFrame:
    """Last write wins per key (latest ``updated_at``; on equal
    times the update beats the stored row)."""
    upd = updates.withColumn("_src", F.lit(1))
    allr = upd if current is None else current.withColumn("_src", F.lit(0)).unionByName(upd, allowMissingColumns=True)
    payload = [c for c in allr.columns if c not in (key,)]
    best = allr.groupBy(key).agg(F.max(F.struct(F.col(updated_at).alias("_t"), F.col("_src").alias("_s"),
                                                *[F.col(c) for c in payload if c != "_src"])).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in payload if c != "_src"])


def publish_upsert(table: PublishedTable, updates: DataFrame, key: str, updated_at: str = "updated_at", buckets: int = 16) -> int:
    """``feature_store_upsert`` into a published table of ``buckets``
    key partitions; buckets without an update are not rewritten.  A stored row
    with a later ``updated_at`` than its update stays."""
    from recframe.sources.published import key_bucket
    upd = updates.withColumn("bucket", key_bucket(key, buckets))
    stored = table.read()
    if stored is not None:
        upd = feature_store_upsert(stored.join(upd.select(key).distinct(), key, "left_semi"), upd, key, updated_at)
    return table.upsert(upd.select(*updates.columns, "bucket"), [key], [updated_at], ["bucket"])


def feature_store_read(features: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Features of the given ids; missing ids are omitted (semi join)."""
    return features.join(ids.select(key).distinct(), key, "left_semi")


def save_artifact(df: DataFrame, base: str, artifact_type: str, name: str) -> str:
    """Store a vocabulary / statistics / boundary table."""
    path = os.path.join(base, artifact_type, name)
    df.write.mode("overwrite").parquet(path)
    return path


def load_artifact(spark: SparkSession, base: str, artifact_type: str, name: str) -> DataFrame:
    path = os.path.join(base, artifact_type, name)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def list_artifacts(spark: SparkSession, base: str, artifact_type: str) -> list[str]:
    return [n for n in list_names(spark, os.path.join(base, artifact_type)) if not n.startswith(("_", "."))]


def sharded_export(df: DataFrame, path: str, records_per_shard: int) -> None:
    """Fixed records per file."""
    df.write.mode("overwrite").option("maxRecordsPerFile", records_per_shard).parquet(path)


def catalog_publish(videos: DataFrame, embeddings: DataFrame, version: str, table: PublishedTable | None = None,
                    id_col: str = "id") -> DataFrame:
    """Catalogue ⟕ embeddings + model version, published as the next
    version of ``table``."""
    e = embeddings.select(F.col("id").alias(id_col), F.col("embedding"))
    out = videos.join(e, id_col, "left").withColumn("model_version", F.lit(version))
    if table is not None:
        table.publish(out, meta={"model_version": version})
    return out


def save_baseline(stats: DataFrame, base: str, baseline_id: str) -> None:
    """Baseline statistics keyed by (baseline_id, feature)."""
    stats.withColumn("baseline_id", F.lit(baseline_id)).write.mode("overwrite").parquet(
        os.path.join(base, f"baseline_id={baseline_id}"))


def load_baseline(spark: SparkSession, base: str, baseline_id: str) -> DataFrame | None:
    """A missing baseline means no comparison (None)."""
    p = os.path.join(base, f"baseline_id={baseline_id}")
    return spark.read.parquet(p) if exists(spark, p) else None


def scan_labels(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    """Rows that carry a label, pruned to the date partitions asked for."""
    df = spark.read.parquet(path).where(F.col("label").isNotNull())
    if start is not None or end is not None:
        d = F.make_date("year", "month", "day")
        if start is not None:
            df = df.where(d >= F.lit(start))
        if end is not None:
            df = df.where(d <= F.lit(end))
    return df


# --- dataset versions -------------------------------------------------------------

def content_hash(df: DataFrame) -> DataFrame:
    """Order-free change hash over all rows: count, Σ xxhash64 (exact
    DECIMAL) and XOR of the row hashes."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return agg.select(F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("s").cast("string"),
                                         F.col("x").cast("string")), 256).alias("data_hash"))


def version_stats(df: DataFrame, label: str = "label", user: str = "user_id", video: str = "video_id",
                  ts: str | None = None, split: str = "split") -> DataFrame:
    """Totals per split, positives / negatives, unique users / videos,
    date range (one row)."""
    aggs = [F.count(F.lit(1)).alias("total_records"),
            F.count(F.when(F.col(split) == "train", 1)).alias("train_records"),
            F.count(F.when(F.col(split) == "val", 1)).alias("validation_records"),
            F.count(F.when(F.col(split) == "test", 1)).alias("test_records"),
            F.count(F.when(F.col(label) == 1, 1)).alias("positive_samples"),
            F.count(F.when(F.col(label) == 0, 1)).alias("negative_samples"),
            F.count_distinct(user).alias("unique_users"), F.count_distinct(video).alias("unique_videos")]
    if ts:
        aggs += [F.min(ts).alias("data_start"), F.max(ts).alias("data_end")]
    return df.agg(*aggs)


def write_version(df: DataFrame, base: str, split_fn, label: str = "label", user: str = "user_id",
                  video: str = "video_id", ts: str | None = None, parent: str | None = None,
                  created_at: dt.datetime | None = None) -> str:
    """Split, write ``base/version=vN/split=…``, append a metadata row
    (stats, hash, parent) to ``base/_versions``."""
    spark = df.sparkSession
    meta_path = os.path.join(base, "_versions")
    prev = spark.read.parquet(meta_path) if exists(spark, meta_path) else None
    number = 1 + (prev.agg(F.max("version_number")).first()[0] if prev is not None else 0)
    vid = f"v{number}"
    split = split_fn(df)
    split.write.mode("overwrite").partitionBy("split").parquet(os.path.join(base, f"version={vid}"))
    written = spark.read.parquet(os.path.join(base, f"version={vid}"))
    stats = version_stats(written, label, user, video, ts)
    h = content_hash(df.select(*df.columns))
    latest = (prev.orderBy(F.col("version_number").desc()).select("version_id").first()[0]
              if prev is not None and parent is None else parent)
    row = stats.select(F.lit(vid).alias("version_id"), F.lit(number).alias("version_number"),
                       F.lit(created_at or dt.datetime(1970, 1, 1)).alias("created_at"), "*",
                       F.lit(latest).cast("string").alias("parent_version"), h.select("data_hash").scalar().alias("data_hash"))
    row.write.mode("append").parquet(meta_path)
    return vid


def list_versions(spark: SparkSession, base: str) -> DataFrame:
    """Version metadata, newest first."""
    return spark.read.parquet(os.path.join(base, "_versions")).orderBy(F.col("version_number").desc())


def read_version(spark: SparkSession, base: str, version: str | None = None, split: str | None = None) -> DataFrame:
    """A named or the latest version (partition-pruned by split)."""
    vid = version or list_versions(spark, base).first()["version_id"]
    df = spark.read.parquet(os.path.join(base, f"version={vid}"))
    return df.where(F.col("split") == split) if split else df


def delete_version(spark: SparkSession, base: str, version: str) -> None:
    """Remove a version's data and its metadata row."""
    delete(spark, os.path.join(base, f"version={version}"))
    meta = os.path.join(base, "_versions")
    rest = spark.read.parquet(meta).where(F.col("version_id") != version)
    rest.write.mode("overwrite").parquet(meta + "_tmp")  # written before the old table is removed
    delete(spark, meta)
    fs, src = _fs(spark, meta + "_tmp")
    fs.rename(src, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(meta))


def version_diff(spark: SparkSession, base: str, a: str, b: str, **kw) -> DataFrame:
    """Record / positive / negative / user / video deltas (b − a) and
    whether the content hash changed, recomputed from both versions' data."""
    def st(v):
        d = read_version(spark, base, v).drop("split")
        s = version_stats(read_version(spark, base, v), **kw)
        return s.select("*", content_hash(d).select("data_hash").scalar().alias("data_hash"))
    sa, sb = st(a), st(b)
    cols = ["total_records", "positive_samples", "negative_samples", "unique_users", "unique_videos"]
    ra = sa.select(*[F.col(c).alias(f"a_{c}") for c in cols + ["data_hash"]])
    rb = sb.select(*[F.col(c).alias(f"b_{c}") for c in cols + ["data_hash"]])
    j = ra.select("*", *[rb.select(F.first(f"b_{c}")).scalar().alias(f"b_{c}") for c in cols + ["data_hash"]])
    return j.select(F.lit(a).alias("version_a"), F.lit(b).alias("version_b"),
                    *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"{c}_diff") for c in cols],
                    (F.col("a_data_hash") != F.col("b_data_hash")).alias("hash_changed"))
