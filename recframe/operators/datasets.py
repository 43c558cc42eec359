"""Dataset shaping: canonical names, joins with suffixes, projections,
feature selection, masking, record building (P01, P21–P24, P27, J05, A50,
E24, R06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.operators.encoders import hash_bucket
from recframe.session import store

# Canonical feature names (P01).  Fixed values:
#   id → user_id / video_id / channel_id, country_code → country,
#   preferred_language → user_language, duration → video_duration,
#   language → video_language, subscriber_count → channel_subscriber_count,
#   manual_tags → tags
CANONICAL = {
    "users": {"id": "user_id", "country_code": "country", "preferred_language": "user_language"},
    "videos": {"id": "video_id", "duration": "video_duration", "language": "video_language", "manual_tags": "tags"},
    "channels": {"id": "channel_id", "subscriber_count": "channel_subscriber_count"},
}

# Field-name fragments whose values are masked (P24).  Fixed values:
SENSITIVE_FIELDS = ["password", "api_key", "apikey", "secret", "token", "authorization", "auth",
                    "credential", "private_key", "access_key", "secret_key"]
MASK = "***MASKED***"
MAX_VALUE_LENGTH = 1000


def canonicalise(df: DataFrame, entity: str) -> DataFrame:
    """One projection to the canonical feature names."""
    return df.withColumnsRenamed({k: v for k, v in CANONICAL[entity].items() if k in df.columns})


def join_with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str, how: str = "left") -> DataFrame:
    """J05 step: left join; right columns that collide get ``suffix``."""
    clash = set(left.columns) & set(right.columns) - {key}
    r = right.select(*[F.col(c).alias(f"{c}{suffix}") if c in clash else F.col(c) for c in right.columns])
    return left.join(r, key, how)


def preprocess_join(inter: DataFrame, users: DataFrame, videos: DataFrame) -> DataFrame:
    """Interactions ⟕ users ⟕ videos with ``_user`` / ``_video`` suffixes."""
    return join_with_suffix(join_with_suffix(inter, users, "user_id", "_user"), videos, "video_id", "_video")


TWO_TOWER_COLUMNS = ["user_id", "country", "user_language", "age", "previously_watched_category",
                     "video_id", "category", "title", "video_duration", "popularity", "video_language", "tags"]


def two_tower_columns(df: DataFrame) -> DataFrame:
    """The final 12 pair columns (those present)."""
    return df.select(*[c for c in TWO_TOWER_COLUMNS if c in df.columns])


def py_list_text(arr: Column) -> Column:
    """Python ``str(list_of_str)`` text: ['a', 'b'] / []."""
    return F.when(arr.isNull(), F.lit("")).when(F.size(arr) == 0, F.lit("[]")).otherwise(
        F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']")))


def split_xy(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(features, label); list columns rendered as text."""
    feats = [F.col(f.name) if not isinstance(f.dataType, T.ArrayType) else py_list_text(F.col(f.name)).alias(f.name)
             for f in df.schema.fields if f.name != label]
    return df.select(*feats), df.select(label)


def train_feature_select(df: DataFrame, skip=("user_id", "video_id", "label"), limit: int = 20) -> DataFrame:
    """String columns are categorical, numeric columns numeric; ids and
    label skipped; first ``limit`` of (categorical + numeric); fill '[UNK]' / 0."""
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
            num.append(f.name)
    chosen = (cat + num)[:limit]
    cols = [F.coalesce(F.col(c), F.lit("[UNK]")).alias(c) if c in cat else F.coalesce(F.col(c), F.lit(0)).alias(c)
            for c in chosen]
    return df.select(*[c for c in ("label",) if c in df.columns], *cols)


def _sensitive(name: str) -> bool:
    n = name.lower()
    return any(s in n for s in SENSITIVE_FIELDS)


def _trunc(c: Column) -> Column:
    return F.when(F.length(c) > MAX_VALUE_LENGTH,
                  F.concat(F.substring(c, 1, MAX_VALUE_LENGTH), F.lit("...("), F.length(c).cast("string"),
                           F.lit(" chars)"))).otherwise(c)


def _mask(c: Column, dt: T.DataType, name: str, depth: int = 0) -> Column:
    if _sensitive(name):
        return F.lit(MASK)
    if depth > 10:
        return F.lit("...TRUNCATED...")
    if isinstance(dt, T.StringType):
        return _trunc(c)
    if isinstance(dt, T.StructType):
        return F.struct(*[_mask(c[f.name], f.dataType, f.name, depth + 1).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.MapType):
        pat = "|".join(SENSITIVE_FIELDS)
        return F.transform_values(c, lambda k, v: F.when(F.lower(k.cast("string")).rlike(pat), _hidden(v, dt.valueType, depth + 1))
                                  .otherwise(_mask(v, dt.valueType, "", depth + 1)))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _mask(x, dt.elementType, "", depth + 1))
    return c


def _hidden(c: Column, dt: T.DataType, depth: int) -> Column:
    """A masked value of a map, whose values keep one type: the mask for text,
    structs, arrays and maps hidden field by field, null for the rest.  The type is
    that of the values which are not masked."""
    if depth > 10:
        return F.lit("...TRUNCATED...")
    if isinstance(dt, T.StringType):
        return F.lit(MASK)
    if isinstance(dt, T.StructType):
        return F.struct(*[(F.lit(MASK) if _sensitive(f.name) else _hidden(c[f.name], f.dataType, depth + 1)).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _hidden(x, dt.elementType, depth + 1))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: _hidden(v, dt.valueType, depth + 1))
    return F.lit(None).cast(dt)


def mask_sensitive(df: DataFrame) -> DataFrame:
    """Mask fields whose name contains a sensitive word, at any depth of
    structs, arrays and maps (by their keys); strings over 1000 chars are cut with
    a length note."""
    return df.select(*[_mask(F.col(f.name), f.dataType, f.name).alias(f.name) if not _sensitive(f.name)
                       else F.lit(MASK).alias(f.name) for f in df.schema.fields])


def build_interactions(raw: DataFrame) -> DataFrame:
    """Impression / click / watch / complete / like / dislike records →
    one interaction schema.  complete ⇒ watch time = duration and
    completion 1.0; watch ⇒ completion = watch / duration; position
    defaults to 0."""
    t = F.col("interaction_type")
    dur = F.coalesce(F.col("video_duration_seconds"), F.lit(0.0))
    watch = (F.when(t == "complete", dur).when(t == "watch", F.coalesce(F.col("watch_time_seconds"), F.lit(0.0)))
             .otherwise(F.lit(0.0)))
    rate = (F.when(t == "complete", F.lit(1.0))
            .when((t == "watch") & (dur > 0), F.coalesce(F.col("watch_time_seconds"), F.lit(0.0)) / dur)
            .otherwise(F.lit(0.0)))
    return raw.select(F.concat(t, F.lit("_"), F.col("interaction_id").cast("string")).alias("interaction_id"),
                      "user_id", "video_id", F.col("request_id").alias("recommendation_request_id"), "ts", t.alias("interaction_type"),
                      watch.alias("watch_time_seconds"), dur.alias("video_duration_seconds"), rate.alias("completion_rate"),
                      F.coalesce(F.col("position_in_list"), F.lit(0)).alias("position_in_list"),
                      F.coalesce(F.col("model_version"), F.lit("")).alias("model_version"),
                      F.coalesce(F.col("experiment_id"), F.lit("")).alias("experiment_id"))


def capture_sample(log: DataFrame, percent: float, inputs: bool = True, outputs: bool = True, key: str = "request_id") -> DataFrame:
    """The records of a stable ``percent`` of the requests; ``input_features``
    and ``output_predictions`` are null unless they are captured."""
    kept = log.where(hash_bucket(F.col(key), 10000) < int(round(percent * 100)))
    for wanted, column in ((inputs, "input_features"), (outputs, "output_predictions")):
        if not wanted and column in log.columns:
            kept = kept.withColumn(column, F.lit(None).cast(log.schema[column].dataType))
    return kept


def capture_record(log: DataFrame) -> DataFrame:
    """Inference record from a response: request, time, latency, output
    recommendations and per-stage latencies as nested STRUCT / MAP."""
    return log.select("request_id", "ts", "inference_latency_ms",
                      F.struct(F.col("recommendations").alias("recommendations")).alias("output_predictions"),
                      F.struct(F.create_map(F.lit("retrieval"), F.col("retrieval_latency_ms"),
                                            F.lit("ranking"), F.col("ranking_latency_ms")).alias("stage_latencies"))
                      .alias("metadata"))


def catalogue_counts(tables: dict[str, tuple[DataFrame, str]],
                     splits: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Rows and distinct ids per named table, and per part of a split table
    (``<name>_<split>``, by its ``split`` column; a part without rows has no row).
    The tables are counted one after the other, so that only one is exchanged at a time."""
    parts = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                    F.count_distinct(key).alias("distinct_ids")) for name, (df, key) in tables.items()]
    parts += [df.groupBy(F.concat(F.lit(f"{name}_"), "split").alias("table")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_ids")) for name, (df, key) in (splits or {}).items()]
    out = store(parts[0], "counts")
    for p in parts[1:]:
        out = out.unionByName(store(p, "counts"))
    return out


def item_feature_table(videos: DataFrame, channels: DataFrame) -> DataFrame:
    """Serving features per video with the channel's subscriber count
    (0 when the channel is unknown)."""
    ch = channels.select(F.col("id").alias("_cid"), F.col("subscriber_count").alias("_subs"))
    j = videos.join(ch, videos.channel_id == ch._cid, "left")
    return j.select(F.col("id").alias("video_id"), "category", F.col("language").alias("video_language"),
                    F.col("duration").alias("video_duration"), "popularity", "view_count", "like_count",
                    "comment_count", F.coalesce("_subs", F.lit(0)).cast("bigint").alias("channel_subscriber_count"))
