"""Entity feature transformers.

Each transformer = fits (aggregates → vocabulary DataFrames and lazy scalar
statistics) + one projection with the lookups as joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe import constants as C
from recframe.functions.scalar import channel_tier
from recframe.operators import encoders as E

AGE_BOUNDARIES = [18, 25, 35, 45, 55, 65]
DURATION_BOUNDARIES = [60, 300, 600, 1800, 3600]
#: What ``video_features`` reads of a row, besides its keys.
VIDEO_INPUTS = ("category", "video_language", "popularity", "video_duration")
SUBSCRIBER_BOUNDARIES = [10000, 100000, 1000000]


def _languages(users: DataFrame, videos: DataFrame) -> DataFrame:
    """Shared language vocabulary source: user ∪ video languages."""
    return (users.select(F.col("preferred_language").alias("v"))
            .unionByName(videos.select(F.col("language").alias("v"))).distinct())


def user_features(df: DataFrame, users: DataFrame, videos: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """user_id_idx, country_idx, user_language_idx, age_normalized,
    age_bucket_idx, prev_category_idx for rows carrying user_id, country,
    user_language, age, previously_watched_category; and the columns to ``keep``."""
    uid = E.integer_vocab(users, "id")
    country = E.string_vocab(users, "country_code")
    lang = E.string_vocab(_languages(users, videos), "v")
    cat = E.string_vocab(videos, "category", include_start=True, mask_value="-")
    z = E.ZScore.fit(users, "age")
    out = E.lookup_integer(df, "user_id", uid, "user_id_idx")
    out = E.lookup_string(out, "country", country, "country_idx")
    out = E.lookup_string(out, "user_language", lang, "user_language_idx")
    out = E.lookup_string(out, "previously_watched_category", cat, "prev_category_idx",
                          include_start=True, mask_value="-")
    return out.select("user_id", "video_id", "user_id_idx", "country_idx", "user_language_idx",
                      z.transform("age").alias("age_normalized"),
                      E.bucketize("age", AGE_BOUNDARIES).alias("age_bucket_idx"), "prev_category_idx", *keep)


def video_features(df: DataFrame, videos: DataFrame, users: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """video_id_idx, category_idx, video_language_idx, popularity_idx,
    popularity one-hot (unknown → low), duration_log_normalized and
    duration_bucket_idx for rows carrying video_id, category, video_language,
    popularity, video_duration; before them the columns to ``keep``."""
    vid = E.integer_vocab(videos, "id")
    cat = E.string_vocab(videos, "category")
    langs = _languages(users, videos) if users is not None else videos.select(F.col("language").alias("v"))
    lang = E.string_vocab(langs, "v")
    pop = E.string_vocab(df.sparkSession.createDataFrame([(p,) for p in C.POPULARITY_LEVELS], "p string"), "p")
    logd = E.LogTransform.fit(videos, "duration")
    z = E.ZScore(*(lambda d: (d.select(F.avg("x")).scalar(), d.select(F.stddev_pop("x")).scalar()))(
        videos.select(logd.transform("duration").alias("x"))))
    out = E.lookup_integer(df, "video_id", vid, "video_id_idx")
    out = E.lookup_string(out, "category", cat, "category_idx")
    out = E.lookup_string(out, "video_language", lang, "video_language_idx")
    out = E.lookup_string(out, "popularity", pop, "popularity_idx")
    p = F.col("popularity")
    known = p.isin(*C.POPULARITY_LEVELS)
    hot = [F.when((p == lv) | ((lv == "low") & (~known | p.isNull())), 1.0).otherwise(0.0)
           .alias(f"popularity_{lv}") for lv in C.POPULARITY_LEVELS]
    return out.select("user_id", "video_id", *keep, "video_id_idx", "category_idx", "video_language_idx",
                      "popularity_idx", *hot,
                      z.transform(logd.transform("video_duration")).alias("duration_log_normalized"),
                      E.bucketize("video_duration", DURATION_BOUNDARIES).alias("duration_bucket_idx"))


def pair_features(pairs: DataFrame, users: DataFrame, videos: DataFrame) -> DataFrame:
    """User and video features of the pairs, in one row.

    Both are looked up along one row, not apart and joined again.  Pairs without a
    user or video are left out; a pair that comes m times (repeated users or videos)
    has each of its rows m times, as every user row meets every video row."""
    u = user_features(pairs, users, videos, keep=VIDEO_INPUTS)
    names = tuple(c for c in u.columns if c not in ("user_id", "video_id", *VIDEO_INPUTS))
    out = video_features(u.where(F.col("user_id").isNotNull() & F.col("video_id").isNotNull()), videos, users, keep=names)
    times = F.count(F.lit(1)).over(Window.partitionBy("user_id", "video_id"))
    return out.withColumn("_m", times).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m")))).drop("_m", "_copy")


def video_embeddings(df: DataFrame, titles: DataFrame, tags: DataFrame, key: str = "video_id") -> DataFrame:
    """E15, the vector half: ``title_embedding`` and ``tag_embedding`` of every row
    by its video.  ``titles`` and ``tags`` are tables of (id, embedding), computed
    once a video (E21, E20); a video without one gets the zero vector, an empty
    table gives empty vectors.

    The tables are merged, never broadcast: Spark counts an array as one element, so
    a table of vectors looks small to it and would go through the driver."""
    out = df
    for name, table in (("title_embedding", titles), ("tag_embedding", tags)):
        t = table.select(F.col("id").alias("_eid"), F.col("embedding").cast("array<double>").alias(name))
        width = F.coalesce(t.select(F.max(F.size(name))).scalar(), F.lit(0))
        out = out.join(t.hint("merge"), out[key] == F.col("_eid"), "left").drop("_eid")
        out = out.withColumn(name, F.coalesce(F.col(name), F.array_repeat(F.lit(0.0), width)))
    return out


def all_tags(manual, augmented=None) -> Column:
    """The tag text of a video: manual tags, then the augmented ones where there are any."""
    return F.concat_ws("|", manual, *([augmented] if augmented is not None else []))


def ranker_star_join(samples: DataFrame, users: DataFrame, videos: DataFrame,
                     channels: DataFrame, users_first: bool = False) -> DataFrame:
    """Samples ⟕ users ⟕ videos ⟕ channels with the ranker column names.

    Enriched rows lie by video already, so videos come first; rows of one user that
    lie side by side (a positive and its negatives) are better exchanged by user first."""
    u = users.select(F.col("id").alias("user_id"), F.col("country_code").alias("country"),
                     F.col("preferred_language").alias("user_language"), "age")
    v = videos.select(F.col("id").alias("video_id"), "channel_id", "category", "child_categories",
                      F.col("language").alias("video_language"), "popularity",
                      F.col("duration").alias("video_duration"), "view_count", "like_count", "comment_count")
    ch = channels.select(F.col("id").alias("channel_id"),
                         F.col("subscriber_count").alias("channel_subscriber_count"))
    # channels join the videos, not the samples, so the samples are exchanged twice, not three times
    v = v.join(ch, "channel_id", "left")
    j = samples.join(u, "user_id", "left").join(v, "video_id", "left") if users_first else samples.join(v, "video_id", "left").join(u, "user_id", "left")
    rest = [c for df in (samples, u, v) for c in df.columns if c not in ("channel_id", "video_id", "user_id")]
    return j.select("channel_id", "video_id", "user_id", *rest)


RANKER_STRINGS = ["country", "user_language", "category", "child_categories", "video_language",
                  "device", "interaction_time_day", "popularity"]


#: Index form: column → name of its index; child categories have a vocabulary but no index.
RANKER_INDEXED = {"country": "country_idx", "user_language": "user_language_idx", "category": "category_idx",
                  "video_language": "video_language_idx", "device": "device_idx",
                  "interaction_time_day": "day_idx", "popularity": "popularity_idx"}


def ranker_vocabs(fit: DataFrame) -> DataFrame:
    """E17 fit of the index form → (vocab, value, idx), one pass over the rows;
    the popularity vocabulary holds the fixed levels."""
    cols = [c for c in RANKER_INDEXED if c != "popularity"]
    return E.column_vocabs(fit, cols, {"popularity": C.POPULARITY_LEVELS},
                           {"child_categories": F.split(F.col("child_categories"), r"\|")})


def ranker_features(df: DataFrame, fit_df: DataFrame | None = None, keys=("user_id", "video_id"),
                    form: str = "string") -> DataFrame:
    """Categoricals; age z / bucket (fill 30); log-duration z / bucket
    (fill 300); log counts; like / comment per view and like per subscriber
    (NULL or 0 → 1); subscriber log / tier; hour with sin / cos (fill 12); label.

    ``form`` "string" fills categoricals with "UNKNOWN"; "index" gives their
    places in the vocabularies of ``fit_df`` (NULL → 0, unseen → 1)."""
    if form not in ("string", "index"):
        raise ValueError(f"form must be string or index, not {form!r}")
    fit = fit_df if fit_df is not None else df
    if form == "index":
        df = E.apply_vocabs(df.drop(*[f"{c}_idx" for c in RANKER_INDEXED]), ranker_vocabs(fit), list(RANKER_INDEXED), null_index=0)
        kinds = [F.col(f"{c}_idx").alias(name) for c, name in RANKER_INDEXED.items()]
    else:
        kinds = [F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias(c) for c in RANKER_STRINGS]
    # one pass over the fitted rows gives all four statistics
    of = {"age": F.col("age").cast("double"), "dur": F.log1p(F.col("video_duration").cast("double"))}
    stats = fit.agg(F.struct(*[f(x).alias(f"{n}_{c}") for c, x in of.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).alias("s")).scalar()
    za, zd = (E.ZScore(stats[f"mean_{c}"], stats[f"std_{c}"]) for c in of)
    age = F.coalesce(F.col("age"), F.lit(C.RANKER_FILLS["age"]))
    dur = F.coalesce(F.col("video_duration"), F.lit(C.RANKER_FILLS["duration"]))
    views = F.coalesce(F.nullif(F.col("view_count"), F.lit(0)), F.lit(1))
    subs = F.coalesce(F.nullif(F.col("channel_subscriber_count"), F.lit(0)), F.lit(1))
    hour = F.coalesce(F.col("interaction_time_hour"), F.lit(C.RANKER_FILLS["hour"]))
    sin, cos = E.cyclical(hour, 24)
    zero = F.lit(0)
    cols = [*keys, *kinds,
            za.transform(age).alias("age_normalized"), E.bucketize(age, AGE_BOUNDARIES).alias("age_bucket"),
            zd.transform(F.log1p(dur.cast("double"))).alias("duration_log_normalized"),
            E.bucketize(dur, DURATION_BOUNDARIES).alias("duration_bucket"),
            F.log1p(F.coalesce(F.col("view_count"), zero).cast("double")).alias("view_count_log"),
            F.log1p(F.coalesce(F.col("like_count"), zero).cast("double")).alias("like_count_log"),
            (F.coalesce(F.col("like_count"), zero) / views).alias("like_ratio"),
            F.log1p(F.coalesce(F.col("comment_count"), zero).cast("double")).alias("comment_count_log"),
            (F.coalesce(F.col("comment_count"), zero) / views).alias("comment_ratio"),
            F.log1p(F.coalesce(F.col("channel_subscriber_count"), zero).cast("double")).alias("subscriber_count_log"),
            E.bucketize(F.coalesce(F.col("channel_subscriber_count"), zero), SUBSCRIBER_BOUNDARIES).alias("subscriber_tier"),
            (F.coalesce(F.col("like_count"), zero) / subs).alias("engagement_rate"),
            hour.alias("hour"), sin.alias("hour_sin"), cos.alias("hour_cos")]
    if "label" in df.columns:
        cols.append(F.col("label"))
    return df.select(*cols)


def serving_features(df: DataFrame) -> DataFrame:
    """log1p counts, hour sin / cos, log duration, like / comment per
    subscriber with subscribers clipped at ≥ 1."""
    subs = F.greatest(F.col("channel_subscriber_count"), F.lit(1))
    ang = F.lit(2 * math.pi) * F.col("interaction_time_hour") / F.lit(24.0)
    return df.select("*",
                     *[F.log1p(F.col(c).cast("double")).alias(f"{c}_log")
                       for c in ["view_count", "like_count", "comment_count", "channel_subscriber_count"]],
                     F.sin(ang).alias("hour_sin"), F.cos(ang).alias("hour_cos"),
                     F.log1p(F.col("video_duration").cast("double")).alias("duration_log"),
                     (F.col("like_count") / subs).alias("like_subscriber_ratio"),
                     (F.col("comment_count") / subs).alias("comment_subscriber_ratio"))


def service_derived(df: DataFrame) -> DataFrame:
    """log1p duration / views / likes, channel tier, like / comment per
    view with views clipped at ≥ 1 (missing features read as 0)."""
    z = F.lit(0)
    views = F.greatest(F.coalesce(F.col("view_count"), z), F.lit(1))
    return df.select("*",
                     F.log1p(F.coalesce(F.col("video_duration"), z).cast("double")).alias("video_duration_log"),
                     F.log1p(F.coalesce(F.col("view_count"), z).cast("double")).alias("view_count_log"),
                     F.log1p(F.coalesce(F.col("like_count"), z).cast("double")).alias("like_count_log"),
                     channel_tier(F.coalesce(F.col("channel_subscriber_count"), z)).alias("channel_tier"),
                     (F.coalesce(F.col("like_count"), z) / views).alias("like_view_ratio"),
                     (F.coalesce(F.col("comment_count"), z) / views).alias("comment_view_ratio"))


RANKER_NUMERIC = ["age_normalized", "age_bucket", "duration_log_normalized", "duration_bucket", "view_count_log",
                  "like_count_log", "comment_count_log", "like_ratio", "comment_ratio", "subscriber_count_log",
                  "subscriber_tier", "engagement_rate", "hour", "hour_sin", "hour_cos"]


def feature_specs(users: DataFrame, videos: DataFrame) -> DataFrame:
    """What a model builder needs to size its inputs → (model, feature,
    kind, size).

    kind "vocabulary": indices of the feature, max index + 1 (T43), which is the
    specials and the distinct values, so nothing is ordered.  "embedding": width
    of its layer.  "categorical", "numeric", "label": columns of the ranker, one wide each."""
    def distinct(df, col, specials, mask=None):
        c = F.col(col) if mask is None else F.when(F.col(col) != mask, F.col(col))
        return df.agg((F.count_distinct(c) + specials).alias("n")).scalar()

    category = distinct(videos, "category", 2)
    sizes = {
        ("user_tower", "user_id"): distinct(users, "id", 2),
        ("user_tower", "country"): distinct(users, "country_code", 2),
        ("user_tower", "language"): distinct(_languages(users, videos), "v", 2),
        ("user_tower", "category"): distinct(videos, "category", 3, mask="-"),
        ("user_tower", "age_bucket"): F.lit(len(AGE_BOUNDARIES) + 1),
        ("video_tower", "video_id"): distinct(videos, "id", 2),
        ("video_tower", "category"): category,
        ("video_tower", "popularity"): F.lit(len(C.POPULARITY_LEVELS) + 2),
        ("video_tower", "duration_bucket"): F.lit(len(DURATION_BOUNDARIES) + 1),
    }
    known = [(m, f, "vocabulary", n) for (m, f), n in sizes.items()]
    known += [(m, f, "embedding", F.lit(n)) for m, dims in (("user_tower", C.USER_TOWER_DIMS), ("video_tower", {
        **C.VIDEO_TOWER_DIMS, "title": C.TITLE_EMBEDDING_DIM, "tags": C.TAGS_EMBEDDING_DIM})) for f, n in dims.items()]
    known += [("ranker", f, kind, F.lit(1)) for kind, names in (("categorical", RANKER_STRINGS), ("numeric", RANKER_NUMERIC),
                                                                ("label", ["label"])) for f in names]
    rows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("feature"), F.lit(k).alias("kind"),
                              n.cast("bigint").alias("size")) for m, f, k, n in known])
    return users.sparkSession.range(1).select(F.explode(rows).alias("r")).select("r.*")


def vocabulary_sizes(vocabs: DataFrame) -> DataFrame:
    """E23, the sizes of vocabularies as they are built (E06): max index + 1
    → (model, feature, kind, size), model "shared"."""
    return vocabs.groupBy(F.col("vocab").alias("feature")).agg((F.max("idx") + 1).alias("size")).select(
        F.lit("shared").alias("model"), "feature", F.lit("vocabulary").alias("kind"), F.col("size").cast("bigint").alias("size"))
