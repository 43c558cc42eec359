"""Queries: vocabularies, numeric transforms, feature transformers."""

from __future__ import annotations

from pyspark.sql import functions as F

from recframe.functions import labels as L
from recframe.operators import encoders as E
from recframe.operators import features as FT
from recframe.operators import interactions as I
from recframe.operators import vectors as V
from recframe.queries.common import query, rounded
from recframe.queries.q_labels import enriched
from recframe.queries.q_vectors import tag_vectors
from recframe.session import store
from recframe.sources import adapters as A


def pairs(spark, d, rows=None):
    """``rows``: the enriched interactions, where they are stored."""
    return I.two_tower_pairs(I.positives(rows if rows is not None else enriched(spark, d)), A.users(spark, d), A.videos(spark, d))


#: What a ranker row reads of an enriched interaction.
RANKER_COLUMNS = ("interaction_id", "user_id", "video_id", "device", "interaction_time_day", "interaction_time_hour", "is_positive")


def ranker_rows(spark, d, rows=None, users_first=False):
    e = (rows if rows is not None else enriched(spark, d)).select(*RANKER_COLUMNS[:-1], F.col("is_positive").cast("int").alias("label"))
    return FT.ranker_star_join(e, A.users(spark, d), A.videos(spark, d), A.channels(spark, d), users_first)


@query("e01_string_vocab")
def e01(spark, d):
    return E.string_vocab(A.videos(spark, d), "category", include_start=True, mask_value="-")


@query("e02_integer_vocab")
def e02(spark, d):
    return E.integer_vocab(A.interactions(spark, d), "video_id")


@query("e03_inverse_lookup")
def e03(spark, d):
    i = A.interactions(spark, d)
    v = E.integer_vocab(A.videos(spark, d), "id")
    seen = F.when(F.col("video_id") % 11 == 0, -1 - F.col("video_id")).otherwise(F.col("video_id"))  # ids that no catalogue has
    out = E.lookup_integer(i.select("interaction_id", seen.alias("video_id")), "video_id", v, "video_id_idx")
    return E.inverse_integer(out, "video_id_idx", v, "video_id_back")


@query("e04_hash_bucket")
def e04(spark, d):
    u = A.users(spark, d)
    return u.select("id", E.hash_bucket(F.concat(F.lit("user:"), F.col("id").cast("string")), 1000).alias("bucket"))


@query("e05_oov_vocab")
def e05(spark, d):
    return E.oov_vocab(A.users(spark, d), "id")


@query("e06_build_all_vocabs")
def e06(spark, d):
    return E.build_all_vocabs(A.users(spark, d), A.videos(spark, d))


@query("e07_apply_vocabs")
def e07(spark, d):
    v = E.build_all_vocabs(A.users(spark, d), A.videos(spark, d))
    p = pairs(spark, d).select("user_id", "video_id", "country", "user_language", "category", "popularity")
    cols = ["user_id", "video_id", "country", "user_language", "category", "popularity"]
    return E.apply_vocabs(p, v, cols).select("user_id", "video_id", *[f"{c}_idx" for c in cols])


@query("e08_zscore")
def e08(spark, d):
    v = A.videos(spark, d)
    z = E.ZScore.fit(v, "view_count")
    return rounded(v.select("id", z.transform("view_count").alias("z"))
                   .select("id", "z", z.inverse("z").alias("back")))


@query("e09_minmax")
def e09(spark, d):
    v = A.videos(spark, d)
    m = E.MinMax.fit(v, "duration", (-1.0, 1.0))
    return rounded(v.select("id", m.transform("duration").alias("scaled"))
                   .select("id", "scaled", m.inverse("scaled").alias("back")))


@query("e10_log_transform")
def e10(spark, d):
    v = A.videos(spark, d)
    t = E.LogTransform.fit(v, "view_count", base="10")
    return rounded(v.select("id", t.transform("view_count").alias("logv"))
                   .select("id", "logv", t.inverse("logv").alias("back")))


@query("e11_bucketize")
def e11(spark, d):
    v = A.videos(spark, d)
    qb = E.quantile_boundaries(v, "view_count", 5)
    return (v.withColumn("_b", qb)
            .select("id", E.bucketize("duration", FT.DURATION_BOUNDARIES).alias("duration_bucket"),
                    E.bucketize("view_count", F.col("_b")).alias("view_bucket")))


@query("e12_cyclical")
def e12(spark, d):
    i = A.interactions(spark, d)
    h = F.hour(L.event_time(F.col("ts_epoch")))
    s, c = E.cyclical(h, 24)
    return rounded(i.select("interaction_id", s.alias("hour_sin"), c.alias("hour_cos")))


@query("e13_compose")
def e13(spark, d):
    v = A.videos(spark, d)
    comp = E.Compose([E.LogTransform.fit, E.ZScore.fit]).fit(v, "view_count")
    return rounded(v.select("id", comp.transform("view_count").alias("value")))


@query("e14_user_features")
def e14(spark, d):
    return rounded(FT.user_features(pairs(spark, d), A.users(spark, d), A.videos(spark, d)))


@query("e15_video_features")
def e15(spark, d):
    return rounded(FT.video_features(pairs(spark, d), A.videos(spark, d), A.users(spark, d)))


@query("e15_video_embeddings")
def e15_embeddings(spark, d):
    """The vector half of the video row; titles and tags are embedded once a video."""
    v = A.videos(spark, d)
    titles = V.text_embedding(v, "title", "id", dim=64)
    tags = V.tag_embedding(v.select("id", FT.all_tags(F.col("manual_tags")).alias("tags")), tag_vectors(spark, d)).select(
        "id", F.col("tag_embedding").alias("embedding"))
    e = FT.video_embeddings(pairs(spark, d).select("user_id", "video_id"), titles, tags)
    return e.select("user_id", "video_id", *[F.transform(c, lambda x: F.round(x, 6)).alias(c) for c in ("title_embedding", "tag_embedding")])


@query("e26_transformed_pairs")
def e26(spark, d):
    return rounded(FT.pair_features(pairs(spark, d), A.users(spark, d), A.videos(spark, d)))


@query("j03_ranker_star_join")
def j03(spark, d):
    return ranker_rows(spark, d).select("interaction_id", "user_id", "video_id", "country", "age",
                                        "category", "video_duration", "channel_subscriber_count", "label")


def stored_ranker_rows(spark, d):
    """The joined rows, which the fits and the projection read again: stored once.
    The enriched rows are stored before, so that the exchanges of both do not lie on the disks at once."""
    e = store(enriched(spark, d).select(*RANKER_COLUMNS), "enriched")
    return store(ranker_rows(spark, d, e, users_first=True).drop("user_id", "video_id", "channel_id"), "ranker")


@query("e17_ranker_features")
def e17(spark, d):
    return rounded(FT.ranker_features(stored_ranker_rows(spark, d), keys=("interaction_id",)))


@query("e17_ranker_features_index")
def e17_index(spark, d):
    return rounded(FT.ranker_features(stored_ranker_rows(spark, d), keys=("interaction_id",), form="index"))


@query("e17_ranker_vocabs")
def e17_vocabs(spark, d):
    return FT.ranker_vocabs(ranker_rows(spark, d))


@query("e18_serving_features")
def e18(spark, d):
    r = ranker_rows(spark, d).select("interaction_id", "view_count", "like_count", "comment_count",
                                     "channel_subscriber_count", "interaction_time_hour", "video_duration")
    return rounded(FT.serving_features(r))


@query("e19_service_derived")
def e19(spark, d):
    r = ranker_rows(spark, d).select("interaction_id", "view_count", "like_count", "comment_count",
                                     "channel_subscriber_count", "video_duration")
    return rounded(FT.service_derived(r))


@query("e23_feature_specs")
def e23(spark, d):
    users, videos = A.users(spark, d), A.videos(spark, d)
    return FT.feature_specs(users, videos).unionByName(FT.vocabulary_sizes(E.build_all_vocabs(users, videos)))


@query("a23_normalization_stats")
def a23(spark, d):
    v = A.videos(spark, d)
    u = A.users(spark, d)
    vs = E.normalization_stats(v, ["duration", "view_count", "like_count", "comment_count"],
                               ["view_count", "like_count", "comment_count"])
    return rounded(vs.unionByName(E.normalization_stats(u, ["age"])))
