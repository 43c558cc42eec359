"""Queries: dataset shaping, records, counts, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from recframe.functions import labels as L
from recframe.functions.scalar import one_hot, parse_tags, safe_ratio
from recframe.operators import datasets as DS
from recframe.operators import encoders as E
from recframe.operators import feedback as FB
from recframe.operators import ranking as R
from recframe.operators import sampling as S
from recframe.operators.ordering import dense_index
from recframe.queries.common import query, rounded
from recframe.queries.q_encoders import RANKER_COLUMNS, pairs, ranker_rows
from recframe.queries.q_labels import enriched
from recframe.queries.q_ranking import scored
from recframe.session import store
from recframe.sources import adapters as A


@query("p01_canonicalise")
def p01(spark, d):
    u = DS.canonicalise(A.users(spark, d), "users")
    v = DS.canonicalise(A.videos(spark, d), "videos")
    return u.select("user_id", "country", "user_language").join(
        v.select(F.col("video_id").alias("user_id"), "video_duration", "video_language", "tags"), "user_id", "left")


def _j05(spark, d):
    i = A.interactions(spark, d).select("interaction_id", "user_id", "video_id", "interaction_type")
    u = DS.canonicalise(A.users(spark, d), "users").withColumnRenamed("user_language", "language")
    v = DS.canonicalise(A.videos(spark, d), "videos").select("video_id", "category", F.col("video_language").alias("language"),
                                                          "video_duration", "view_count", "like_count", "comment_count",
                                                          "popularity")
    return DS.preprocess_join(i, u, v)


@query("j05_preprocess_join")
def j05(spark, d):
    return _j05(spark, d).select("interaction_id", "country", "language", "age", "category", "language_video")


@query("p21_two_tower_columns")
def p21(spark, d):
    return DS.two_tower_columns(pairs(spark, d).withColumn("extra", F.lit(1)))


@query("p22_split_xy")
def p22(spark, d):
    p = pairs(spark, d).select("user_id", "video_id", parse_tags("tags").alias("tags"),
                               (F.col("age") > 40).cast("int").alias("label"))
    x, _ = DS.split_xy(p)
    return x


@query("p23_train_feature_select")
def p23(spark, d):
    r = ranker_rows(spark, d).drop("interaction_id", "channel_id")
    return DS.train_feature_select(r)


@query("p24_mask_sensitive")
def p24(spark, d):
    from recframe.sources.tables import load_table
    docs = load_table(spark, d, "documents")
    rec = docs.select("doc_id", "text", F.struct(F.col("source").alias("auth_token"), F.col("lang").alias("language")).alias("headers"),
                      F.create_map(F.lit("api_key"), F.col("source"), F.lit("lang"), F.col("lang")).alias("params"),
                      F.col("lang").alias("user_password"))
    m = DS.mask_sensitive(rec)
    return m.select("doc_id", F.length("text").alias("text_len"), F.substring("text", 995, 40).alias("text_tail"),
                    F.col("headers.auth_token").alias("headers_auth"), F.col("headers.language").alias("headers_lang"),
                    F.col("params")["api_key"].alias("params_api_key"), F.col("params")["lang"].alias("params_lang"),
                    "user_password")


@query("p27_build_interaction")
def p27(spark, d):
    o = A.online_interactions(spark, d)
    o = o.withColumn("interaction_type", F.when(F.col("interaction_type") == "like", "watch").otherwise(F.col("interaction_type")))
    return rounded(DS.build_interactions(o))


@query("p28_lookup_by_request")
def p28(spark, d):
    fb = A.feedback(spark, d)
    first = fb.select(F.min("inference_id")).scalar()
    return fb.where(F.col("inference_id") == first).select("feedback_id", "inference_id", "video_id")


@query("r05_track_inference")
def r05(spark, d):
    p = A.predictions(spark, d).select("request_id", "user_id", "recommended_video_ids", "ts")
    pred, log = FB.track_inference(p)
    return log


@query("r05_tracked_predictions")
def r05_predictions(spark, d):
    p = A.predictions(spark, d).select("request_id", "user_id", "recommended_video_ids", "ts", "model_version", "experiment_id")
    return FB.track_inference(p)[0]


@query("r06_capture_from_response")
def r06(spark, d):
    return DS.capture_record(A.inference_log(spark, d))


@query("a44_tag_frequency")
def a44(spark, d):
    v = A.videos(spark, d)
    return (v.select(F.explode(parse_tags("manual_tags")).alias("tag")).groupBy("tag")
            .agg(F.count(F.lit(1)).alias("count")).where(F.col("count") >= 2))


@query("a45_user_item_sets")
def a45(spark, d):
    e = enriched(spark, d).where("is_positive")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set("video_id")).alias("positive_videos"))


@query("a50_catalogue_counts")
def a50(spark, d):
    # counted, paired and joined: enriched and stored once
    e = store(enriched(spark, d).select(*RANKER_COLUMNS, "ts_epoch", "previously_watched_category"), "enriched")
    return DS.catalogue_counts({"users": (A.users(spark, d), "id"), "videos": (A.videos(spark, d), "id"),
                                "channels": (A.channels(spark, d), "id"),
                                "interactions": (A.interactions(spark, d), "interaction_id"),
                                "positive_interactions": (e.where("is_positive"), "interaction_id")},
                               {"two_tower": (S.bernoulli_split(pairs(spark, d, e), ["user_id", "video_id"]), "user_id"),
                                "ranker": (S.bernoulli_split(ranker_rows(spark, d, e, users_first=True), ["interaction_id"]), "interaction_id")})


@query("f07_watch_percentage")
def f07(spark, d):
    fb = A.feedback(spark, d)
    return rounded(fb.select("feedback_id", L.watch_percentage("watch_time_seconds", "video_duration_seconds").alias("watch_percentage")))


@query("f09_one_hot_popularity")
def f09(spark, d):
    from recframe import constants as C
    v = A.videos(spark, d)
    return v.select("id", *one_hot("popularity", C.POPULARITY_LEVELS))


@query("f10_engagement_ratios")
def f10(spark, d):
    r = ranker_rows(spark, d)
    return rounded(r.select("interaction_id", safe_ratio("like_count", "view_count").alias("like_ratio"),
                            safe_ratio("comment_count", "view_count").alias("comment_ratio"),
                            safe_ratio("like_count", "channel_subscriber_count").alias("engagement_rate")))


@query("k06_sorted_vocab")
def k06(spark, d):
    return dense_index(A.interactions(spark, d), "device", 0)


@query("e24_preprocess_job")
def e24(spark, d):
    users = DS.canonicalise(A.users(spark, d), "users")
    videos = DS.canonicalise(A.videos(spark, d), "videos")
    vocabs = E.build_all_vocabs(A.users(spark, d), A.videos(spark, d))
    stats = E.normalization_stats(videos, ["video_duration", "view_count", "like_count", "comment_count"],
                                  ["view_count", "like_count", "comment_count"]).unionByName(
        E.normalization_stats(users, ["age"]))
    i = A.interactions(spark, d).select("interaction_id", "user_id", "video_id")
    # users and videos are encoded before they meet the interactions, which are exchanged once for each
    cols = ["user_id", "video_id", "country", "user_language", "category", "video_language", "popularity"]
    of_user, of_video = ["user_id", "country", "user_language"], ["video_id", "category", "video_language", "popularity"]
    u = E.apply_vocabs(users, vocabs, of_user).select("user_id", *[f"{c}_idx" for c in of_user], "age")
    v = E.apply_vocabs(videos, vocabs, of_video).select(
        "video_id", *[f"{c}_idx" for c in of_video], "video_duration", "view_count", "like_count", "comment_count")
    out = DS.preprocess_join(i, u, v)
    known = [F.coalesce(F.col(f"{c}_idx"), F.lit(1).cast("bigint")).alias(f"{c}_idx") for c in cols]  # without its user or video: unknown
    norm = []
    for c in ["age", "video_duration", "view_count", "like_count", "comment_count"]:
        st = stats.where(F.col("feature") == c)
        m, s = st.select(F.first("mean")).scalar(), st.select(F.first("std")).scalar()
        norm.append(((F.col(c) - m) / s).alias(f"{c}_normalized"))
    return rounded(out.select("interaction_id", *known, *norm))


@query("a39_deploy_gate")
def a39(spark, d):
    s = scored(spark, d)
    k = 10
    top = R.rank_topk(s, k)
    rel = s.groupBy("query_id").agg(F.sum("label").alias("_rel"))
    hit = top.groupBy("query_id").agg(F.sum("label").alias("_hit"))
    recall = hit.join(rel, "query_id").where("_rel > 0").select(F.avg(F.col("_hit") / F.col("_rel"))).scalar()
    ndcg = R.ndcg_at_k(s, k).select(F.avg("ndcg")).scalar()
    auc = R.auc(s).select(F.first("auc")).scalar()
    row = s.sparkSession.range(1).select(recall.alias("recall_at_k"), ndcg.alias("ndcg"), auc.alias("auc"))
    tt_pass = (F.col("recall_at_k") >= 0.1) & (F.col("ndcg") >= 0.3)
    rk_pass = (F.col("auc") >= 0.6) & (F.col("ndcg") >= 0.3)
    def reason(parts):
        return F.concat_ws(", ", *[F.when(cond, F.format_string(fmt, F.col(c))) for cond, fmt, c in parts])
    tt_reason = reason([(F.col("recall_at_k") < 0.1, "recall@k (%.4f) < 0.1", "recall_at_k"),
                        (F.col("ndcg") < 0.3, "ndcg (%.4f) < 0.3", "ndcg")])
    rk_reason = reason([(F.col("auc") < 0.6, "auc (%.4f) < 0.6", "auc"), (F.col("ndcg") < 0.3, "ndcg (%.4f) < 0.3", "ndcg")])
    return rounded(row.select("*", tt_pass.alias("two_tower_passed"), rk_pass.alias("ranker_passed"),
                              (tt_pass & rk_pass).alias("should_deploy"),
                              F.when(~tt_pass, tt_reason).alias("two_tower_reason"),
                              F.when(~rk_pass, rk_reason).alias("ranker_reason")))


@query("j24_item_feature_table")
def j24(spark, d):
    unknown = F.when(F.col("id") % 10 == 3, -1 - F.col("channel_id")).otherwise(F.col("channel_id"))  # no such channel → 0 subscribers
    return DS.item_feature_table(A.videos(spark, d).withColumn("channel_id", unknown), A.channels(spark, d))
