"""Index form and vectors of feature rows, input sizes, experiment reports
without data, factors of ids beyond 32 bits, attribution beyond the newest hundred."""

import datetime as dt

from pyspark.sql import functions as F

from recframe import constants as C
from recframe.operators import datasets as DS
from recframe.operators import encoders as E
from recframe.operators import experiments as X
from recframe.operators import features as FT
from recframe.operators import feedback as FB
from recframe.operators import models as M

RANKER = ("user_id long, video_id long, country string, user_language string, category string, child_categories string, "
          "video_language string, device string, interaction_time_day string, popularity string, age int, video_duration int, "
          "view_count long, like_count long, comment_count long, channel_subscriber_count long, interaction_time_hour int, label int")


def row(user, country, popularity, children="a|b"):
    return (user, user, country, "en", "music", children, "en", "Mobile", "Monday", popularity, 30, 300, 100, 10, 1, 50, 12, 1)


def test_index_form_gives_places_in_the_fitted_vocabularies(spark):
    fit = spark.createDataFrame([row(1, "FR", "low"), row(2, "DE", "high", "c"), row(3, None, "low", None)], RANKER)
    seen = spark.createDataFrame([row(1, "DE", "viral"), row(2, "FR", "odd"), row(3, "XX", None), row(4, None, "low")], RANKER)
    got = {r.user_id: r for r in FT.ranker_features(seen, fit, form="index").collect()}
    assert [got[i].country_idx for i in (1, 2, 3, 4)] == [2, 3, 1, 0]
    assert [got[i].popularity_idx for i in (1, 2, 3, 4)] == [5, 1, 0, 3]  # sorted levels: high, low, medium, viral
    assert "country" not in got[1].asDict() and "child_categories" not in got[1].asDict()
    text = {r.user_id: r for r in FT.ranker_features(seen, fit).collect()}
    assert all(got[i][c] == text[i][c] for i in got for c in FT.RANKER_NUMERIC)
    voc = {(r.vocab, r.value): r.idx for r in FT.ranker_vocabs(fit).collect()}
    assert [voc["child_categories", v] for v in ("[PAD]", "[UNK]", "a", "b", "c")] == [0, 1, 2, 3, 4]


def test_index_form_of_an_empty_fit(spark):
    seen = spark.createDataFrame([row(1, "DE", "low")], RANKER)
    got = FT.ranker_features(seen, seen.limit(0), form="index").first()
    assert (got.country_idx, got.device_idx, got.popularity_idx) == (1, 1, 3)


def test_video_vectors_are_zero_where_missing(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "video_id long")
    titles = spark.createDataFrame([(1, [0.5, 0.25]), (7, [1.0, 1.0])], "id long, embedding array<float>")
    none = titles.limit(0)
    got = {r.video_id: (r.title_embedding, r.tag_embedding) for r in FT.video_embeddings(rows, titles, none).collect()}
    assert got == {1: ([0.5, 0.25], []), 2: ([0.0, 0.0], []), None: ([0.0, 0.0], [])}
    assert spark.range(1).select(FT.all_tags(F.lit("a|b"), F.lit("c"))).first()[0] == "a|b|c"


def test_sizes_equal_the_fitted_vocabularies(spark):
    users = spark.createDataFrame([(1, "FR", "en"), (2, "DE", "fr"), (3, None, None)], "id long, country_code string, preferred_language string")
    videos = spark.createDataFrame([(1, "a", "en"), (2, "-", "it"), (3, "b", None)], "id long, category string, language string")
    size = {(r.model, r.feature): r.size for r in FT.feature_specs(users, videos).where("kind = 'vocabulary'").collect()}

    def top(v):
        return v.agg(F.max("idx") + 1).first()[0]
    assert size["user_tower", "user_id"] == top(E.integer_vocab(users, "id"))
    assert size["user_tower", "country"] == top(E.string_vocab(users, "country_code"))
    assert size["user_tower", "language"] == top(E.string_vocab(FT._languages(users, videos), "v"))
    assert size["user_tower", "category"] == top(E.string_vocab(videos, "category", include_start=True, mask_value="-"))
    assert size["video_tower", "category"] == top(E.string_vocab(videos, "category"))
    assert size["video_tower", "popularity"] == len(C.POPULARITY_LEVELS) + 2


def test_split_sizes(spark):
    df = spark.createDataFrame([(1, "train"), (1, "train"), (2, "val")], "id long, split string")
    got = {r.table: (r.rows, r.distinct_ids) for r in DS.catalogue_counts({"all": (df, "id")}, {"part": (df, "id")}).collect()}
    assert got == {"all": (3, 2), "part_train": (2, 1), "part_val": (1, 1)}


T0 = dt.datetime(2024, 1, 1)
ONLINE = ("interaction_id long, user_id long, experiment_id string, model_version string, interaction_type string, "
          "watch_time_seconds double, ts timestamp_ntz")


def clicks(spark, per_version):
    """users x (model version, of whom click)"""
    rows = [(0, u, "e", v, t, 0.0, T0 + dt.timedelta(hours=u % 3)) for v, n, c in per_version for u in range(n)
            for t in (["impression", "click"] if u < c else ["impression"])]
    return spark.createDataFrame(rows, ONLINE)


def test_experiment_reports(spark):
    a, b, c = X.Variant("a", "v1", 0.4), X.Variant("b", "v2", 0.3), X.Variant("c", "v3", 0.3)
    both = clicks(spark, [("v1", 150, 10), ("v2", 150, 60)])
    none = X.experiment_report(both, "other", [a, b]).first()
    assert (none.recommendation, none.p_value, none.duration_hours, none.start_time) == ("Insufficient data for analysis", 1.0, 0.0, None)
    won = X.experiment_report(both, "e", [a, b]).first()
    assert won.is_significant and won.winner == "b" and won.duration_hours == 2.0 and abs(won.relative_improvement - 5.0) < 1e-9
    assert won.recommendation.startswith("Recommend deploying 'b' (+500.0% click_through_rate")
    # a variant without any interaction counts as one with too few, in the order given
    lone = X.experiment_report(clicks(spark, [("v1", 150, 10)]), "e", [a, b]).first()
    assert lone.recommendation == "Continue experiment: b has only 0/100 required samples"
    few = X.experiment_report(clicks(spark, [("v1", 3, 1), ("v2", 5, 1)]), "e", [b, a]).first()
    assert few.recommendation == "Continue experiment: b has only 5/100 required samples"
    # with three variants nothing is tested
    three = X.experiment_report(clicks(spark, [("v1", 150, 10), ("v2", 150, 60), ("v3", 150, 60)]), "e", [a, b, c]).first()
    assert (three.p_value, three.is_significant) == (1.0, False) and three.recommendation.startswith("No significant difference")


def test_factors_of_ids_beyond_32_bits(spark):
    big = 1 << 40
    pos = spark.createDataFrame([(big + u, big * 3 + v) for u in range(6) for v in range(5) if (u + v) % 2] + [(None, 1)], "user_id long, video_id long")
    users, items = M.retrieval_factors(pos, rank=4, max_iter=2)
    assert sorted(r.user_id for r in users.collect()) == [big + u for u in range(6)]
    assert sorted(r.video_id for r in items.collect()) == [big * 3 + v for v in range(5)]
    assert len(users.first().embedding) == 4


def test_attribution_beyond_the_newest_hundred(spark):
    preds = spark.createDataFrame([(f"p{i}", 1, [7] if i == 0 else [8], T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(days=9)) for i in range(120)],
                                  "inference_id string, user_id long, recommended_video_ids array<long>, ts timestamp_ntz, expires_at timestamp_ntz")
    fb = spark.createDataFrame([(1, 1, 7, T0 + dt.timedelta(hours=3))], "feedback_id long, user_id long, video_id long, ts timestamp_ntz")
    assert FB.attribute_feedback(fb, preds, T0).first().attributed_inference_id is None
    assert FB.attribute_feedback(fb, preds, T0, newest=None).first().attributed_inference_id == "p0"


def test_tracked_predictions_keep_their_columns(spark):
    p = spark.createDataFrame([("r", 1, [3, 4], T0, "v1")], "request_id string, user_id long, recommended_video_ids array<long>, ts timestamp_ntz, model_version string")
    pred, log = FB.track_inference(p)
    assert pred.first().expires_at == T0 + dt.timedelta(hours=48) and pred.first().model_version == "v1"
    assert (log.first().inference_id, log.first().num_recommendations) == (pred.first().inference_id, 2)
