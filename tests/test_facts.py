"""Tiny-frame facts from the reference's tests (labels, merge, CTR, A/B,
multi-query merge, blend, tiers, nearest neighbour, MMR, diversity)."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from recframe.functions import labels as L
from recframe.functions.scalar import blend_scores, channel_tier
from recframe.operators import experiments as X
from recframe.operators import feedback as FB
from recframe.operators import monitoring as M
from recframe.operators import recommend as RC
from recframe.operators import vectors as V


def test_label_rules(spark):
    df = spark.createDataFrame([("like", 0.0, 0.0), ("dislike", 0.0, 0.0), ("watch", 0.5, 60.0),
                                ("watch", 0.05, 10.0), ("watch", 0.25, 20.0), ("mystery", 1.0, 100.0)],
                               "t string, pct double, secs double")
    got = [r.l for r in df.select(L.rule_label("t", "pct", "secs").alias("l")).collect()]
    assert got == [1, 0, 1, 0, None, None]


def test_merge_ten_predictions_five_labels(spark):
    t0 = dt.datetime(2024, 1, 1)
    preds = spark.createDataFrame(
        [(f"inf_{i}", 1, [100, 101, 102], {100: 0.9, 101: 0.8, 102: 0.7}, t0, "v1", "e") for i in range(10)],
        "inference_id string, user_id long, recommended_video_ids array<long>, video_scores map<long,double>, "
        "ts timestamp_ntz, model_version string, experiment_id string")
    labels = spark.createDataFrame(
        [(f"labeled_{i}", i, f"inf_{i}", 1, 100, 1 if i % 2 == 0 else 0, "click" if i % 2 == 0 else "skip", 1.0,
          t0 + dt.timedelta(hours=1), 0.0, 0.0, 1) for i in range(5)],
        "interaction_id string, event_id long, inference_id string, user_id long, video_id long, label int, "
        "label_source string, label_confidence double, feedback_timestamp timestamp_ntz, watch_time_seconds double, "
        "watch_percentage double, position_shown int")
    m = FB.merge_predictions_labels(preds, labels)
    assert m.count() == 5
    st = {r.model_version: r for r in FB.merge_stats(m, labels).collect()}
    assert (st["ALL"].positive, st["ALL"].negative, st["ALL"].records_unmatched) == (3, 2, 0)
    assert {r.predicted_rank for r in m.collect()} == {1}


def test_ctr_ten_impressions_three_clicks(spark):
    rows = [(i, 1, 1, "impression", 0.0, 0.0, 1) for i in range(10)] + [(10 + i, 1, 1, "click", 0.0, 0.0, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "interaction_id long, user_id long, video_id long, interaction_type string, "
                                     "watch_time_seconds double, video_duration_seconds double, position_in_list int")
    assert abs(M.online_report(df).first().click_through_rate - 0.3) < 1e-12


def test_ab_assignment(spark):
    users = spark.range(10000).select(F.col("id"))
    v = [X.Variant("control", "v1", 0.5), X.Variant("treatment", "v2", 0.5)]
    a = X.ab_assign(users, "exp", v)
    share = a.where("variant = 'control'").count() / 10000
    assert 0.45 <= share <= 0.55
    again = X.ab_assign(users, "exp", v)
    assert a.join(again.withColumnRenamed("variant", "v2x"), "user_id").where("variant != v2x").count() == 0
    try:
        X.ab_assign(users, "exp", [X.Variant("a", "v1", 0.3), X.Variant("b", "v2", 0.3)])
        raise AssertionError("traffic 0.6 accepted")
    except ValueError:
        pass


def test_multi_query_merge(spark):
    rows = [(1, "q_primary", "primary", 0, 101, 0.9), (1, "q_primary", "primary", 0, 102, 0.8),
            (1, "q_primary", "primary", 0, 103, 0.7), (1, "q_cat_0", "category", 1, 101, 0.85),
            (1, "q_cat_0", "category", 1, 104, 0.75), (1, "q_cat_0", "category", 1, 105, 0.65)]
    df = spark.createDataFrame(rows, "user_id long, query_id string, query_type string, query_index int, video_id long, score double")
    m = RC.merge_query_scores(df, 100).orderBy("rank").collect()
    assert m[0].video_id == 101 and len(m) == 5 and m[0].sources == ["q_primary", "q_cat_0"]


def test_blend_and_tier(spark):
    r = spark.range(1).select(blend_scores(F.lit(0.8), F.lit(0.6)).alias("b"), channel_tier(F.lit(50000)).alias("t")).first()
    assert abs(r.b - 0.66) < 1e-12 and r.t == "small"


def test_nearest_neighbour_is_itself(spark):
    rng = np.random.default_rng(42)
    m = rng.standard_normal((100, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(100)], "id long, embedding array<float>")
    q = items.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    res = V.vector_topk_exact(q, items, 10).where("rank = 1").collect()
    assert all(r.query_id == r.item_id and abs(r.score - 1) < 0.01 for r in res) and len(res) == 5
    assert V.vector_topk_exact(q, items, 10).count() == 50


def test_mmr_matches_greedy(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for req in range(30):
        n = int(rng.integers(5, 25))
        scores = sorted(rng.random(n).round(3), reverse=True)
        cats = [f"c{int(c)}" for c in rng.integers(0, 4, n)]
        for i in range(n):
            rows.append((req, i, float(scores[i]), cats[i], i + 1))
        # reference greedy
        remaining = list(range(n))
        counts, sel = {}, []
        if n <= 6:
            sel = remaining
        else:
            while len(sel) < 6 and remaining:
                best, bi = -1e9, 0
                for idx, j in enumerate(remaining):
                    v = scores[j] - 0.1 * counts.get(cats[j], 0)
                    if v > best:
                        best, bi = v, idx
                j = remaining.pop(bi)
                sel.append(j)
                counts[cats[j]] = counts.get(cats[j], 0) + 1
        want[req] = sel
    df = spark.createDataFrame(rows, "request_id int, video_id int, score double, category string, rank int")
    got = {}
    for r in RC.mmr_by_category(df, 6, 0.1).orderBy("request_id", "final_rank").collect():
        got.setdefault(r.request_id, []).append(r.video_id)
    assert got == want


def test_diversity_sample_categories(spark):
    rows = [(1, 1, 0.9, "Music", 1), (1, 2, 0.85, "Music", 2), (1, 3, 0.8, "Music", 3), (1, 4, 0.75, "Sports", 4),
            (1, 5, 0.7, "Sports", 5), (1, 6, 0.65, "Gaming", 6)]
    df = spark.createDataFrame(rows, "request_id int, video_id int, score double, category string, rank int")
    out = RC.diversity_sample(df, 4, 3).orderBy("final_rank").collect()
    assert len(out) == 4 and len({r.category for r in out}) >= 2
    assert [r.video_id for r in out][:3] == [1, 4, 6]


def test_ivf_with_all_probes_equals_exact(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((200, 8))
    items = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(200)], "id long, embedding array<float>")
    q = items.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    exact = V.vector_topk_exact(q, items, 5).select("query_id", "item_id", "rank")
    ivf = V.vector_topk_ivf(q, items, 5, nlist=4, nprobe=4).select("query_id", "item_id", "rank")
    assert exact.exceptAll(ivf).count() == 0 and ivf.exceptAll(exact).count() == 0
    part = V.vector_topk_ivf(q, items, 5, nlist=4, nprobe=1)
    assert part.count() <= 50


def test_ivf_recall_against_exact(spark):
    from recframe.queries import q_vectors as Q
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        exact = Q.j14(spark, d).select("query_id", "item_id")
        found = Q.j15(spark, d).select("query_id", "item_id")
        n = exact.count()
        recall = exact.intersect(found).count() / n
        print("recall", d, n, recall)
        assert recall >= 0.9
