"""Hand-made ranking facts (the reference's unit-test numbers)."""

import math

from recframe.operators import ranking as R


def lists(spark, rows):
    return spark.createDataFrame(rows, "query_id int, item_id int, score double, label double")


def one(spark, labels, scores, qid=1):
    return [(qid, i, s, float(l)) for i, (l, s) in enumerate(zip(labels, scores))]


S5 = [.9, .8, .7, .2, .1]


def test_precision_at_k(spark):
    assert R.precision_at_k(lists(spark, one(spark, [1, 1, 1, 0, 0], S5)), 3).first()["precision"] == 1.0
    p = R.precision_at_k(lists(spark, one(spark, [1, 0, 1, 0, 1], S5)), 3).first()["precision"]
    assert abs(p - 2 / 3) < 1e-9
    two = one(spark, [1, 1, 0, 0], [.9, .8, .2, .1], 1) + one(spark, [0, 1, 0, 1], [.9, .8, .2, .1], 2)
    m = R.precision_at_k(lists(spark, two), 2).agg({"precision": "avg"}).first()[0]
    assert abs(m - 0.75) < 1e-9


def test_mrr(spark):
    assert R.mrr(lists(spark, one(spark, [1, 0, 0, 0, 0], S5))).first()["mrr"] == 1.0
    assert abs(R.mrr(lists(spark, one(spark, [0, 0, 1, 0, 0], S5))).first()["mrr"] - 1 / 3) < 1e-9
    assert R.mrr(lists(spark, one(spark, [0, 0, 0, 0, 0], S5))).first()["mrr"] == 0.0


def test_ndcg(spark):
    assert abs(R.ndcg_at_k(lists(spark, one(spark, [3, 2, 1, 0, 0], S5)), 3).first()["ndcg"] - 1.0) < 1e-9
    assert R.ndcg_at_k(lists(spark, one(spark, [0, 0, 1, 2, 3], S5)), 3).first()["ndcg"] < 1.0


def test_map(spark):
    assert abs(R.map_at_k(lists(spark, one(spark, [1, 1, 0, 0, 0], S5)), None).first()["map"] - 1.0) < 1e-9
    assert abs(R.map_at_k(lists(spark, one(spark, [1, 0, 1, 0, 0], S5)), None).first()["map"] - 5 / 6) < 1e-9


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "score double, label int")
    # sklearn roc_auc_score on the same data = 0.8333…
    assert abs(R.auc(df).first()["auc"] - 0.75) < 1e-9, R.auc(df).collect()
    one_class = spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")
    assert R.auc(one_class).first()["auc"] == 0.0


def test_topk_plans_window_group_limit(spark):
    df = lists(spark, one(spark, [1, 0, 1, 0, 1], S5))
    plan = R.rank_topk(df, 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan or "AdaptiveSparkPlan" in plan
    assert math.isclose(len(R.rank_topk(df, 2).collect()), 2)
