"""Queries: data quality, drift, online and performance monitoring."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from recframe.operators import monitoring as M
from recframe.queries.common import query, rounded
from recframe.sources import adapters as A

SPLIT = dt.datetime(2024, 1, 16)
NUM, CAT = ["age", "duration"], ["country", "category"]


def _fr(spark, d):
    f = A.feature_records(spark, d)
    return f.where(F.col("ts") >= F.lit(SPLIT)), f.where(F.col("ts") < F.lit(SPLIT))


def _log(spark, d):
    lg = A.inference_log(spark, d)
    return lg.where(F.col("ts") >= F.lit(SPLIT)), lg.where(F.col("ts") < F.lit(SPLIT))


def _quality(spark, d):
    cur, base = _fr(spark, d)
    cp, bp = M.profile_features(cur, NUM, CAT, False), M.profile_features(base, NUM, CAT, False)
    drift = M.numeric_drift(M.numeric_profile(cur, NUM, False), M.numeric_profile(base, NUM, False)).unionByName(
        M.psi_drift(M.value_counts(cur, CAT), M.value_counts(base, CAT)))
    return cp, bp, drift, M.quality_alerts(cp, drift, bp)


@query("a01_numeric_profile")
def a01(spark, d):
    return rounded(M.numeric_profile(A.feature_records(spark, d), NUM))


@query("a02_categorical_profile")
def a02(spark, d):
    return rounded(M.categorical_profile(A.feature_records(spark, d), CAT))


@query("k02_top_values")
def k02(spark, d):
    return M.top_values(M.value_counts(A.feature_records(spark, d), CAT), 10)


@query("a03_profile_features")
def a03(spark, d):
    return rounded(M.profile_features(A.feature_records(spark, d), NUM, CAT))


@query("j22_stat_vs_baseline")
def j22(spark, d):
    cur, base = _fr(spark, d)
    b = M.numeric_profile(base, NUM, False).select("feature", F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    return rounded(M.numeric_profile(cur, NUM, False).select("feature", "mean", "std").join(b, "feature", "left"))


@query("a34_numeric_drift")
def a34(spark, d):
    cur, base = _fr(spark, d)
    return rounded(M.numeric_drift(M.numeric_profile(cur, NUM, False), M.numeric_profile(base, NUM, False)))


@query("a35_psi_drift")
def a35(spark, d):
    cur, base = _fr(spark, d)
    return rounded(M.psi_drift(M.value_counts(cur, CAT), M.value_counts(base, CAT)))


@query("a36_quality_alerts")
def a36(spark, d):
    return rounded(_quality(spark, d)[3])


@query("a38_status")
def a38(spark, d):
    return M.status(_quality(spark, d)[3])


@query("a48_quality_report")
def a48(spark, d):
    cp, _, drift, alerts = _quality(spark, d)
    n = alerts.groupBy(F.col("feature_name").alias("feature")).agg(F.count(F.lit(1)).alias("n_alerts"))
    st = M.status(alerts).select(F.first("status")).scalar()
    out = (cp.select("feature", "feature_type", "count", "missing_rate").join(drift, "feature", "left")
           .join(n, "feature", "left").select("feature", "feature_type", "count", "missing_rate",
                                               F.coalesce("drift_score", F.lit(0.0)).alias("drift_score"),
                                               F.coalesce("n_alerts", F.lit(0)).cast("bigint").alias("n_alerts"),
                                               st.alias("status")))
    return rounded(out)


@query("a04_online_report")
def a04(spark, d):
    o = M.report_window(A.online_interactions(spark, d), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20))
    return rounded(M.online_report(o))


@query("a05_report_by_group")
def a05(spark, d):
    return rounded(M.report_by_group(A.online_interactions(spark, d)))


@query("a06_click_positions")
def a06(spark, d):
    return M.click_positions(A.online_interactions(spark, d))


@query("w11_report_window")
def w11(spark, d):
    o = A.online_interactions(spark, d)
    return M.report_window(o, dt.datetime(2024, 1, 29), dt.datetime(2024, 1, 30, 12)).select("interaction_id")


@query("a07_perf_metrics")
def a07(spark, d):
    return rounded(M.perf_metrics(A.inference_log(spark, d)))


@query("a08_metric_change")
def a08(spark, d):
    cur, base = _log(spark, d)
    return rounded(M.metric_changes(M.perf_metrics(cur), M.perf_metrics(base)))


@query("a37_perf_alerts")
def a37(spark, d):
    cur, base = _log(spark, d)
    return rounded(M.perf_alerts(M.perf_metrics(cur), M.perf_metrics(base)))


@query("a49_perf_report")
def a49(spark, d):
    cur, base = _log(spark, d)
    cm, bm = M.perf_metrics(cur), M.perf_metrics(base)
    al = M.perf_alerts(cm, bm)
    ch = M.metric_changes(cm, bm)
    row = cm.select("num_samples", "avg_total_latency_ms", "latency_p99_ms", "error_rate", "avg_final_score",
                    *[ch.where(F.col("metric") == k).select(F.first("value")).scalar().alias(k)
                      for k in ["latency_change", "error_rate_change"]],
                    al.select(F.count(F.lit(1))).scalar().alias("n_alerts"),
                    M.status(al).select(F.first("status")).scalar().alias("status"))
    return rounded(row)


@query("a43_latency_summary")
def a43(spark, d):
    return rounded(M.latency_summary(A.inference_log(spark, d)))


@query("a40_canary_gate")
def a40(spark, d):
    lg = A.inference_log(spark, d).withColumn(
        "window", F.least(F.floor((F.dayofmonth("ts") - 1) / 6), F.lit(4)).cast("int"))
    return rounded(M.canary_gate(lg))
