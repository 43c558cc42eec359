"""Monitoring: data quality, drift, online metrics, performance (A01–A08,
A34–A38, A40, A43, A48, A49, J22, K02, W11).

Every statistic is one aggregate over an unpivoted (feature, value) table;
percentiles are exact (``exact_quantiles``), never a single-task buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe import constants as C
from recframe.operators.ordering import exact_quantiles

PCTS = [1, 5, 25, 50, 75, 95, 99]


def _unpivot(df: DataFrame, features: list[str], cast: str) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast(cast).alias("value")) for f in features])).alias("r")
    ).select("r.*")


def numeric_profile(df: DataFrame, features: list[str], percentiles: bool = True) -> DataFrame:
    """Count, missing (NULL or NaN), missing rate, mean, population std,
    min, max and p1 … p99 (linear) per feature; all-missing → rate 1.0.
    ``percentiles=False`` skips the exact-percentile pass (drift and alerts
    only read the moments)."""
    present = [f for f in features if f in df.columns]  # A03: absent features skipped
    long = _unpivot(df, present, "double")
    valid = F.col("value").isNotNull() & ~F.isnan("value")
    base = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"),
        F.count(F.when(~valid | F.col("value").isNull(), 1)).alias("missing_count"),
        F.avg(F.when(valid, F.col("value"))).alias("mean"),
        F.stddev_pop(F.when(valid, F.col("value"))).alias("std"),
        F.min(F.when(valid, F.col("value"))).alias("min_value"),
        F.max(F.when(valid, F.col("value"))).alias("max_value"))
    base = base.withColumn("missing_rate", F.col("missing_count") / F.col("count"))
    if not percentiles:
        return base
    q = exact_quantiles(long.where(valid), "value", [p / 100 for p in PCTS], ["feature"])
    wide = q.groupBy("feature").pivot("q", [p / 100 for p in PCTS]).agg(F.first("value"))
    wide = wide.select("feature", *[F.col(f"`{p / 100}`").alias(f"p{p}") for p in PCTS])
    return base.join(wide, "feature", "left")


def value_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, count) of the non-null values, as text."""
    present = [f for f in features if f in df.columns]
    long = _unpivot(df, present, "string")
    return long.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n most common values per feature (count desc, value asc)."""
    from pyspark.sql import Window
    w = Window.partitionBy("feature").orderBy(F.col("count").desc(), F.col("value").asc())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def categorical_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, missing, missing rate, unique count per feature."""
    present = [f for f in features if f in df.columns]
    long = _unpivot(df, present, "string")
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("count"),
        F.count(F.when(F.col("value").isNull(), 1)).alias("missing_count"),
        F.count_distinct("value").alias("unique_count")).withColumn(
        "missing_rate", F.col("missing_count") / F.col("count"))


def profile_features(df: DataFrame, numeric: list[str], categorical: list[str],
                     percentiles: bool = True) -> DataFrame:
    """Numeric and categorical profiles in one long table."""
    n = numeric_profile(df, numeric, percentiles).withColumn("feature_type", F.lit("numerical")) \
        .withColumn("unique_count", F.lit(0).cast("bigint"))
    c = categorical_profile(df, categorical).withColumn("feature_type", F.lit("categorical"))
    return n.unionByName(c, allowMissingColumns=True)


def numeric_drift(cur: DataFrame, base: DataFrame) -> DataFrame:
    """J22 + A34: d = |μ − μ₀| / σ₀, drift = min(1 − 1/(1+d), 1); 0 when σ₀ = 0."""
    b = base.select("feature", F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    j = cur.select("feature", "mean").join(b, "feature")
    d = F.abs(F.col("mean") - F.col("base_mean")) / F.col("base_std")
    return j.select("feature", F.when(F.col("base_std") == 0, F.lit(0.0))
                    .otherwise(F.least(1 - 1 / (1 + d), F.lit(1.0))).alias("drift_score"))


def psi_drift(cur_counts: DataFrame, base_counts: DataFrame) -> DataFrame:
    """PSI over the union of categories (full outer join), shares floored
    at 1e-4, scaled by 1/0.5 and capped at 1."""
    c = cur_counts.select("feature", "value", F.col("count").alias("c"))
    b = base_counts.select("feature", "value", F.col("count").alias("b"))
    j = c.join(b, ["feature", "value"], "full_outer")
    tot_c = c.groupBy("feature").agg(F.sum("c").alias("tc"))
    tot_b = b.groupBy("feature").agg(F.sum("b").alias("tb"))
    j = j.join(tot_c, "feature").join(tot_b, "feature")
    cp = F.greatest(F.coalesce(F.col("c"), F.lit(0)) / F.col("tc"), F.lit(C.PSI_FLOOR))
    bp = F.greatest(F.coalesce(F.col("b"), F.lit(0)) / F.col("tb"), F.lit(C.PSI_FLOOR))
    psi = j.groupBy("feature").agg(F.sum((cp - bp) * F.log(cp / bp)).alias("psi"))
    return psi.select("feature", F.least(F.col("psi") / C.PSI_SCALE, F.lit(1.0)).alias("drift_score"))


def quality_alerts(cur_profile: DataFrame, drift: DataFrame, base_profile: DataFrame | None) -> DataFrame:
    """Missing rate > 5 % (warning), drift > 0.3 (warning), categorical
    cardinality change > 20 % when the baseline has values (info)."""
    cols = ["alert_type", "severity", "feature_name", "current_value", "threshold"]
    miss = cur_profile.where(F.col("missing_rate") > C.MISSING_RATE_WARN).select(
        F.lit("high_missing_rate").alias("alert_type"), F.lit("warning").alias("severity"),
        F.col("feature").alias("feature_name"), F.col("missing_rate").cast("double").alias("current_value"),
        F.lit(C.MISSING_RATE_WARN).alias("threshold"))
    dr = drift.where(F.col("drift_score") > C.DRIFT_WARN).select(
        F.lit("feature_drift").alias("alert_type"), F.lit("warning").alias("severity"),
        F.col("feature").alias("feature_name"), F.col("drift_score").alias("current_value"),
        F.lit(C.DRIFT_WARN).alias("threshold"))
    out = miss.unionByName(dr)
    if base_profile is not None:
        b = base_profile.select("feature", F.col("unique_count").alias("bu"))
        j = cur_profile.select("feature", "unique_count").join(b, "feature").where(F.col("bu") > 0)
        ch = F.abs(F.col("unique_count") - F.col("bu")) / F.col("bu")
        out = out.unionByName(j.where(ch > C.CARDINALITY_CHANGE_INFO).select(
            F.lit("cardinality_change").alias("alert_type"), F.lit("info").alias("severity"),
            F.col("feature").alias("feature_name"), F.col("unique_count").cast("double").alias("current_value"),
            F.lit(C.CARDINALITY_CHANGE_INFO).alias("threshold")))
    return out.select(*cols)


def status(alerts: DataFrame) -> DataFrame:
    """Critical if any critical alert, degraded if any warning, else healthy."""
    rank = F.when(F.col("severity") == "critical", 2).when(F.col("severity") == "warning", 1).otherwise(0)
    m = alerts.agg(F.max(rank).alias("r"))
    return m.select(F.when(F.col("r") == 2, "critical").when(F.col("r") == 1, "degraded")
                    .otherwise("healthy").alias("status"))


# --- online interaction metrics -----------------------------------------------

def report_window(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Start ≤ ts ≤ end (closed on both ends)."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) <= F.lit(end)))


def completion_rate_col() -> Column:
    t = F.col("interaction_type")
    return (F.when(t == "complete", F.lit(1.0))
            .when((t == "watch") & (F.col("video_duration_seconds") > 0),
                  F.col("watch_time_seconds") / F.col("video_duration_seconds"))
            .otherwise(F.lit(0.0)))


def online_report(df: DataFrame) -> DataFrame:
    """Volume, CTR, watch time over watch ∪ complete, mean positive
    completion rate, mean click position (> 0), like rate."""
    t = F.col("interaction_type")
    watchy = t.isin("watch", "complete")
    cr = completion_rate_col()
    imp = F.count(F.when(t == "impression", 1))
    clk = F.count(F.when(t == "click", 1))
    likes = F.count(F.when(t == "like", 1))
    dis = F.count(F.when(t == "dislike", 1))
    return df.agg(
        imp.alias("total_impressions"), clk.alias("total_clicks"),
        F.count(F.when(t == "complete", 1)).alias("total_completions"),
        F.count_distinct("user_id").alias("unique_users"), F.count_distinct("video_id").alias("unique_videos"),
        F.when(imp > 0, clk / imp).otherwise(F.lit(0.0)).alias("click_through_rate"),
        F.coalesce(F.avg(F.when(watchy, F.col("watch_time_seconds"))), F.lit(0.0)).alias("avg_watch_time_seconds"),
        (F.coalesce(F.sum(F.when(watchy, F.col("watch_time_seconds"))), F.lit(0.0)) / 3600).alias("total_watch_time_hours"),
        F.coalesce(F.avg(F.when(watchy & (cr > 0), cr)), F.lit(0.0)).alias("completion_rate"),
        F.coalesce(F.avg(F.when((t == "click") & (F.col("position_in_list") > 0), F.col("position_in_list"))),
                   F.lit(0.0)).alias("avg_click_position"),
        likes.alias("total_likes"), dis.alias("total_dislikes"),
        F.when(likes + dis > 0, likes / (likes + dis)).otherwise(F.lit(0.0)).alias("like_rate"))


def report_by_group(df: DataFrame) -> DataFrame:
    """Impressions, clicks, CTR, completions by model_version and by
    experiment_id (GROUPING SETS); empty / NULL keys skipped."""
    t = F.col("interaction_type")
    g = df.groupingSets([["model_version"], ["experiment_id"]], "model_version", "experiment_id").agg(
        F.count(F.when(t == "impression", 1)).alias("impressions"),
        F.count(F.when(t == "click", 1)).alias("clicks"),
        F.count(F.when(t == "complete", 1)).alias("completions"),
        F.grouping_id().alias("_gid"))
    out = g.select(F.when(F.col("_gid") == 1, "model_version").otherwise("experiment_id").alias("group_type"),
                   F.when(F.col("_gid") == 1, F.col("model_version")).otherwise(F.col("experiment_id")).alias("group_value"),
                   "impressions", "clicks",
                   F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(F.lit(0.0)).alias("ctr"),
                   "completions")
    return out.where(F.col("group_value").isNotNull() & (F.col("group_value") != ""))


def click_positions(df: DataFrame) -> DataFrame:
    """Histogram of click positions > 0."""
    return (df.where((F.col("interaction_type") == "click") & (F.col("position_in_list") > 0))
            .groupBy(F.col("position_in_list").alias("position")).agg(F.count(F.lit(1)).alias("count")))


# --- performance ----------------------------------------------------------------

def perf_metrics(log: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Samples, mean #recs, stage / total latency means, exact p50 / p95 /
    p99, errors (no recommendations), mean retrieval / ranker / final score."""
    g = list(group or [])
    n_recs = F.size("recommendations")
    base = log.groupBy(*g).agg(
        F.count(F.lit(1)).alias("num_samples"), F.avg(n_recs).alias("avg_num_recommendations"),
        F.coalesce(F.avg("retrieval_latency_ms"), F.lit(0.0)).alias("avg_retrieval_latency_ms"),
        F.coalesce(F.avg("ranking_latency_ms"), F.lit(0.0)).alias("avg_ranking_latency_ms"),
        F.avg("inference_latency_ms").alias("avg_total_latency_ms"),
        F.count(F.when(n_recs == 0, 1)).alias("error_count"),
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    base = base.withColumn("error_rate", F.col("error_count") / F.col("num_samples"))
    q = exact_quantiles(log, "inference_latency_ms", [0.5, 0.95, 0.99], g)
    qw = q.groupBy(*g).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(f"latency_p{int(p * 100)}_ms")
                             for p in [0.5, 0.95, 0.99]])
    recs = log.select(*g, F.explode("recommendations").alias("r"))
    sc = recs.groupBy(*g).agg(F.coalesce(F.avg("r.retrieval_score"), F.lit(0.0)).alias("avg_retrieval_score"),
                              F.coalesce(F.avg("r.ranker_score"), F.lit(0.0)).alias("avg_ranker_score"),
                              F.coalesce(F.avg("r.score"), F.lit(0.0)).alias("avg_final_score"))
    if g:
        out = base.join(qw, g, "left").join(sc, g, "left")
    else:
        out = base.select("*", *[qw.select(F.first(c)).scalar().alias(c) for c in qw.columns],
                          *[sc.select(F.first(c)).scalar().alias(c) for c in sc.columns])
    for c in ["avg_retrieval_score", "avg_ranker_score", "avg_final_score"]:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return out


def _change(cur: Column, base: Column) -> Column:
    """(cur − base) / base; base 0 → 0 if cur is 0 else +inf."""
    return (F.when(base == 0, F.when(cur == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))))
            .otherwise((cur - base) / base))


def metric_changes(cur: DataFrame, base: DataFrame) -> DataFrame:
    """A08 over two one-row metric frames → (metric, value)."""
    names = {"latency_change": "avg_total_latency_ms", "latency_p99_change": "latency_p99_ms",
             "error_rate_change": "error_rate", "avg_score_change": "avg_final_score"}
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in names.values()])
    j = cur.select(*names.values(), *[b.select(F.first(f"b_{c}")).scalar().alias(f"b_{c}") for c in names.values()])
    return j.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"),
                                                 _change(F.col(v), F.col(f"b_{v}")).alias("value"))
                                        for k, v in names.items()])).alias("m")).select("m.*")


def perf_alerts(cur: DataFrame, base: DataFrame | None) -> DataFrame:
    """p99 > 500 ms (warning), error rate > 1 % (critical); against a
    baseline: mean latency +50 % (warning), final score −20 % (warning)."""
    parts = [cur.where(F.col("latency_p99_ms") > C.P99_LATENCY_WARN_MS).select(
        F.lit("high_latency").alias("alert_type"), F.lit("warning").alias("severity"),
        F.lit("latency_p99_ms").alias("metric_name"), F.col("latency_p99_ms").alias("current_value"),
        F.lit(C.P99_LATENCY_WARN_MS).alias("threshold_value")),
        cur.where(F.col("error_rate") > C.ERROR_RATE_CRIT).select(
        F.lit("high_error_rate").alias("alert_type"), F.lit("critical").alias("severity"),
        F.lit("error_rate").alias("metric_name"), F.col("error_rate").alias("current_value"),
        F.lit(C.ERROR_RATE_CRIT).alias("threshold_value"))]
    if base is not None:
        bl = base.select(F.first("avg_total_latency_ms")).scalar()
        bs = base.select(F.first("avg_final_score")).scalar()
        j = cur.select("*", bl.alias("_bl"), bs.alias("_bs"))
        inc = F.when(F.col("_bl") > 0, (F.col("avg_total_latency_ms") - F.col("_bl")) / F.col("_bl")).otherwise(F.lit(0.0))
        drop = (F.col("_bs") - F.col("avg_final_score")) / F.col("_bs")
        parts.append(j.where(inc > C.LATENCY_INCREASE_WARN).select(
            F.lit("latency_regression").alias("alert_type"), F.lit("warning").alias("severity"),
            F.lit("avg_total_latency_ms").alias("metric_name"), F.col("avg_total_latency_ms").alias("current_value"),
            (F.col("_bl") * 1.5).alias("threshold_value")))
        parts.append(j.where((F.col("_bs") > 0) & (drop > -C.SCORE_DECREASE_WARN)).select(
            F.lit("score_degradation").alias("alert_type"), F.lit("warning").alias("severity"),
            F.lit("avg_final_score").alias("metric_name"), F.col("avg_final_score").alias("current_value"),
            (F.col("_bs") * 0.8).alias("threshold_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def latency_summary(log: DataFrame) -> DataFrame:
    """Mean, median, p95, p99, min, max of total latency; per-stage mean
    and p95; throughput = requests per second of summed latency."""
    long = log.select(F.explode(F.array(
        F.struct(F.lit("total").alias("stage"), F.col("inference_latency_ms").alias("v")),
        F.struct(F.lit("retrieval").alias("stage"), F.col("retrieval_latency_ms").alias("v")),
        F.struct(F.lit("ranking").alias("stage"), F.col("ranking_latency_ms").alias("v")))).alias("r")).select("r.*")
    q = exact_quantiles(long, "v", [0.5, 0.95, 0.99], ["stage"])
    qw = q.groupBy("stage").agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n)
                                  for p, n in [(0.5, "median"), (0.95, "p95"), (0.99, "p99")]])
    m = long.where(F.col("v").isNotNull()).groupBy("stage").agg(
        F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("_sum"))
    return m.join(qw, "stage").select("stage", "n", "mean", "median", "p95", "p99", "min", "max",
                                      (F.col("n") / (F.col("_sum") / 1000.0)).alias("throughput_per_s"))


def canary_gate(log: DataFrame, window_col: str = "window") -> DataFrame:
    """Metrics per canary window (traffic 10/25/50/75/100 %); a window
    fails when error rate > 5 % or p99 > 500 ms; the first failure rolls back,
    later windows are skipped."""
    m = perf_metrics(log, [window_col]).select(window_col, "num_samples", "error_rate", "latency_p99_ms")
    steps = F.array(*[F.lit(s) for s in C.CANARY_STEPS])
    bad = (F.col("error_rate") > C.CANARY_ERROR_RATE) | (F.col("latency_p99_ms") > C.CANARY_P99_MS)
    m = m.withColumn("healthy", ~bad)
    first_bad = m.select(F.min(F.when(~F.col("healthy"), F.col(window_col)))).scalar()
    return m.select(window_col, F.element_at(steps, F.col(window_col) + 1).alias("traffic_percent"),
                    "num_samples", "error_rate", "latency_p99_ms", "healthy",
                    F.when(first_bad.isNotNull() & (F.col(window_col) > first_bad), "skipped")
                    .when(F.col("healthy"), "promote").otherwise("rollback").alias("action"))
