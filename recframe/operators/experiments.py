"""A/B testing and exploration sampling.

Randomness in the reference (assignment, request sampling, sample choice and
insert position) is replaced by md5 hashes of stable keys, so results do not
depend on partitioning or re-execution.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.operators.encoders import hash_bucket


def h60(col) -> Column:
    """First 60 bits of md5(text) as a non-negative BIGINT."""
    c = F.col(col) if isinstance(col, str) else col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("bigint")


@dataclass
class Variant:
    name: str
    model_version: str
    traffic: float


def validate_traffic(variants: list[Variant]) -> None:
    total = sum(v.traffic for v in variants)
    if abs(total - 1.0) > 0.01:
        raise ValueError(f"variant traffic must sum to 1.0 (got {total})")


def ab_assign(users: DataFrame, experiment_id: str, variants: list[Variant], status: str = "running",
              user_col: str = "id") -> DataFrame:
    """bucket = (md5("exp:user") mod 10000) / 10000; first variant whose
    cumulative traffic exceeds the bucket, else the last one.  Nothing is
    assigned unless the experiment is running."""
    validate_traffic(variants)
    if status != "running":
        return users.select(F.col(user_col).alias("user_id")).limit(0).select(
            "user_id", F.lit(None).cast("string").alias("variant"), F.lit(None).cast("string").alias("model_version"))
    bucket = hash_bucket(F.concat(F.lit(f"{experiment_id}:"), F.col(user_col).cast("string")), 10000) / 10000.0
    cum, name, mv = 0.0, F.lit(variants[-1].name), F.lit(variants[-1].model_version)
    expr_n, expr_m = None, None
    for v in variants:
        cum += v.traffic
        cond = bucket < F.lit(cum)
        expr_n = F.when(cond, v.name) if expr_n is None else expr_n.when(cond, v.name)
        expr_m = F.when(cond, v.model_version) if expr_m is None else expr_m.when(cond, v.model_version)
    return users.select(F.col(user_col).alias("user_id"), bucket.alias("bucket"),
                        expr_n.otherwise(name).alias("variant"), expr_m.otherwise(mv).alias("model_version"))


def variant_metrics(inter: DataFrame, experiment_id: str, variants: list[Variant]) -> DataFrame:
    """Per variant (by model_version) distinct users, impressions, clicks,
    completions, CTR with binomial s.e. and 95 % CI clipped to [0, 1],
    completion = completions / clicks, mean watch time over watch ∪ complete."""
    vmap = F.create_map(*[x for v in variants for x in (F.lit(v.model_version), F.lit(v.name))])
    t = F.col("interaction_type")
    df = inter.where(F.col("experiment_id") == experiment_id).withColumn("variant", vmap[F.col("model_version")])
    g = df.where(F.col("variant").isNotNull()).groupBy("variant").agg(
        F.count_distinct("user_id").alias("sample_size"),
        F.count(F.when(t == "impression", 1)).alias("impressions"),
        F.count(F.when(t == "click", 1)).alias("clicks"),
        F.count(F.when(t == "complete", 1)).alias("completions"),
        F.coalesce(F.avg(F.when(t.isin("watch", "complete"), F.col("watch_time_seconds"))), F.lit(0.0)).alias("avg_watch_time"))
    ctr = F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")).otherwise(F.lit(0.0))
    g = g.withColumn("click_through_rate", ctr)
    se = F.when(F.col("impressions") > 0,
                F.sqrt(F.col("click_through_rate") * (1 - F.col("click_through_rate")) / F.col("impressions"))).otherwise(F.lit(0.0))
    g = g.withColumn("ctr_std_error", se)
    return g.select("variant", "sample_size", "impressions", "clicks", "completions", "click_through_rate",
                    "ctr_std_error",
                    F.when(F.col("impressions") > 0, F.greatest(F.lit(0.0), ctr - 1.96 * se)).otherwise(F.lit(0.0)).alias("ci_low"),
                    F.when(F.col("impressions") > 0, F.least(F.lit(1.0), ctr + 1.96 * se)).otherwise(F.lit(0.0)).alias("ci_high"),
                    F.when(F.col("clicks") > 0, F.col("completions") / F.col("clicks")).otherwise(F.lit(0.0)).alias("completion_rate"),
                    "avg_watch_time")


def two_proportion_test(vm: DataFrame, control: str, treatment: str, confidence: float = 0.95) -> DataFrame:
    """A10: pooled two-proportion z test on CTR.  Significant when
    |z| > z₁₋α/₂ (the same decision as p < α); winner = higher CTR."""
    zcrit = NormalDist().inv_cdf(1 - (1 - confidence) / 2)

    def pick(v, c):
        return F.max(F.when(F.col("variant") == v, F.col(c)))

    r = vm.agg(pick(control, "click_through_rate").alias("p1"), pick(treatment, "click_through_rate").alias("p2"),
               pick(control, "impressions").alias("n1"), pick(treatment, "impressions").alias("n2"),
               pick(control, "clicks").alias("c1"), pick(treatment, "clicks").alias("c2"))
    pool = (F.col("c1") + F.col("c2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")))
    valid = (F.col("n1") > 0) & (F.col("n2") > 0)
    r = r.withColumn("se", F.when(valid, se))
    z = F.when(F.col("se") > 0, (F.col("p2") - F.col("p1")) / F.col("se"))
    r = r.withColumn("z_score", z)
    sig = F.coalesce(F.abs(F.col("z_score")) > F.lit(zcrit), F.lit(False))
    return r.select(F.lit(control).alias("control"), F.lit(treatment).alias("treatment"), "z_score",
                    F.when(F.col("z_score").isNotNull() & (F.col("p1") > 0), (F.col("p2") - F.col("p1")) / F.col("p1"))
                    .otherwise(F.lit(0.0)).alias("relative_improvement"),
                    sig.alias("is_significant"),
                    F.when(sig, F.when(F.col("p2") > F.col("p1"), F.lit(treatment)).otherwise(F.lit(control)))
                    .alias("winner"))


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """2·(1 − Φ(|z|)) = erfc(|z| / √2); NULL z → 1.0."""
    return z.map(lambda v: 1.0 if v is None or pd.isna(v) else math.erfc(abs(v) / math.sqrt(2.0)))


def experiment_report(inter: DataFrame, experiment_id: str, variants: list[Variant], min_sample_size: int = 100,
                      confidence: float = 0.95, primary_metric: str = "click_through_rate") -> DataFrame:
    """Time range, A10 with its p-value (two variants only) and the
    recommendation text; one row, whatever the experiment holds.

    Without an interaction: "Insufficient data for analysis", no times, p 1.0.
    Else the first variant (in the order given) with fewer than
    ``min_sample_size`` users, one without any included, keeps it running."""
    ex = inter.where(F.col("experiment_id") == experiment_id)
    body = ex.agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("_n"))
    vm = variant_metrics(inter, experiment_id, variants)
    if len(variants) == 2:
        test = two_proportion_test(vm, variants[0].name, variants[1].name, confidence)
        body = body.select("*", *[test.select(c).scalar().alias(c) for c in ("z_score", "relative_improvement", "is_significant", "winner")])
    else:
        body = body.select("*", F.lit(None).cast("double").alias("z_score"), F.lit(0.0).alias("relative_improvement"),
                           F.lit(False).alias("is_significant"), F.lit(None).cast("string").alias("winner"))
    body = body.select("*", two_sided_p(F.col("z_score")).alias("p_value"))
    text = F.when(F.col("_n") == 0, F.lit("Insufficient data for analysis"))
    for v in variants:
        users = F.coalesce(vm.where(F.col("variant") == v.name).select(F.max("sample_size")).scalar(), F.lit(0))
        text = text.when(users < min_sample_size,
                         F.format_string("Continue experiment: %s has only %d/%d required samples", F.lit(v.name), users, F.lit(min_sample_size)))
    text = (text.when(~F.col("is_significant"),
                      F.format_string("No significant difference detected (p=%.3f). Consider running longer or "
                                      "accepting null hypothesis.", F.col("p_value")))
            .otherwise(F.format_string(f"Recommend deploying '%s' (+%.1f%% {primary_metric}, p=%.4f)",
                                       F.col("winner"), F.col("relative_improvement") * 100, F.col("p_value"))))
    hours = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 3.6e9
    return body.select(F.lit(experiment_id).alias("experiment_id"), "start_time", "end_time",
                       F.coalesce(hours, F.lit(0.0)).alias("duration_hours"), "z_score", "p_value",
                       "relative_improvement", "is_significant", "winner", text.alias("recommendation"))


# --- exploration sampling ------------------------------------------------------

def inject_exploration(ranked: DataFrame, top_k: int = 10, sample_from_top_n: int = 30, sample_size: int = 3,
                       sample_probability: float = 0.2, req: str = "request_id", item: str = "video_id",
                       rank: str = "rank") -> DataFrame:
    """For a hashed fraction of requests replace up to
    min(sample_size, pool, top_k // 3) of the top-k with items ranked
    top_k+1 … sample_from_top_n, placed in the second half of the shown list.

    Returns the shown rows: request, item, original_rank, displayed_position,
    is_sample."""
    w = Window.partitionBy(req)
    sampled_req = hash_bucket(F.col(req), 10000) < int(round(sample_probability * 10000))
    df = ranked.select(req, item, rank).withColumn("_n", F.count(F.lit(1)).over(w))
    upper = F.least(F.col("_n"), F.lit(sample_from_top_n))
    in_pool = sampled_req & (F.col(rank) > top_k) & (F.col(rank) <= upper)
    df = df.withColumn("_pool", F.sum(in_pool.cast("int")).over(w))
    df = df.withColumn("_m", F.when(sampled_req & (upper > top_k),
                                    F.least(F.lit(sample_size), F.col("_pool"), F.lit(top_k // 3))).otherwise(F.lit(0)))
    key = h60(F.concat(F.col(req).cast("string"), F.lit(":"), F.col(item).cast("string")))
    pool = df.where(in_pool).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(req).orderBy(key, F.col(item))))
    L = F.lit(top_k) - F.col("_m")
    half = F.floor(L / 2)
    samples = pool.where(F.col("_rn") <= F.col("_m")).select(
        req, item, F.col(rank).alias("original_rank"),
        (half + F.pmod(key, L - half + 1) + 0.5).alias("_key"), F.col("_rn"), F.lit(True).alias("is_sample"))
    top = df.where(F.col(rank) <= L).select(req, item, F.col(rank).alias("original_rank"),
                                            F.col(rank).cast("double").alias("_key"), F.lit(0).alias("_rn"),
                                            F.lit(False).alias("is_sample"))
    shown = top.unionByName(samples)
    pos = F.row_number().over(Window.partitionBy(req).orderBy("_key", "_rn"))
    return shown.select(req, item, "original_rank", pos.alias("displayed_position"), "is_sample")


def sample_feedback(samples: DataFrame, inter: DataFrame, req: str = "request_id", item: str = "video_id") -> DataFrame:
    """Attach clicked / completed / watch time / explicit feedback by
    (request, video); missing → false / 0."""
    t = F.col("interaction_type")
    fb = inter.groupBy(F.col(req).alias("_r"), F.col(item).alias("_v")).agg(
        F.max((t == "click").cast("int")).alias("_c"), F.max((t == "complete").cast("int")).alias("_d"),
        F.sum(F.when(t.isin("watch", "complete"), F.col("watch_time_seconds")).otherwise(0.0)).alias("_w"),
        F.max(F.when(t == "like", "like").when(t == "dislike", "dislike")).alias("_e"))
    j = samples.join(fb, (samples[req] == fb._r) & (samples[item] == fb._v), "left")
    return j.select(*samples.columns, F.coalesce(F.col("_c") == 1, F.lit(False)).alias("was_clicked"),
                    F.coalesce(F.col("_d") == 1, F.lit(False)).alias("was_completed"),
                    F.coalesce(F.col("_w"), F.lit(0.0)).alias("watch_time_seconds"),
                    F.col("_e").alias("explicit_feedback"))


def sampled_quality(fb: DataFrame, top_k_ctr) -> DataFrame:
    """Sampled CTR, completion (completions / clicks), mean positive
    watch time, CTR gap vs the top-k CTR and quality = min(1, gap), 0.5 when
    the top-k CTR is 0 (no lower clamp)."""
    s = fb.where("is_sample")
    r = s.agg(F.count(F.lit(1)).alias("total_samples"), F.count(F.when(F.col("was_clicked"), 1)).alias("_clk"),
              F.count(F.when(F.col("was_completed"), 1)).alias("_cmp"),
              F.coalesce(F.avg(F.when(F.col("watch_time_seconds") > 0, F.col("watch_time_seconds"))), F.lit(0.0)).alias("avg_watch_time"))
    tk = F.lit(top_k_ctr) if isinstance(top_k_ctr, (int, float)) else top_k_ctr
    r = r.select("*", tk.alias("top_k_ctr"))
    sctr = F.when(F.col("total_samples") > 0, F.col("_clk") / F.col("total_samples")).otherwise(F.lit(0.0))
    r = r.withColumn("sampled_ctr", sctr)
    gap = F.when(F.col("top_k_ctr") > 0, (F.col("top_k_ctr") - F.col("sampled_ctr")) / F.col("top_k_ctr")).otherwise(F.lit(0.0))
    return r.select("total_samples", "sampled_ctr",
                    F.when(F.col("_clk") > 0, F.col("_cmp") / F.col("_clk")).otherwise(F.lit(0.0)).alias("sampled_completion_rate"),
                    "avg_watch_time", "top_k_ctr", gap.alias("ctr_gap"),
                    F.when(F.col("total_samples") == 0, F.lit(0.0))
                    .when(F.col("top_k_ctr") > 0, F.least(F.lit(1.0), gap)).otherwise(F.lit(0.5)).alias("ranking_quality_score"))


def rank_tier_metrics(fb: DataFrame, scores: DataFrame | None = None, score_col: str = "ranker_score") -> DataFrame:
    """Count, CTR and mean ranker score of samples by original rank tier
    11–15, 16–20, 21–25, 26–30."""
    r = F.col("original_rank")
    tier = (F.when(r.between(11, 15), "tier_11_15").when(r.between(16, 20), "tier_16_20")
            .when(r.between(21, 25), "tier_21_25").when(r.between(26, 30), "tier_26_30"))
    s = fb.where("is_sample").withColumn("tier", tier).where(F.col("tier").isNotNull())
    return s.groupBy("tier").agg(F.count(F.lit(1)).alias("sample_count"),
                                 (F.count(F.when(F.col("was_clicked"), 1)) / F.count(F.lit(1))).alias("ctr"),
                                 F.avg(score_col).alias("avg_ranker_score"))
