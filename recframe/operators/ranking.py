"""Ranking and classification metrics.

Per-list metrics use ``row_number() … <= k`` so Spark plans a
WindowGroupLimit: each map task keeps only k rows per list before the
shuffle, so a huge list never reaches one task whole.  Ties are broken by
item id ascending everywhere.  Global statistics (AUC, quantile bins) use
the exact ordering helpers instead of a single-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe.operators.ordering import exact_quantiles, global_prefix


def _order(score: str, item: str, desc: bool = True) -> list[Column]:
    return [F.col(score).desc() if desc else F.col(score).asc(), F.col(item).asc()]


def rank_topk(df: DataFrame, k: int | None, group: str = "query_id", score: str = "score",
              item: str = "item_id", rank_col: str = "rank") -> DataFrame:
    """1-based rank by score desc (item id asc on ties), top-k per group."""
    w = Window.partitionBy(group).orderBy(*_order(score, item))
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= k) if k else out


def _per_list(df, group, k, score, item, label):
    top = rank_topk(df, k, group, score, item, "_r")
    return top


def precision_at_k(df: DataFrame, k: int, group="query_id", score="score", item="item_id",
                   label="label", weight: str | None = None) -> DataFrame:
    """Per list Σ label in top-k / k (k even for short lists); A33 with a
    weight column: weighted numerator, unweighted denominator."""
    top = _per_list(df, group, k, score, item, label)
    num = F.col(label) * (F.col(weight) if weight else F.lit(1.0))
    per = top.groupBy(group).agg((F.sum(num) / F.lit(float(k))).alias("precision"))
    return per


def mrr(df: DataFrame, group="query_id", score="score", item="item_id", label="label",
        weight: str | None = None) -> DataFrame:
    """1 / rank of the first relevant item, 0 when none.

    The first relevant item is the best (score desc, item asc) relevant row;
    its rank is 1 + the number of rows ordered before it.  Both are
    aggregates, so no list is ever sorted in one task.
    """
    rel = (df.where(F.col(label) > 0).groupBy(group)
           .agg(F.min(F.struct((-F.col(score)).alias("ns"), F.col(item).alias("it"))).alias("_best")))
    j = df.select(group, score, item).join(rel, group, "left")
    before = (F.col("_best").isNotNull() & ((F.col(score) > -F.col("_best.ns"))
              | ((F.col(score) == -F.col("_best.ns")) & (F.col(item) < F.col("_best.it")))))
    agg = j.groupBy(group).agg(F.count(F.when(before, 1)).alias("_nb"),
                               F.max(F.col("_best").isNotNull().cast("int")).alias("_has"))
    rr = F.when(F.col("_has") == 1, 1.0 / (F.col("_nb") + 1)).otherwise(F.lit(0.0))
    if weight:
        wt = df.groupBy(group).agg(F.first(weight).alias("_w"))
        return agg.join(wt, group).select(group, (rr * F.col("_w")).alias("mrr"))
    return agg.select(group, rr.alias("mrr"))


def ndcg_at_k(df: DataFrame, k: int, group="query_id", score="score", item="item_id",
              label="label") -> DataFrame:
    """DCG of the predicted top-k over DCG of the ideal top-k (labels
    sorted desc over all items); gain = label / log2(rank + 1); 0 if IDCG = 0."""
    gain = F.col(label) / F.log2(F.col("_r") + 1)
    dcg = rank_topk(df, k, group, score, item, "_r").groupBy(group).agg(F.sum(gain).alias("_dcg"))
    ideal = rank_topk(df, k, group, label, item, "_r").groupBy(group).agg(F.sum(gain).alias("_idcg"))
    return dcg.join(ideal, group).select(
        group, F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def running_precision(df: DataFrame, k: int | None, group="query_id", score="score",
                      item="item_id", label="label") -> DataFrame:
    """Cumulative relevant / position along the ranked list."""
    top = rank_topk(df, k, group, score, item, "rank")
    w = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("running_precision", F.sum(label).over(w) / F.col("rank"))


def map_at_k(df: DataFrame, k: int | None, group="query_id", score="score", item="item_id",
             label="label") -> DataFrame:
    """Σ P@i · rel_i / Σ rel within the top-k; 0 when no relevant item."""
    rp = running_precision(df, k, group, score, item, label)
    agg = rp.groupBy(group).agg(F.sum(F.col("running_precision") * F.col(label)).alias("_s"),
                                F.sum(label).alias("_n"))
    return agg.select(group, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.lit(0.0))
                      .alias("map"))


def ranking_summary(df: DataFrame, k: int, group="query_id", score="score", item="item_id",
                    label="label") -> DataFrame:
    """Mean P@k, MRR, nDCG@k and MAP@k over all lists (one row)."""
    p = precision_at_k(df, k, group, score, item, label)
    m = mrr(df, group, score, item, label)
    n = ndcg_at_k(df, k, group, score, item, label)
    a = map_at_k(df, k, group, score, item, label)
    j = p.join(m, group).join(n, group).join(a, group)
    return j.agg(F.avg("precision").alias(f"precision_at_{k}"), F.avg("mrr").alias("mrr"),
                 F.avg("ndcg").alias(f"ndcg_at_{k}"), F.avg("map").alias(f"map_at_{k}"),
                 F.count(F.lit(1)).alias("n_lists"))


def per_user_eval(df: DataFrame, ks=(5, 10, 20), group="user_id", score="score", item="item_id",
                  label="label") -> DataFrame:
    """MRR over users with ≥ 2 rows; nDCG@k and MAP@k over users with
    ≥ k rows; returned as (metric, value) rows (absent when no user qualifies)."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sized = df.join(sizes, group)
    parts = [mrr(sized.where("_n >= 2"), group, score, item, label)
             .agg(F.lit("mrr").alias("metric"), F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("value"))]
    for k in ks:
        sub = sized.where(F.col("_n") >= k)
        parts.append(ndcg_at_k(sub, k, group, score, item, label)
                     .agg(F.lit(f"ndcg@{k}").alias("metric"), F.avg("ndcg").alias("value"))
                     .where(F.col("value").isNotNull()))
        parts.append(map_at_k(sub, k, group, score, item, label)
                     .agg(F.lit(f"map@{k}").alias("metric"), F.avg("map").alias("value"))
                     .where(F.col("value").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def accuracy(df: DataFrame, score="score", label="label", threshold: float = 0.5) -> DataFrame:
    """Share of rows where (score > 0.5) equals the label."""
    pred = (F.col(score) > threshold).cast("int")
    return df.agg(F.avg((pred == F.col(label).cast("int")).cast("double")).alias("accuracy"))


def auc(df: DataFrame, score="score", label="label") -> DataFrame:
    """Tie-aware ROC AUC (rank-sum form); 0.0 when only one class.

    Per distinct score (pos, neg) counts, then the number of negatives with a
    lower score via an exact global prefix sum over scores.
    """
    lab = F.col(label).cast("int")
    per = df.groupBy(F.col(score).cast("double").alias("_s")).agg(
        F.sum(F.when(lab == 1, 1).otherwise(0)).alias("_pos"),
        F.sum(F.when(lab == 1, 0).otherwise(1)).alias("_neg"))
    pref = global_prefix(per, ["_s"], weight="_neg")
    agg = pref.agg(F.sum(F.col("_pos") * (F.col("_gcum") + F.col("_neg") / 2.0)).alias("_u"),
                   F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    return agg.select(F.when((F.col("_P") > 0) & (F.col("_N") > 0), F.col("_u") / (F.col("_P") * F.col("_N")))
                      .otherwise(F.lit(0.0)).alias("auc"))


def quantile_edges(df: DataFrame, score: str, n_bins: int) -> Column:
    """Distinct qcut edges as a lazy array (scalar subquery over the exact
    quantiles), each rounded to 12 dp like the oracle."""
    qs = [i / n_bins for i in range(n_bins + 1)]
    q = exact_quantiles(df, score, qs)
    return q.select(F.array_sort(F.array_distinct(F.collect_list(F.round("value", 12))))).scalar()


def quantile_bins(df: DataFrame, score: str = "score", n_bins: int = 10, out: str = "bin") -> DataFrame:
    """Pandas qcut(q=n, labels=False, duplicates='drop'): right-closed
    bins over distinct interpolated edges; the minimum falls in bin 0."""
    edges = quantile_edges(df, score, n_bins)
    s = F.round(F.col(score).cast("double"), 12)
    below = F.size(F.filter(F.col("_edges"), lambda e: e < s))
    return (df.withColumn("_edges", edges)
            .withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_edges"))


def lift_table(df: DataFrame, score="score", label="label", n_bins: int = 10) -> DataFrame:
    """Per quantile bin mean / min / max score, positives, total,
    conversion rate and lift over the overall positive rate."""
    b = quantile_bins(df, score, n_bins)
    base = df.select(F.avg(F.col(label).cast("double"))).scalar()
    return (b.groupBy("bin").agg(F.avg(score).alias("score_mean"), F.min(score).alias("score_min"),
                                 F.max(score).alias("score_max"),
                                 F.sum(F.col(label).cast("bigint")).alias("positive_count"),
                                 F.count(F.lit(1)).alias("total_count"),
                                 F.avg(F.col(label).cast("double")).alias("conversion_rate"))
            .withColumn("lift", F.col("conversion_rate") / base))


def log2(x: float) -> float:
    return math.log2(x)


def weighted_mean(per_list: DataFrame, metric: str, weight: str, eps: float = 1e-7) -> DataFrame:
    """Σ metric · weight / (number of lists + ε) — weighted numerator,
    unweighted denominator."""
    return per_list.agg((F.sum(F.col(metric) * F.col(weight)) / (F.count(F.lit(1)) + eps))
                        .alias(f"weighted_{metric}"))
