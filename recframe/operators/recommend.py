"""Candidate generation, merging, diversification and ordering (W03, W04,
W06–W08, W14, F04, F05, J12, J13, J16, J17, K04, K05, P19, P20, U06).

Every per-request decision is a window over one ``request`` partitioning,
so a request's candidates are shuffled once; greedy loops of the reference
are replaced by closed forms (MMR = merge of decreasing sequences; the
diversity sampler = two ranked passes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe import constants as C
from recframe.functions.scalar import blend_scores
from recframe.sources.published import PublishedTable, key_bucket


def recent_interactions(inter: DataFrame, limit: int = 50, user: str = "user_id", ts: str = "ts",
                        tie: str = "interaction_id") -> DataFrame:
    """The newest ``limit`` interactions per user, newest first."""
    w = Window.partitionBy(user).orderBy(F.col(ts).desc(), F.col(tie).asc())
    return inter.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= limit)


def recent_categories(recent: DataFrame, limit: int = 4, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Distinct categories of the recent interactions, most recent
    first (first-seen order over newest-first interactions)."""
    first = recent.groupBy(user, "category").agg(F.min("recency_rank").alias("_first"))
    w = Window.partitionBy(user).orderBy("_first", "category")
    return first.withColumn("category_rank", F.row_number().over(w)).where(
        F.col("category_rank") <= limit).drop("_first")


def query_contexts(users: DataFrame, recent_cats: DataFrame, max_queries: int = 5, user: str = "user_id") -> DataFrame:
    """primary context + one per recent category (≤ max_queries − 1),
    the category overriding the previous category."""
    prim = users.select(user, F.lit("q_primary").alias("query_id"), F.lit("primary").alias("query_type"),
                        F.lit(None).cast("string").alias("category"), F.lit(0).alias("query_index"))
    cats = recent_cats.where(F.col("category_rank") <= max_queries - 1).select(
        user, F.concat(F.lit("q_cat_"), (F.col("category_rank") - 1).cast("string")).alias("query_id"),
        F.lit("category").alias("query_type"), "category", F.col("category_rank").cast("int").alias("query_index"))
    return prim.unionByName(cats)


def merge_query_scores(results: DataFrame, max_results: int = 100, req: str = "user_id") -> DataFrame:
    """per (request, video) weighted mean of the query scores (primary
    0.5, category 0.3, other 0.2) + 0.05·min(hits − 1, 3); best
    ``max_results`` by merged score (video id breaks ties); source list in
    query order."""
    w = (F.when(F.col("query_type") == "primary", C.QUERY_WEIGHTS["primary"])
         .when(F.col("query_type") == "category", C.QUERY_WEIGHTS["category"]).otherwise(C.QUERY_WEIGHTS["other"]))
    r = results.withColumn("_w", w)
    g = r.groupBy(req, "video_id").agg(
        F.sum(F.col("score") * F.col("_w")).alias("_sw"), F.sum("_w").alias("_w"), F.count(F.lit(1)).alias("hits"),
        F.array_sort(F.collect_list(F.struct("query_index", "query_id"))).alias("_src"))
    merged = (F.when(F.col("_w") > 0, F.col("_sw") / F.col("_w")).otherwise(F.lit(0.0))
              + F.least(F.col("hits") - 1, F.lit(C.MULTI_HIT_CAP)) * C.MULTI_HIT_BONUS)
    g = g.select(req, "video_id", merged.alias("merged_score"), "hits",
                 F.transform("_src", lambda s: s["query_id"]).alias("sources"))
    win = Window.partitionBy(req).orderBy(F.col("merged_score").desc(), F.col("video_id").asc())
    return g.withColumn("rank", F.row_number().over(win)).where(F.col("rank") <= max_results)


def multi_query_union(results: DataFrame, req: str = "user_id") -> DataFrame:
    """All candidates of all queries with the list of their sources."""
    return results.groupBy(req, "video_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("query_index", "query_id"))), lambda s: s["query_id"])
        .alias("sources"))


def merge_summary(results: DataFrame, merged: DataFrame, req: str = "user_id") -> DataFrame:
    """F04 counters per request: all candidates, candidates after the merge,
    categories its queries asked for."""
    t = results.groupBy(req).agg(F.count(F.lit(1)).alias("total_candidates"),
                                 F.count_distinct("category").alias("category_coverage"))
    u = merged.groupBy(req).agg(F.count(F.lit(1)).alias("unique_candidates"))
    return t.join(u, req, "left").select(req, "total_candidates", F.coalesce("unique_candidates", F.lit(0)).alias("unique_candidates"), "category_coverage")


def rank_window(req: str) -> Window:
    return Window.partitionBy(req)


def mmr_by_category(ranked: DataFrame, n: int, weight: float, req: str = "request_id", score: str = "score",
                    rank: str = "rank", category: str = "category") -> DataFrame:
    """Greedy MMR with penalty weight·(items already chosen in the
    category).  Inside a category items are chosen in score order, so item j
    competes with score − weight·j, a decreasing sequence; the greedy result
    is the merge of those sequences = one sort by (adjusted desc, rank asc).
    Lists with ≤ n items are returned unchanged."""
    cat = F.coalesce(F.col(category), F.lit("Unknown"))
    wc = Window.partitionBy(req, cat).orderBy(F.col(score).desc(), F.col(rank).asc())
    df = ranked.withColumn("_j", F.row_number().over(wc) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(req)))
    adj = F.when(F.col("_n") <= n, -F.col(rank).cast("double")).otherwise(F.col(score) - weight * F.col("_j"))
    w = Window.partitionBy(req).orderBy(adj.desc(), F.col(rank).asc())
    out = df.withColumn("final_rank", F.row_number().over(w))
    return out.where((F.col("_n") <= n) | (F.col("final_rank") <= n)).drop("_j", "_n")


def diversity_sample(ranked: DataFrame, n: int, cap: int = 5, req: str = "request_id", score: str = "score",
                     rank: str = "rank", category: str = "category") -> DataFrame:
    """Pass 1 = best item of each category (categories by best score),
    pass 2 = the rest by score with ≤ cap per category; pass 1 then pass 2,
    first n.  Lists with ≤ n items are returned unchanged."""
    cat = F.coalesce(F.col(category), F.lit("Unknown"))
    wc = Window.partitionBy(req, cat).orderBy(F.col(score).desc(), F.col(rank).asc())
    df = ranked.withColumn("_p", F.row_number().over(wc)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(req))).withColumn(
        "_head", F.min(F.col(rank)).over(Window.partitionBy(req, cat)))
    small = F.col("_n") <= n
    keep = small | (F.col("_p") <= cap)
    pas = F.when(F.col("_p") == 1, 0).otherwise(1)
    w = Window.partitionBy(req).orderBy(
        F.when(small, 0).otherwise(pas), F.when(small, F.col(rank).cast("double"))
        .when(F.col("_p") == 1, F.col(rank).cast("double")).otherwise(-F.col(score)),
        F.when(small | (F.col("_p") == 1), 0).otherwise(F.col("_head")), F.col(rank))
    out = df.where(keep).withColumn("final_rank", F.row_number().over(w))
    return out.where(small | (F.col("final_rank") <= n)).drop("_p", "_n", "_head")


def required_categories(ranked: DataFrame, required: list[str], n: int, req: str = "request_id",
                        rank: str = "rank", category: str = "category") -> DataFrame:
    """The first item (list order) of each required category, in the
    required order, then the rest in list order up to n."""
    reqarr = F.array(*[F.lit(c) for c in required])
    wc = Window.partitionBy(req, category).orderBy(F.col(rank).asc())
    df = ranked.withColumn("_p", F.row_number().over(wc))
    pos = F.array_position(reqarr, F.col(category))
    is_req = (pos > 0) & (F.col("_p") == 1)
    df = df.withColumn("_req", is_req).withColumn(
        "_nreq", F.sum(F.col("_req").cast("int")).over(Window.partitionBy(req)))
    wo = Window.partitionBy(req).orderBy(F.col("_req").desc(), F.when(F.col("_req"), pos).otherwise(0), F.col(rank))
    out = df.withColumn("final_rank", F.row_number().over(wo))
    return out.where(F.col("_req") | (F.col("final_rank") <= F.greatest(F.lit(n), F.col("_nreq")))).drop(
        "_p", "_req", "_nreq")


def candidate_feature_row(cands: DataFrame, users: DataFrame, videos: DataFrame, context: DataFrame | None = None,
                          req: str = "request_id") -> DataFrame:
    """Candidates × user features × video features × context with
    the serving defaults (country US, language en, age 25, category Unknown,
    duration 300, popularity low, counts 0, device desktop, hour 12, day Monday)."""
    d = C.CANDIDATE_DEFAULTS
    u = users.select(F.col("id").alias("_uid"), F.col("country_code").alias("_country"),
                     F.col("preferred_language").alias("_lang"), F.col("age").alias("_age"))
    v = videos.select(F.col("id").alias("_vid"), F.col("category").alias("_cat"),
                      F.col("child_categories").alias("_child"), F.col("duration").alias("_dur"),
                      F.col("popularity").alias("_pop"), F.col("view_count").alias("_views"),
                      F.col("like_count").alias("_likes"), F.col("comment_count").alias("_comments"))
    j = cands.join(u, cands.user_id == u._uid, "left").join(v, cands.video_id == v._vid, "left")
    if context is not None:
        j = j.join(context, req, "left")
    has = set(j.columns)
    ctx = lambda c, dv: F.coalesce(F.col(c), F.lit(dv)) if c in has else F.lit(dv)
    return j.select(*cands.columns,
                    F.coalesce("_country", F.lit(d["country"])).alias("country"),
                    F.coalesce("_lang", F.lit(d["language"])).alias("user_language"),
                    F.coalesce("_age", F.lit(d["age"])).alias("age"),
                    F.coalesce("_cat", F.lit(d["category"])).alias("video_category"),
                    F.coalesce("_child", F.lit(d["child_categories"])).alias("child_categories"),
                    F.coalesce("_dur", F.lit(d["duration"])).alias("video_duration"),
                    F.coalesce("_pop", F.lit(d["popularity"])).alias("popularity"),
                    F.coalesce("_views", F.lit(d["view_count"])).alias("view_count"),
                    F.coalesce("_likes", F.lit(d["like_count"])).alias("like_count"),
                    F.coalesce("_comments", F.lit(d["comment_count"])).alias("comment_count"),
                    ctx("device", d["device"]).alias("device"), ctx("hour", d["hour"]).alias("hour"),
                    ctx("day", d["day"]).alias("day"))


def service_feature_row(rows: DataFrame, user_feats: list[str], video_feats: list[str]) -> DataFrame:
    """P20: named user / video features default 0 ('0' for strings); hour,
    day and device from the context."""
    cols = []
    for c in user_feats + video_feats:
        dt = dict(rows.dtypes).get(c)
        if dt is None:
            cols.append(F.lit(0).alias(c))
        elif dt == "string":
            cols.append(F.coalesce(F.col(c), F.lit("0")).alias(c))
        else:
            cols.append(F.coalesce(F.col(c), F.lit(0).cast(dt)).alias(c))
    return rows.select(*[c for c in rows.columns if c not in user_feats + video_feats], *cols)


def retrieve_candidates(topk: DataFrame, num_candidates: int, excluded: DataFrame | None = None,
                        blocked: DataFrame | None = None, passes: DataFrame | None = None,
                        req: str = "query_id") -> DataFrame:
    """Drop excluded (per request) and blocked items and items
    failing the business rules (``passes`` = allowed item ids), keep the best
    ``num_candidates``.  ``num_filtered`` (on every kept row): how many of the
    request's items were dropped before the quota was reached, all of them if
    it was not."""
    seen = _scanned(topk, num_candidates, excluded, blocked, passes, req)
    w = Window.partitionBy(req).orderBy(F.col("score").desc(), F.col("item_id").asc())
    return (seen.withColumn("num_filtered", F.sum(F.col("_drop").cast("long")).over(Window.partitionBy(req)))
            .where(~F.col("_drop")).withColumn("candidate_rank", F.row_number().over(w)).drop("_drop"))


def retrieval_counts(topk: DataFrame, num_candidates: int, excluded: DataFrame | None = None,
                     blocked: DataFrame | None = None, passes: DataFrame | None = None, req: str = "query_id") -> DataFrame:
    """J16 counters: kept and filtered items of every request, also of those that keep none."""
    seen = _scanned(topk, num_candidates, excluded, blocked, passes, req)
    return seen.groupBy(req).agg(F.count(F.when(~F.col("_drop"), 1)).alias("num_candidates"), F.count(F.when(F.col("_drop"), 1)).alias("num_filtered"))


def _scanned(topk: DataFrame, num_candidates: int, excluded: DataFrame | None, blocked: DataFrame | None,
             passes: DataFrame | None, req: str) -> DataFrame:
    """Items in score order up to the one that fills the quota, with ``_drop``."""
    t = topk.withColumn("_drop", F.lit(False))
    if excluded is not None:
        ex = excluded.select(F.col(excluded.columns[0]).alias("_xr"), F.col(excluded.columns[1]).alias("_xi")).distinct()
        t = t.join(ex, (t[req] == ex._xr) & (t.item_id == ex._xi), "left").withColumn(
            "_drop", F.col("_drop") | F.col("_xi").isNotNull()).drop("_xr", "_xi")
    if blocked is not None:
        b = blocked.select(F.col(blocked.columns[0]).alias("_bi")).distinct()
        t = t.join(b, t.item_id == b._bi, "left").withColumn("_drop", F.col("_drop") | F.col("_bi").isNotNull()).drop("_bi")
    if passes is not None:
        p = passes.select(F.col(passes.columns[0]).alias("_pi"), F.lit(True).alias("_ok")).distinct()
        t = t.join(p, t.item_id == p._pi, "left").withColumn(
            "_drop", F.col("_drop") | F.col("_ok").isNull()).drop("_pi", "_ok")
    w = Window.partitionBy(req).orderBy(F.col("score").desc(), F.col("item_id").asc())
    before = F.coalesce(F.sum((~F.col("_drop")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("_kept", before).where(F.col("_kept") < num_candidates).drop("_kept")


def store_recommendations(table: PublishedTable, recs: DataFrame, user: str = "user_id", buckets: int = 16) -> int:
    """The lists of the users in ``recs`` replace the ones stored for them,
    as the next version of ``table``; other users keep theirs."""
    new = recs.withColumn("bucket", key_bucket(user, buckets))
    stored = table.read()
    if stored is None:
        return table.publish(new, ["bucket"])
    kept = stored.join(new.select(user).distinct(), user, "left_anti")
    return table.publish(kept.unionByName(new), ["bucket"])


def stored_recommendations(table: PublishedTable, now, ttl_minutes: int = 60, ts: str = "ts") -> DataFrame:
    """The stored lists that are no older than their time to live."""
    live = F.col(ts) >= F.lit(now) - F.expr(f"INTERVAL {int(ttl_minutes)} MINUTES")
    return table.read().where(live).drop("bucket")


def request_cap(requested: Column, default: int = 20, cap: int = 100) -> Column:
    """min(requested, 100), 20 when not given."""
    return F.least(F.coalesce(requested, F.lit(default)), F.lit(cap))


def blend_and_rank(cands: DataFrame, req: str, retrieval: str, ranker: str, clip: bool = True) -> DataFrame:
    """F02 / F03 + W01: final score and 1-based rank per request."""
    s = cands.withColumn("final_score", blend_scores(retrieval, ranker, clip))
    w = Window.partitionBy(req).orderBy(F.col("final_score").desc(), F.col("video_id").asc())
    return s.withColumn("rank", F.row_number().over(w))
