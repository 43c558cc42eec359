"""Oracle SQL (DuckDB) for ``q_monitoring``."""

from recframe.queries.views import with_views

PCT = [1, 5, 25, 50, 75, 95, 99]
QL = "[" + ", ".join(str(p / 100) for p in PCT) + "]"

BASE = """
cur AS (select * from feature_records where ts >= timestamp '2024-01-16'),
base AS (select * from feature_records where ts < timestamp '2024-01-16')"""


def nprof(src: str) -> str:
    return f"""(select feature, count(*) as count,
        count(*) filter (where value is null or isnan(value)) as missing_count,
        avg(value) filter (where value is not null and not isnan(value)) as mean,
        stddev_pop(value) filter (where value is not null and not isnan(value)) as std,
        min(value) filter (where value is not null and not isnan(value)) as min_value,
        max(value) filter (where value is not null and not isnan(value)) as max_value,
        count(*) filter (where value is null or isnan(value)) / count(*) as missing_rate,
        quantile_cont(value, {QL}) filter (where value is not null and not isnan(value)) as q
      from (select 'age' as feature, cast(age as double) as value from {src}
            union all select 'duration', cast(duration as double) from {src}) group by feature)"""


def cprof(src: str) -> str:
    return f"""(select feature, count(*) as count, count(*) filter (where value is null) as missing_count,
        count(distinct value) as unique_count, count(*) filter (where value is null) / count(*) as missing_rate
      from (select 'country' as feature, cast(country as varchar) as value from {src}
            union all select 'category', cast(category as varchar) from {src}) group by feature)"""


def vcounts(src: str) -> str:
    return f"""(select feature, value, count(*) as count from (
        select 'country' as feature, cast(country as varchar) as value from {src}
        union all select 'category', cast(category as varchar) from {src}) where value is not null group by all)"""


NPROF_COLS = ("feature, count, missing_count, round(mean, 6) as mean, round(std, 6) as std, "
              "round(min_value, 6) as min_value, round(max_value, 6) as max_value, round(missing_rate, 6) as missing_rate, "
              + ", ".join(f"round(q[{i + 1}], 6) as p{p}" for i, p in enumerate(PCT)))

DRIFT = f"""
ncur AS {nprof('cur')}, nbase AS {nprof('base')},
ndrift AS (select c.feature, case when b.std = 0 then 0.0 else least(1 - 1 / (1 + abs(c.mean - b.mean) / b.std), 1.0) end as drift_score
           from ncur c join nbase b using (feature)),
vc AS {vcounts('cur')}, vb AS {vcounts('base')},
pj AS (select coalesce(c.feature, b.feature) as feature, c.count as c, b.count as b
       from vc c full outer join vb b on c.feature = b.feature and c.value = b.value),
pt AS (select pj.feature, greatest(coalesce(c, 0) / tc, 0.0001) as cp, greatest(coalesce(b, 0) / tb, 0.0001) as bp
       from pj join (select feature, sum(count) as tc from vc group by feature) x using (feature)
       join (select feature, sum(count) as tb from vb group by feature) y using (feature)),
cdrift AS (select feature, least(sum((cp - bp) * ln(cp / bp)) / 0.5, 1.0) as drift_score from pt group by feature),
drift AS (select * from ndrift union all select * from cdrift),
ccur AS {cprof('cur')}, cbase AS {cprof('base')},
prof AS (select feature, 'numerical' as feature_type, count, missing_rate, 0 as unique_count from ncur
         union all select feature, 'categorical', count, missing_rate, unique_count from ccur),
alerts AS (
  select 'high_missing_rate' as alert_type, 'warning' as severity, feature as feature_name,
         cast(missing_rate as double) as current_value, 0.05 as threshold from prof where missing_rate > 0.05
  union all select 'feature_drift', 'warning', feature, drift_score, 0.3 from drift where drift_score > 0.3
  union all select 'cardinality_change', 'info', c.feature, cast(c.unique_count as double), 0.2
    from ccur c join cbase b using (feature) where b.unique_count > 0 and abs(c.unique_count - b.unique_count) / b.unique_count > 0.2),
st AS (select case max(case severity when 'critical' then 2 when 'warning' then 1 else 0 end)
                   when 2 then 'critical' when 1 then 'degraded' else 'healthy' end as status from alerts)"""


def qw(body: str) -> str:
    return with_views(f"WITH {BASE}, {DRIFT} {body}", "users", "videos", "online", "feature_records")


def every(body: str) -> str:
    """The same over all records."""
    return qw(body).replace("where ts >= timestamp '2024-01-16'", "", 1)


PERF = """
def_log AS (select * from inference_log),
pm AS (select 'all' as part, * from (select count(*) as num_samples, avg(len(recommendations)) as avg_num_recommendations,
          avg(retrieval_latency_ms) as avg_retrieval_latency_ms, avg(ranking_latency_ms) as avg_ranking_latency_ms,
          avg(inference_latency_ms) as avg_total_latency_ms, count(*) filter (where len(recommendations) = 0) as error_count,
          min(ts) as start_time, max(ts) as end_time,
          count(*) filter (where len(recommendations) = 0) / count(*) as error_rate,
          quantile_cont(inference_latency_ms, 0.5) as latency_p50_ms, quantile_cont(inference_latency_ms, 0.95) as latency_p95_ms,
          quantile_cont(inference_latency_ms, 0.99) as latency_p99_ms from inference_log)),
"""


def perf(src: str) -> str:
    return f"""(select * from (select count(*) as num_samples, avg(len(recommendations)) as avg_num_recommendations,
          coalesce(avg(retrieval_latency_ms), 0) as avg_retrieval_latency_ms, coalesce(avg(ranking_latency_ms), 0) as avg_ranking_latency_ms,
          avg(inference_latency_ms) as avg_total_latency_ms, count(*) filter (where len(recommendations) = 0) as error_count,
          min(ts) as start_time, max(ts) as end_time,
          count(*) filter (where len(recommendations) = 0) / count(*) as error_rate,
          quantile_cont(inference_latency_ms, 0.5) as latency_p50_ms, quantile_cont(inference_latency_ms, 0.95) as latency_p95_ms,
          quantile_cont(inference_latency_ms, 0.99) as latency_p99_ms from {src}) a,
        (select coalesce(avg(r.retrieval_score), 0) as avg_retrieval_score, coalesce(avg(r.ranker_score), 0) as avg_ranker_score,
                coalesce(avg(r.score), 0) as avg_final_score from (select unnest(recommendations) as r from {src})) b)"""


PERF_COLS = ["num_samples", "avg_num_recommendations", "avg_retrieval_latency_ms", "avg_ranking_latency_ms",
             "avg_total_latency_ms", "error_count", "start_time", "end_time", "error_rate", "latency_p50_ms",
             "latency_p95_ms", "latency_p99_ms", "avg_retrieval_score", "avg_ranker_score", "avg_final_score"]
_DBL = {"avg_num_recommendations", "avg_retrieval_latency_ms", "avg_ranking_latency_ms", "avg_total_latency_ms",
        "error_rate", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms", "avg_retrieval_score",
        "avg_ranker_score", "avg_final_score"}
PERF_SEL = ", ".join(f"round({c}, 6) as {c}" if c in _DBL else c for c in PERF_COLS)

LOGS = f"""
lcur AS (select * from inference_log where ts >= timestamp '2024-01-16'),
lbase AS (select * from inference_log where ts < timestamp '2024-01-16'),
pc AS {perf('lcur')}, pb AS {perf('lbase')},
chg AS (
  select 'latency_change' as metric, case when pb.avg_total_latency_ms = 0 then case when pc.avg_total_latency_ms = 0 then 0.0 else 'inf'::double end else (pc.avg_total_latency_ms - pb.avg_total_latency_ms) / pb.avg_total_latency_ms end as value from pc, pb
  union all select 'latency_p99_change', case when pb.latency_p99_ms = 0 then case when pc.latency_p99_ms = 0 then 0.0 else 'inf'::double end else (pc.latency_p99_ms - pb.latency_p99_ms) / pb.latency_p99_ms end from pc, pb
  union all select 'error_rate_change', case when pb.error_rate = 0 then case when pc.error_rate = 0 then 0.0 else 'inf'::double end else (pc.error_rate - pb.error_rate) / pb.error_rate end from pc, pb
  union all select 'avg_score_change', case when pb.avg_final_score = 0 then case when pc.avg_final_score = 0 then 0.0 else 'inf'::double end else (pc.avg_final_score - pb.avg_final_score) / pb.avg_final_score end from pc, pb),
palerts AS (
  select 'high_latency' as alert_type, 'warning' as severity, 'latency_p99_ms' as metric_name, latency_p99_ms as current_value, 500.0 as threshold_value from pc where latency_p99_ms > 500
  union all select 'high_error_rate', 'critical', 'error_rate', error_rate, 0.01 from pc where error_rate > 0.01
  union all select 'latency_regression', 'warning', 'avg_total_latency_ms', pc.avg_total_latency_ms, pb.avg_total_latency_ms * 1.5 from pc, pb
    where (case when pb.avg_total_latency_ms > 0 then (pc.avg_total_latency_ms - pb.avg_total_latency_ms) / pb.avg_total_latency_ms else 0 end) > 0.5
  union all select 'score_degradation', 'warning', 'avg_final_score', pc.avg_final_score, pb.avg_final_score * 0.8 from pc, pb
    where pb.avg_final_score > 0 and (pb.avg_final_score - pc.avg_final_score) / pb.avg_final_score > 0.2),
pst AS (select case max(case severity when 'critical' then 2 when 'warning' then 1 else 0 end)
                   when 2 then 'critical' when 1 then 'degraded' else 'healthy' end as status from palerts)"""


def lw(body: str) -> str:
    return with_views(f"WITH {LOGS} {body}", "inference_log")


OW = "select * from online"

SQL = {
    "a01_numeric_profile": every(f"select {NPROF_COLS} from ncur"),
    "a02_categorical_profile": every("select feature, count, missing_count, unique_count, round(missing_rate, 6) as missing_rate from ccur"),
    "k02_top_values": every("select feature, value, count, row_number() over (partition by feature order by count desc, value) as rank from vc qualify rank <= 10"),
    "a03_profile_features": every(f"""select {NPROF_COLS}, 'numerical' as feature_type, cast(0 as bigint) as unique_count from ncur
        union all by name select feature, count, missing_count, unique_count, round(missing_rate, 6) as missing_rate,
                                 'categorical' as feature_type from ccur"""),
    "j22_stat_vs_baseline": qw("""select c.feature, round(c.mean, 6) as mean, round(c.std, 6) as std,
        round(b.mean, 6) as base_mean, round(b.std, 6) as base_std from ncur c left join nbase b using (feature)"""),
    "a34_numeric_drift": qw("select feature, round(drift_score, 6) as drift_score from ndrift"),
    "a35_psi_drift": qw("select feature, round(drift_score, 6) as drift_score from cdrift"),
    "a36_quality_alerts": qw("select alert_type, severity, feature_name, round(current_value, 6) as current_value, round(cast(threshold as double), 6) as threshold from alerts"),
    "a38_status": qw("select status from st"),
    "a48_quality_report": qw("""select p.feature, p.feature_type, p.count, round(p.missing_rate, 6) as missing_rate,
        round(coalesce(d.drift_score, 0.0), 6) as drift_score, cast(coalesce(n.n_alerts, 0) as bigint) as n_alerts,
        (select status from st) as status
        from prof p left join drift d using (feature)
        left join (select feature_name as feature, count(*) as n_alerts from alerts group by 1) n using (feature)"""),
    "a04_online_report": with_views("""select count(*) filter (where interaction_type = 'impression') as total_impressions,
          count(*) filter (where interaction_type = 'click') as total_clicks,
          count(*) filter (where interaction_type = 'complete') as total_completions,
          count(distinct user_id) as unique_users, count(distinct video_id) as unique_videos,
          round(case when count(*) filter (where interaction_type = 'impression') > 0
               then count(*) filter (where interaction_type = 'click') / count(*) filter (where interaction_type = 'impression') else 0.0 end, 6) as click_through_rate,
          round(coalesce(avg(watch_time_seconds) filter (where interaction_type in ('watch', 'complete')), 0.0), 6) as avg_watch_time_seconds,
          round(coalesce(sum(watch_time_seconds) filter (where interaction_type in ('watch', 'complete')), 0.0) / 3600, 6) as total_watch_time_hours,
          round(coalesce(avg(cr) filter (where interaction_type in ('watch', 'complete') and cr > 0), 0.0), 6) as completion_rate,
          round(coalesce(avg(position_in_list) filter (where interaction_type = 'click' and position_in_list > 0), 0.0), 6) as avg_click_position,
          count(*) filter (where interaction_type = 'like') as total_likes,
          count(*) filter (where interaction_type = 'dislike') as total_dislikes,
          round(case when count(*) filter (where interaction_type in ('like', 'dislike')) > 0
               then count(*) filter (where interaction_type = 'like') / count(*) filter (where interaction_type in ('like', 'dislike')) else 0.0 end, 6) as like_rate
        from (select *, case when interaction_type = 'complete' then 1.0
                             when interaction_type = 'watch' and video_duration_seconds > 0 then watch_time_seconds / video_duration_seconds
                             else 0.0 end as cr from online
              where ts >= timestamp '2024-01-10' and ts <= timestamp '2024-01-20')""", "online"),
    "a05_report_by_group": with_views("""select group_type, group_value, impressions, clicks,
          round(case when impressions > 0 then clicks / impressions else 0.0 end, 6) as ctr, completions from (
        select 'model_version' as group_type, model_version as group_value,
               count(*) filter (where interaction_type = 'impression') as impressions,
               count(*) filter (where interaction_type = 'click') as clicks,
               count(*) filter (where interaction_type = 'complete') as completions from online group by model_version
        union all
        select 'experiment_id', experiment_id, count(*) filter (where interaction_type = 'impression'),
               count(*) filter (where interaction_type = 'click'), count(*) filter (where interaction_type = 'complete')
        from online group by experiment_id) where group_value is not null and group_value <> ''""", "online"),
    "a06_click_positions": with_views("""select position_in_list as position, count(*) as count from online
        where interaction_type = 'click' and position_in_list > 0 group by 1""", "online"),
    "w11_report_window": with_views("""select interaction_id from online
        where ts >= timestamp '2024-01-29' and ts <= timestamp '2024-01-30 12:00:00'""", "online"),
    "a07_perf_metrics": with_views(f"select {PERF_SEL} from {perf('inference_log')}", "inference_log"),
    "a08_metric_change": lw("select metric, round(value, 6) as value from chg"),
    "a37_perf_alerts": lw("select alert_type, severity, metric_name, round(current_value, 6) as current_value, round(threshold_value, 6) as threshold_value from palerts"),
    "a49_perf_report": lw("""select pc.num_samples, round(pc.avg_total_latency_ms, 6) as avg_total_latency_ms,
        round(pc.latency_p99_ms, 6) as latency_p99_ms, round(pc.error_rate, 6) as error_rate,
        round(pc.avg_final_score, 6) as avg_final_score,
        round((select value from chg where metric = 'latency_change'), 6) as latency_change,
        round((select value from chg where metric = 'error_rate_change'), 6) as error_rate_change,
        (select count(*) from palerts) as n_alerts, (select status from pst) as status from pc"""),
    "a43_latency_summary": with_views("""select stage, count(v) as n, round(avg(v), 6) as mean, round(quantile_cont(v, 0.5), 6) as median,
        round(quantile_cont(v, 0.95), 6) as p95, round(quantile_cont(v, 0.99), 6) as p99, round(min(v), 6) as min,
        round(max(v), 6) as max, round(count(v) / (sum(v) / 1000.0), 6) as throughput_per_s
        from (select 'total' as stage, inference_latency_ms as v from inference_log
              union all select 'retrieval', retrieval_latency_ms from inference_log
              union all select 'ranking', ranking_latency_ms from inference_log) where v is not null group by stage""",
                                      "inference_log"),
    "a40_canary_gate": with_views("""WITH w AS (
          select cast(least(floor((day(ts) - 1) / 6), 4) as int) as "window", count(*) as num_samples,
                 count(*) filter (where len(recommendations) = 0) / count(*) as error_rate,
                 quantile_cont(inference_latency_ms, 0.99) as latency_p99_ms
          from inference_log group by 1),
        h AS (select *, not (error_rate > 0.05 or latency_p99_ms > 500) as healthy from w)
        select "window", [10, 25, 50, 75, 100]["window" + 1] as traffic_percent, num_samples,
               round(error_rate, 6) as error_rate, round(latency_p99_ms, 6) as latency_p99_ms, healthy,
               case when coalesce(max(case when healthy then 0 else 1 end) over (order by "window" rows between unbounded preceding and 1 preceding), 0) = 1
                    then 'skipped' when healthy then 'promote' else 'rollback' end as action
        from h""", "inference_log"),
}
