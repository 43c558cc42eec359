"""Oracle SQL (DuckDB) for the streaming batch replays."""

from recframe.queries.sql_experiments import bucket
from recframe.queries.sql_feedback import LABELS
from recframe.queries.views import with_views

EV = """
ev AS (select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as video_id,
              'inf_' || cast(user_id as varchar) || '_' || strftime(ts, '%Y%m%d') as inference_id,
              case event_type when 'view' then 'impression' when 'click' then 'click' when 'purchase' then 'watch'
                              when 'signup' then 'like' else 'dislike' end as event_type,
              ts, value / (cast(60 as double) * (1 + cast(json_extract_string(props, '$.k') as bigint) % 50)) as watch_percentage,
              value as watch_time_seconds, case when event_id % 4 = 0 then 'Mobile' else 'Desktop' end as device,
              cast(1 + event_id % 10 as int) as position_in_list from events)"""

SQL = {
    "st01_ingest_events": f"""WITH {EV}
        select event_id, user_id, video_id, inference_id, event_type as interaction_type, ts,
               coalesce(watch_percentage, 0.0) as watch_percentage, round(coalesce(watch_time_seconds, 0.0), 6) as watch_time_seconds,
               coalesce(device, 'unknown') as device, coalesce(position_in_list, 0) as position_in_list,
               case when event_type in ('like', 'comment', 'impression') then 1
                    when event_type = 'watch' and coalesce(watch_percentage, 0.0) >= 0.4 then 1 else 0 end as label,
               case when user_id is not null and video_id is not null then 'ok' else 'failed' end as status
        from ev where event_id % 97 <> 0
        union all
        select null, null, null, null, null, null, 0.0, 0.0, 'unknown', 0, 0, 'failed' from ev where event_id % 97 = 0""",
    "st02_raw_archive": with_views("select interaction_id, year(ts) as year, month(ts) as month, day(ts) as day from online", "online"),
    "st03_keyed_upsert": with_views("""select user_id, ts, video_id, interaction_id from online
        qualify row_number() over (partition by user_id, ts, video_id order by interaction_id desc) = 1""", "online"),
    "st04_stream_attribution": with_views("""select feedback_id, inference_id, inference_ts from (
          select f.feedback_id, p.inference_id, p.ts as inference_ts,
                 row_number() over (partition by f.feedback_id order by p.ts desc, p.inference_id desc) as rn
          from feedback f join (select user_id, inference_id, ts, unnest(recommended_video_ids) as vid from predictions) p
            on f.user_id = p.user_id and f.video_id = p.vid and p.ts <= f.ts and f.ts <= p.ts + interval 24 hour)
        where rn = 1""", "predictions", "feedback"),
    "st05_stream_merge": with_views(f"""WITH {LABELS}
        select l.inference_id, l.video_id, l.label, p.ts as inference_timestamp, l.feedback_timestamp, p.model_version
        from labels l join predictions p on l.inference_id = p.inference_id
        and p.ts <= l.feedback_timestamp and l.feedback_timestamp <= p.ts + interval 48 hour""", "predictions", "feedback"),
    "st06_recent_state": with_views("""WITH g AS (
          select user_id, video_id, ts,
                 sum(case when ts - prev > interval 24 hour then 1 else 0 end) over (partition by user_id order by ts) as day_part,
                 sum(case when ts - prev > interval 30 day then 1 else 0 end) over (partition by user_id order by ts) as month_part
          from (select *, lag(ts) over (partition by user_id order by ts) as prev from online)),
        recent AS (select *, row_number() over (partition by user_id order by ts desc, video_id) as r
                   from (select *, max(day_part) over (partition by user_id) as newest from g) where day_part = newest),
        seen AS (select user_id, video_id, max(ts) as ts
                 from (select *, max(month_part) over (partition by user_id) as newest from g) where month_part = newest group by all),
        watched AS (select *, row_number() over (partition by user_id order by ts desc, video_id) as r from seen)
        select user_id, a.recent_videos, b.watched_videos, a.last_ts
        from (select user_id, list(video_id order by r) as recent_videos, max(ts) as last_ts from recent where r <= 50 group by user_id) a
        join (select user_id, list(video_id order by video_id) as watched_videos from watched where r <= 1000 group by user_id) b using (user_id)""", "online"),
    "st07_inference_ttl": with_views("""select inference_id from predictions
        where ts >= (select max(ts) from predictions) - interval 48 hour""", "predictions"),
    "p17_capture_sample": with_views(f"""select request_id, ts, cast(null as varchar) as input_features,
          cast(len(recommendations) as int) as n from inference_log where {bucket('request_id')} < 2500""", "inference_log"),
    "st08_capture_log": with_views("""select request_id, ts, inference_latency_ms, cast(len(recommendations) as int) as n
        from inference_log""", "inference_log"),
    "st09_windowed_metrics": with_views("""select window_start, window_start + interval 15 minute as window_end,
          count(*) filter (where interaction_type = 'impression') as impressions,
          count(*) filter (where interaction_type = 'click') as clicks,
          count(*) filter (where interaction_type = 'complete') as completions, count(*) as events,
          round(case when count(*) filter (where interaction_type = 'impression') > 0
               then count(*) filter (where interaction_type = 'click') / count(*) filter (where interaction_type = 'impression') else 0.0 end, 6) as ctr
        from (select *, time_bucket(interval 15 minute, ts) as window_start from online) group by window_start""", "online"),
    "st09_sliding_metrics": with_views("""select window_start, window_start + interval 24 hour as window_end,
          count(*) filter (where interaction_type = 'impression') as impressions,
          count(*) filter (where interaction_type = 'click') as clicks,
          count(*) filter (where interaction_type = 'complete') as completions, count(*) as events,
          round(case when count(*) filter (where interaction_type = 'impression') > 0
               then count(*) filter (where interaction_type = 'click') / count(*) filter (where interaction_type = 'impression') else 0.0 end, 6) as ctr
        from (select *, date_trunc('hour', ts) - interval 1 hour * k as window_start
              from online, (select unnest(range(0, 24)) as k)) group by window_start""", "online"),
    "st10_windowed_quality": with_views("""WITH base AS (select avg(age) as m, stddev_pop(age) as s, [count(*) filter (where age < 20), count(*) filter (where age >= 20 and age < 30),
                   count(*) filter (where age >= 30 and age < 40), count(*) filter (where age >= 40 and age < 50), count(*) filter (where age >= 50 and age < 60),
                   count(*) filter (where age >= 60 and age < 70), count(*) filter (where age >= 70)] as e
                 from feature_records where ts < timestamp '2024-01-16'),
        w AS (select window_start, window_start + interval 24 hour as window_end, count(*) as count,
                 count(*) filter (where age is null) / count(*) as missing_rate, avg(age) as mean, stddev_pop(age) as std,
                 [count(*) filter (where age < 20), count(*) filter (where age >= 20 and age < 30),
                   count(*) filter (where age >= 30 and age < 40), count(*) filter (where age >= 40 and age < 50), count(*) filter (where age >= 50 and age < 60),
                   count(*) filter (where age >= 60 and age < 70), count(*) filter (where age >= 70)] as bins
              from (select *, time_bucket(interval 2 hour, ts) - interval 2 hour * k as window_start
                    from feature_records, (select unnest(range(0, 12)) as k)) group by window_start having count(*) >= 100)
        select window_start, window_end, count, round(missing_rate, 6) as missing_rate, round(mean, 6) as mean, round(std, 6) as std, bins,
               round(case when s = 0 then 0.0 else least(1 - 1 / (1 + abs(mean - m) / s), 1.0) end, 6) as drift_score,
               round(least(list_sum(list_transform(range(1, 8), lambda i:
                 (greatest(coalesce(bins[i] / nullif(list_sum(bins), 0), 0.0), 1e-4) - greatest(e[i] / list_sum(e), 1e-4))
                 * ln(greatest(coalesce(bins[i] / nullif(list_sum(bins), 0), 0.0), 1e-4) / greatest(e[i] / list_sum(e), 1e-4)))) / 0.5, 1.0), 6) as psi_score
        from w, base""", "users", "videos", "online", "feature_records"),
    "st11_session_window": with_views("""select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end,
          count(*) as events from (
          select *, sum(case when prev is null or ts - prev >= interval 30 minute then 1 else 0 end)
                    over (partition by user_id order by ts rows between unbounded preceding and current row) as sid
          from (select *, lag(ts) over (partition by user_id order by ts) as prev from online))
        group by user_id, sid""", "online"),
    "st12_alert_cooldown": with_views("""WITH al AS (
          select case when len(recommendations) = 0 then 'no_recommendations'
                      when inference_latency_ms > 450 then 'high_latency' end as alert_type, ts, request_id
          from inference_log),
        fires AS (
          select alert_type, min(ts) as ts from al where alert_type is not null group by alert_type
          union all
          select f.alert_type, min(al.ts) as ts from fires f join al on al.alert_type = f.alert_type and al.ts >= f.ts + interval 30 minute
          group by f.alert_type)
        select alert_type, ts, min(request_id) as request_id from fires join al using (alert_type, ts) group by alert_type, ts""",
                                      "inference_log").replace("WITH", "WITH RECURSIVE", 1),
    "st13_late_labels": with_views("""select feedback_id, max(p.ts) as newest_prediction, first(f.ts) as ts
        from feedback f join (select user_id, ts, unnest(recommended_video_ids) as vid from predictions) p
          on f.user_id = p.user_id and f.video_id = p.vid and p.ts <= f.ts
        group by feedback_id having first(f.ts) > max(p.ts) + interval 24 hour""", "predictions", "feedback"),
}
