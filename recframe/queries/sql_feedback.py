"""Oracle SQL (DuckDB) for ``q_feedback``."""

from recframe.queries.sql_experiments import bucket, h60
from recframe.queries.sql_labels import ENRICHED, PAIRS
from recframe.queries.views import with_views

LABELS = """
labels AS (
  select 'labeled_' || feedback_id as interaction_id, event_id, inference_id, user_id, video_id, label,
         interaction_type as label_source, cast(1.0 as double) as label_confidence, ts as feedback_timestamp,
         watch_time_seconds, watch_percentage, position_in_list as position_shown
  from (select *, case interaction_type when 'like' then 1 when 'dislike' then 0 when 'complete' then 1
                       when 'share' then 1 when 'skip' then 0 when 'click' then 1
                       when 'watch' then case when watch_percentage >= 0.4 and watch_time_seconds >= 30.0 then 1
                                              when watch_percentage < 0.1 then 0 end end as label
        from feedback where inference_id is not null and inference_id <> '') x
  where label is not null),
lat AS (select * from labels qualify row_number() over (partition by inference_id, video_id order by feedback_timestamp desc, event_id) = 1),
merged AS (
  select l.inference_id, l.user_id, l.video_id, p.ts as inference_timestamp, l.feedback_timestamp,
         coalesce(p.video_scores[l.video_id], 0.0) as predicted_score,
         cast(list_position(p.recommended_video_ids, l.video_id) as int) as predicted_rank,
         p.model_version, p.experiment_id, l.label, l.label_source, l.label_confidence,
         l.watch_time_seconds, l.watch_percentage, l.position_shown,
         (epoch_us(l.feedback_timestamp) - epoch_us(p.ts)) / 3.6e9 as label_delay_hours
  from lat l join predictions p on l.inference_id = p.inference_id
  where list_contains(p.recommended_video_ids, l.video_id))"""


def fw(body: str) -> str:
    return with_views(f"WITH {LABELS} {body}", "predictions", "feedback")


def r6(cols):
    return ", ".join(f"round({c}, 6) as {c}" for c in cols)


def key(cols, seed=42):
    return h60("concat_ws('|', " + ", ".join(f"cast({c} as varchar)" for c in cols) + f", '{seed}')")


def split_case(idx: str, n: str, tr: float, tv: float) -> str:
    return (f"case when {idx} < floor({n} * {tr!r}) then 'train' when {idx} < floor({n} * {tv!r}) then 'val' "
            f"else 'test' end")


TR, TV = 0.8 / (0.8 + 0.1 + 0.1), 0.8 / (0.8 + 0.1 + 0.1) + 0.1 / (0.8 + 0.1 + 0.1)  # shares of train, and of train and val
STR, STV = 0.8, 0.8 + 0.1
PTR, PTV = 0.7 / (0.7 + 0.15 + 0.15), 0.7 / (0.7 + 0.15 + 0.15) + 0.15 / (0.7 + 0.15 + 0.15)


def balance(src: str, keycol: str) -> str:
    return f"""(select * exclude (k, i, p, n) from (
        select s.*, {key([keycol])} as k,
               row_number() over (partition by label order by {key([keycol])}, {keycol}) - 1 as i,
               (select count(*) filter (where label = 1) from {src}) as p,
               (select count(*) filter (where label = 0) from {src}) as n
        from {src} s)
      where case when label = 1 then i < case when p = 0 or n = 0 then p when n < floor(p / 1.0) and p > floor(n * 1.0) then floor(n * 1.0) else p end
                 when label = 0 then i < case when p = 0 or n = 0 then n when n > floor(p / 1.0) then floor(p / 1.0) else n end
                 else true end)"""


SQL = {
    "p06_label_rules": fw("select interaction_id, label from labels"),
    "p07_label_event": with_views("""select feedback_id, case when interaction_type in ('like', 'comment', 'impression') then 1
        when interaction_type = 'watch' and coalesce(watch_percentage, 0.0) >= 0.4 then 1 else 0 end as label from feedback""",
                                  "feedback"),
    "p08_validate_event": with_views("""select status, count(*) as n from (
        select case when user_id is not null and video_id is not null and user_id <> 0 and video_id <> 0
                    then 'passed' else 'failed' end as status from feedback) group by status""", "feedback"),
    "p09_label_filter": fw("select interaction_id from labels where label_confidence >= 0.5 and label <> 0"),
    "j10_labels_with_prediction": fw("""select l.interaction_id, p.ts as inference_timestamp,
        round(coalesce(p.video_scores[l.video_id], 0.0), 6) as predicted_score, p.model_version, p.experiment_id
        from labels l left join predictions p on l.inference_id = p.inference_id"""),
    "w02_latest_label": fw("select inference_id, video_id, interaction_id, label from lat"),
    "j06_merge_predictions_labels": fw(f"""select * replace ({r6(['predicted_score', 'label_confidence', 'watch_time_seconds',
        'label_delay_hours'])}) from merged"""),
    "a16_merge_stats": fw("""select 'ALL' as model_version, count(*) filter (where label = 1) as positive,
          count(*) filter (where label = 0) as negative, count(*) as total,
          (select count(*) from labels) - count(*) as records_unmatched,
          round(coalesce(avg(label_delay_hours), 0.0), 6) as avg_label_delay_hours from merged
        union all
        select case when coalesce(model_version, '') = '' then 'unknown' else model_version end,
               count(*) filter (where label = 1), count(*) filter (where label = 0), count(*), null, null
        from merged group by 1"""),
    "j07_merge_windowed": fw(f"""select l.inference_id, l.user_id, l.video_id, p.ts as inference_timestamp,
          l.feedback_timestamp, round(coalesce(p.video_scores[l.video_id], 0.0), 6) as predicted_score, p.model_version,
          cast(l.label as int) as label, l.label_source, round(coalesce(l.watch_time_seconds, 0.0), 6) as watch_time_seconds,
          coalesce(l.watch_percentage, 0.0) as watch_percentage
        from (select * from labels where inference_id is not null and video_id is not null and video_id <> 0
              qualify row_number() over (partition by inference_id, video_id order by event_id desc) = 1) l
        join predictions p on l.inference_id = p.inference_id
        where l.feedback_timestamp is null or p.ts is null
           or epoch_us(l.feedback_timestamp) - epoch_us(p.ts) <= {12 * 3_600_000_000}"""),
    "j08_merge_sql": fw("""select p.inference_id, p.user_id, l.video_id, p.ts as inference_timestamp, l.feedback_timestamp,
          round(p.video_scores[l.video_id], 6) as predicted_score, p.model_version, p.experiment_id, l.label,
          l.label_source, round(l.watch_time_seconds, 6) as watch_time_seconds, l.watch_percentage
        from predictions p join labels l on p.inference_id = l.inference_id
        where trunc((epoch_us(l.feedback_timestamp) - epoch_us(p.ts)) / 3600000000) <= 12
          and list_contains(p.recommended_video_ids, l.video_id)"""),
    "p18_ttl_filter": with_views("select inference_id from predictions where expires_at >= timestamp '2024-01-20'", "predictions"),
    "w05_user_predictions": with_views("""select user_id, inference_id from predictions where expires_at >= timestamp '2024-01-20'
        qualify row_number() over (partition by user_id order by ts desc, inference_id) <= 3""", "predictions"),
    "j09_attribute_feedback": with_views(f"""WITH up AS (
          select user_id, inference_id, ts as pts, unnest(list_distinct(recommended_video_ids)) as video_id
          from (select * from predictions where expires_at >= timestamp '2024-01-10'
                qualify row_number() over (partition by user_id order by ts desc, inference_id) <= 100)),
        att AS (select feedback_id, inference_id from (
          select f.feedback_id, up.inference_id,
                 row_number() over (partition by f.feedback_id order by up.pts desc, up.inference_id) as rn
          from feedback f join up on f.user_id = up.user_id and f.video_id = up.video_id
          where epoch_us(f.ts) - epoch_us(up.pts) <= {24 * 3_600_000_000}) where rn = 1)
        select f.feedback_id, a.inference_id as attributed_inference_id from feedback f left join att a using (feedback_id)""",
                                         "predictions", "feedback"),
    "a14_feedback_rollup": with_views("""select inference_id, video_id, count(*) as total_interactions,
          list_sort(list(distinct interaction_type)) as interaction_types,
          bool_or(interaction_type = 'click') as was_clicked, bool_or(interaction_type = 'complete') as was_completed,
          bool_or(interaction_type = 'like') as was_liked, bool_or(interaction_type = 'dislike') as was_disliked,
          round(coalesce(max(watch_time_seconds) filter (where watch_time_seconds > 0), 0.0), 6) as max_watch_time,
          round(coalesce(sum(watch_time_seconds) filter (where watch_time_seconds > 0), 0.0), 6) as total_watch_time
        from feedback where inference_id is not null group by inference_id, video_id""", "feedback"),
    "a15_collection_stats": fw("""select 'total_feedback' as metric, count(*) as value from feedback
        union all select 'linked_feedback', count(*) filter (where inference_id is not null) from feedback
        union all select 'unique_users', count(distinct user_id) from feedback
        union all select 'total_labels', count(*) from labels
        union all select 'positive_labels', count(*) filter (where label = 1) from labels
        union all select 'negative_labels', count(*) filter (where label = 0) from labels
        union all select 'by_type:' || interaction_type, count(*) from feedback group by interaction_type"""),
    "a17_retrain_summary": fw("""select count(*) as total_samples, count(*) filter (where label = 1) as positive_samples,
          count(*) filter (where label = 0) as negative_samples, count(distinct user_id) as unique_users,
          count(distinct video_id) as unique_videos, min(feedback_timestamp) as date_start, max(feedback_timestamp) as date_end,
          list_sort(list(distinct label_source)) as label_sources from merged"""),
    "a47_label_weighted_confidence": fw("""select label_source, round(avg(label_confidence), 6) as avg_confidence,
          count(*) as count, count(*) filter (where label = 1) as positive from labels group by label_source"""),
    "p10_flatten_features": with_views(f"""WITH {LABELS}
        select m.inference_id, m.video_id, cast(u.age as varchar) as user_age, u.country_code as user_country,
               u.preferred_language as user_language, 'Mobile' as context_device, '12' as context_hour
        from merged m left join users u on m.user_id = u.id""", "users", "predictions", "feedback"),
    "x01_random_split": fw(f"""select interaction_id, {split_case('i', 'n', TR, TV)} as split from (
        select interaction_id, row_number() over (order by {key(['interaction_id'])}, interaction_id) - 1 as i,
               count(*) over () as n from labels)"""),
    "w13_time_split": fw(f"""select interaction_id, {split_case('i', 'n', 0.8, 0.8 + 0.1)} as split from (
        select interaction_id, row_number() over (order by feedback_timestamp, interaction_id) - 1 as i,
               count(*) over () as n from labels)"""),
    "x02_stratified_split": fw(f"""select interaction_id, label, {split_case('i', 'n', STR, STV)} as split from (
        select interaction_id, label, row_number() over (partition by label order by {key(['interaction_id'])}, interaction_id) - 1 as i,
               count(*) over (partition by label) as n from labels)"""),
    "x03_two_stage_split": with_views(f"""WITH {ENRICHED}, {PAIRS}
        select user_id, video_id, {split_case('i', 'n', PTR, PTV)} as split from (
          select user_id, video_id, row_number() over (partition by popularity order by {key(['user_id', 'video_id'])}, user_id, video_id) - 1 as i,
                 count(*) over (partition by popularity) as n from pairs)""", "users", "videos", "interactions"),
    "x04_bernoulli_split": with_views(f"""WITH {ENRICHED}, {PAIRS}
        select user_id, video_id, case when {bucket("concat_ws('|', cast(user_id as varchar), cast(video_id as varchar), '42')")} < 8000
               then 'train' else 'val' end as split from pairs""", "users", "videos", "interactions"),
    "x05_balance_labels": fw(f"select interaction_id, label from {balance('labels', 'interaction_id')}"),
    "x06_retraining_dataset": fw(f""", mr AS (select *, inference_id || ':' || cast(video_id as varchar) as record_id from merged),
        bal AS (select * from {balance('mr', 'record_id')})
        select record_id, label, {split_case('i', 'n', TR, TV)} as split from (
          select record_id, label, row_number() over (order by {key(['record_id'])}, record_id) - 1 as i, count(*) over () as n from bal)"""),
    "x06_retraining_summary": fw(f""", mr AS (select *, inference_id || ':' || cast(video_id as varchar) as record_id from merged),
        bal AS (select * from {balance('mr', 'record_id')}),
        sp AS (select *, {split_case('i', 'n', TR, TV)} as split from (
          select *, row_number() over (order by {key(['record_id'])}, record_id) - 1 as i, count(*) over () as n from bal))
        select count(*) as total_samples, count(*) filter (where label = 1) as positive_samples, count(*) filter (where label = 0) as negative_samples,
               count(distinct user_id) as unique_users, count(distinct video_id) as unique_videos, count(*) filter (where split = 'train') as train_samples,
               count(*) filter (where split = 'val') as val_samples, count(*) filter (where split = 'test') as test_samples from sp"""),
    "x07_merge_gate": fw("select inference_id, video_id, label from merged where (select count(*) from labels) >= 100"),
    "u01_union_samples": with_views(f"""WITH {ENRICHED}
        select interaction_id, user_id, video_id, device, 1 as label from enriched where is_positive
        union all select interaction_id, user_id, null, null, 0 from enriched where not is_positive""",
                                    "videos", "interactions"),
    "u02_candidate_difference": with_views("""select distinct id as video_id from videos v
        where not exists (select 1 from interactions i where i.video_id = v.id)""", "videos", "interactions"),
    "u03_shared_vocab_union": with_views("select preferred_language as language from users union select language from videos",
                                         "users", "videos"),
    "u04_distinct_pairs": with_views("""select user_id, video_id, ts_epoch, interaction_id, interaction_type from interactions
        qualify row_number() over (partition by user_id, video_id order by ts_epoch, interaction_id) = 1""", "interactions"),
    "u05_category_universe": with_views("""select coalesce(b.category, c.category) as category, coalesce(b.n, 0) as base_count,
          coalesce(c.n, 0) as current_count
        from (select category, count(*) as n from feature_records where ts < timestamp '2024-01-16' group by 1) b
        full outer join (select category, count(*) as n from feature_records where ts >= timestamp '2024-01-16' group by 1) c
        on b.category = c.category""", "users", "videos", "online", "feature_records"),
}
