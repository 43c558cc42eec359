"""Oracle SQL (DuckDB) for ``q_misc``."""

from recframe.queries.sql_encoders import ALLV, RANKER, ew
from recframe.queries.sql_experiments import bucket
from recframe.queries.sql_labels import ENRICHED, PAIRS
from recframe.queries.sql_ranking import SCORED
from recframe.queries.views import with_views

TAGS = ("case when {c} is null or trim({c}) = '' or trim({c}) = '-' then []::varchar[] else "
        "list_filter(list_transform(string_split({c}, '|'), lambda x: lower(trim(x))), lambda x: x <> '') end")
Q = "chr(39)"


def tags(c: str) -> str:
    return TAGS.format(c=c)


def trunc(c: str) -> str:
    return f"case when length({c}) > 1000 then substring({c}, 1, 1000) || '...(' || cast(length({c}) as varchar) || ' chars)' else {c} end"


SQL = {
    "p01_canonicalise": with_views("""select u.id as user_id, u.country_code as country, u.preferred_language as user_language,
          v.duration as video_duration, v.language as video_language, v.manual_tags as tags
        from users u left join videos v on v.id = u.id""", "users", "videos"),
    "j05_preprocess_join": with_views("""select i.interaction_id, u.country_code as country, u.preferred_language as language, u.age,
          v.category, v.language as language_video
        from interactions i left join users u on i.user_id = u.id left join videos v on i.video_id = v.id""",
                                      "users", "videos", "interactions"),
    "p21_two_tower_columns": ew(f"{PAIRS} select * from pairs"),
    "p22_split_xy": ew(f"""{PAIRS} select user_id, video_id,
          case when len(t) = 0 then '[]' else '[' || {Q} || array_to_string(t, {Q} || ', ' || {Q}) || {Q} || ']' end as tags
        from (select user_id, video_id, {tags('tags')} as t from pairs)"""),
    "p23_train_feature_select": ew(f"""{RANKER}
        select label, """ + ", ".join(f"coalesce({c}, '[UNK]') as {c}" for c in
                                    ["device", "interaction_time_day", "country", "user_language", "category",
                                     "child_categories", "video_language", "popularity"]) + ", " + ", ".join(
        f"coalesce({c}, 0) as {c}" for c in ["interaction_time_hour", "age", "video_duration", "view_count", "like_count",
                                             "comment_count", "channel_subscriber_count"]) + " from rk"),
    "p24_mask_sensitive": f"""select doc_id, length({trunc('text')}) as text_len, substring({trunc('text')}, 995, 40) as text_tail,
          '***MASKED***' as headers_auth, {trunc('lang')} as headers_lang, '***MASKED***' as params_api_key,
          {trunc('lang')} as params_lang, '***MASKED***' as user_password from documents""",
    "p27_build_interaction": with_views("""select t || '_' || cast(interaction_id as varchar) as interaction_id, user_id, video_id,
          request_id as recommendation_request_id, ts, t as interaction_type,
          round(case when t = 'complete' then coalesce(video_duration_seconds, 0.0) when t = 'watch' then coalesce(watch_time_seconds, 0.0) else 0.0 end, 6) as watch_time_seconds,
          round(coalesce(video_duration_seconds, 0.0), 6) as video_duration_seconds,
          round(case when t = 'complete' then 1.0 when t = 'watch' and coalesce(video_duration_seconds, 0.0) > 0
                     then coalesce(watch_time_seconds, 0.0) / coalesce(video_duration_seconds, 0.0) else 0.0 end, 6) as completion_rate,
          coalesce(position_in_list, 0) as position_in_list, coalesce(model_version, '') as model_version,
          coalesce(experiment_id, '') as experiment_id
        from (select *, case when interaction_type = 'like' then 'watch' else interaction_type end as t from online)""", "online"),
    "p28_lookup_by_request": with_views("""select feedback_id, inference_id, video_id from feedback
        where inference_id = (select min(inference_id) from feedback)""", "feedback"),
    "r05_track_inference": with_views("""select 'inf_' || substr(md5(request_id), 1, 16) as inference_id, request_id, user_id,
          'prediction' as event_type, ts, cast(len(recommended_video_ids) as int) as num_recommendations from predictions""",
                                      "predictions"),
    "a44_tag_frequency": with_views(f"""select tag, count(*) as count from (select unnest({tags('manual_tags')}) as tag from videos)
        group by tag having count(*) >= 2""", "videos"),
    "a45_user_item_sets": with_views(f"""WITH {ENRICHED}
        select user_id, list_sort(list(distinct video_id)) as positive_videos from enriched where is_positive group by user_id""",
                                     "videos", "interactions"),
    "a50_catalogue_counts": ew(f"""{PAIRS}, {RANKER},
        tt AS (select *, case when {bucket("concat_ws('|', cast(user_id as varchar), cast(video_id as varchar), '42')")} < 8000 then 'train' else 'val' end as split from pairs),
        rs AS (select *, case when {bucket("concat_ws('|', interaction_id, '42')")} < 8000 then 'train' else 'val' end as split from rk)
        select 'users' as "table", count(*) as rows, count(distinct id) as distinct_ids from users
        union all select 'videos', count(*), count(distinct id) from videos
        union all select 'channels', count(*), count(distinct id) from channels
        union all select 'interactions', count(*), count(distinct interaction_id) from interactions
        union all select 'positive_interactions', count(*), count(distinct interaction_id) from enriched where is_positive
        union all select 'two_tower_' || split, count(*), count(distinct user_id) from tt group by split
        union all select 'ranker_' || split, count(*), count(distinct interaction_id) from rs group by split"""),
    "r05_tracked_predictions": with_views("""select 'inf_' || substr(md5(request_id), 1, 16) as inference_id, request_id, user_id,
          recommended_video_ids, ts, model_version, experiment_id, ts + interval 48 hour as expires_at from predictions""", "predictions"),
    "f07_watch_percentage": with_views("""select feedback_id, case when video_duration_seconds > 0
          then watch_time_seconds / video_duration_seconds else 0.0 end as watch_percentage from feedback""", "feedback"),
    "f09_one_hot_popularity": with_views("""select id, cast(popularity = 'low' as double) as popularity_low,
          cast(popularity = 'medium' as double) as popularity_medium, cast(popularity = 'high' as double) as popularity_high,
          cast(popularity = 'viral' as double) as popularity_viral from videos""", "videos"),
    "f10_engagement_ratios": ew(f"""{RANKER}
        select interaction_id, round(coalesce(like_count, 0) / coalesce(nullif(view_count, 0), 1), 6) as like_ratio,
               round(coalesce(comment_count, 0) / coalesce(nullif(view_count, 0), 1), 6) as comment_ratio,
               round(coalesce(like_count, 0) / coalesce(nullif(channel_subscriber_count, 0), 1), 6) as engagement_rate
        from rk"""),
    "k06_sorted_vocab": with_views("""select device, row_number() over (order by device) - 1 as idx
        from (select distinct device from interactions where device is not null)""", "interactions"),
    "e24_preprocess_job": with_views(f"""WITH {ALLV},
        st AS (select feature, avg(v) as m, case when coalesce(stddev_samp(v), 0) = 0 then 1.0 else stddev_samp(v) end as s from (
                 select 'video_duration' as feature, cast(duration as double) as v from videos
                 union all select 'view_count', view_count from videos union all select 'like_count', like_count from videos
                 union all select 'comment_count', comment_count from videos union all select 'age', age from users)
               where v is not null and not isnan(v) group by feature),
        j AS (select i.interaction_id, i.user_id, i.video_id, u.country_code as country, u.preferred_language as user_language,
                     u.age, v.category, v.language as video_language, v.popularity, v.duration as video_duration,
                     v.view_count, v.like_count, v.comment_count
              from interactions i left join users u on i.user_id = u.id left join videos v on i.video_id = v.id)
        select interaction_id, """ + ", ".join(
            f"coalesce((select idx from allv where vocab = '{c}' and value = cast(j.{c} as varchar)), 1) as {c}_idx"
            for c in ["user_id", "video_id", "country", "user_language", "category", "video_language", "popularity"]) + ", " + ", ".join(
            f"round((j.{c} - (select m from st where feature = '{c}')) / (select s from st where feature = '{c}'), 6) as {c}_normalized"
            for c in ["age", "video_duration", "view_count", "like_count", "comment_count"]) + " from j",
                                     "users", "videos", "interactions"),
    "a39_deploy_gate": with_views(f"""WITH {SCORED},
        rc AS (select avg(hit / rel) as recall_at_k from (
                 select query_id, sum(label) filter (where r <= 10) as hit, sum(label) as rel from ranked group by query_id) where rel > 0),
        nd AS (select avg(ndcg) as ndcg from (
                 select d.query_id, case when i.idcg > 0 then d.dcg / i.idcg else 0.0 end as ndcg
                 from (select query_id, coalesce(sum(label / log2(r + 1)) filter (where r <= 10), 0) as dcg from ranked group by query_id) d
                 join (select query_id, sum(label / log2(r3 + 1)) filter (where r3 <= 10) as idcg from (
                        select *, row_number() over (partition by query_id order by label desc, item_id) as r3 from scored) group by query_id) i
                 using (query_id))),
        au AS (select case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (cneg + neg / 2.0)) / (sum(pos) * sum(neg)) else 0 end as auc
               from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as cneg
                     from (select score as s, sum(case when label = 1 then 1 else 0 end) as pos,
                                  sum(case when label = 1 then 0 else 1 end) as neg from scored group by score))),
        g AS (select recall_at_k, ndcg, auc, recall_at_k >= 0.1 and ndcg >= 0.3 as tt, auc >= 0.6 and ndcg >= 0.3 as rk from rc, nd, au)
        select round(recall_at_k, 6) as recall_at_k, round(ndcg, 6) as ndcg, round(auc, 6) as auc, tt as two_tower_passed,
               rk as ranker_passed, tt and rk as should_deploy,
               case when not tt then concat_ws(', ', case when recall_at_k < 0.1 then printf('recall@k (%.4f) < 0.1', recall_at_k) end,
                                               case when ndcg < 0.3 then printf('ndcg (%.4f) < 0.3', ndcg) end) end as two_tower_reason,
               case when not rk then concat_ws(', ', case when auc < 0.6 then printf('auc (%.4f) < 0.6', auc) end,
                                               case when ndcg < 0.3 then printf('ndcg (%.4f) < 0.3', ndcg) end) end as ranker_reason
        from g""", "online"),
    "j24_item_feature_table": with_views("""select v.id as video_id, v.category, v.language as video_language,
          v.duration as video_duration, v.popularity, v.view_count, v.like_count, v.comment_count,
          cast(coalesce(c.subscriber_count, 0) as bigint) as channel_subscriber_count
        from videos v left join channels c on case when v.id % 10 = 3 then -1 - v.channel_id else v.channel_id end = c.id""", "videos", "channels"),
}
