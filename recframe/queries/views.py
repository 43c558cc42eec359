"""DuckDB texts of the entity adapters (``recframe.sources.adapters``).

Each oracle statement is prefixed with the views it needs as CTEs, so the
oracle reads the same raw tables the Spark query reads.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "users": """
        select c_custkey as id, n_name as country_code, c_mktsegment as preferred_language,
               cast(13 + c_custkey % 68 as int) as age
        from customer join nation on c_nationkey = n_nationkey""",
    "channels": """
        select s_suppkey as id, cast(floor(abs(s_acctbal) * 100) as bigint) as subscriber_count
        from supplier""",
    "videos": """
        select *, case when view_count > 1000000 then 'viral' when view_count > 100000 then 'high'
                       when view_count > 10000 then 'medium' else 'low' end as popularity,
               cast(floor(view_count / 20.0) as bigint) as like_count,
               cast(floor(view_count / 200.0) as bigint) as comment_count
        from (select p_partkey as id, 1 + p_partkey % (select count(*) from supplier) as channel_id,
                     p_size * 60 as duration, p_type as category, p_name as title,
                     replace(p_name, ' ', '|') as manual_tags, replace(p_name, ' ', '|') as child_categories,
                     case p_partkey % 5 when 0 then 'AUTOMOBILE' when 1 then 'BUILDING' when 2 then 'FURNITURE'
                                        when 3 then 'HOUSEHOLD' else 'MACHINERY' end as language,
                     cast(floor(p_retailprice * (p_partkey % 1000)) as bigint) as view_count
              from part) vb""",
    "interactions": """
        select interaction_id, user_id, video_id, interaction_type,
               case when interaction_type = 'watch'
                    then cast(cast(floor(l_quantity * 40) as int) as varchar) || ' seconds'
                    when interaction_type = 'comment' then 'Great video!' else '-' end as interaction_value,
               previously_watched_video, ts_epoch, device
        from (select concat_ws('-', cast(l_orderkey as varchar), cast(l_linenumber as varchar),
                               cast(l_partkey as varchar), cast(l_suppkey as varchar), strftime(l_shipdate, '%Y%m%d'),
                               cast(cast(round(l_extendedprice * 100) as bigint) as varchar)) as interaction_id,
                     o_custkey as user_id,
                     l_partkey as video_id, l_quantity,
                     case when l_returnflag = 'N' and l_linestatus = 'O' then 'watch'
                          when l_returnflag = 'N' then 'impression'
                          when l_returnflag = 'R' and l_linestatus = 'O' then 'watch'
                          when l_returnflag = 'R' then 'click'
                          when l_linestatus = 'O' then 'like'
                          when l_linenumber % 2 = 0 then 'dislike' else 'comment' end as interaction_type,
                     case when l_linenumber % 3 = 0 then null else l_suppkey end as previously_watched_video,
                     cast(epoch(l_shipdate) as bigint) + l_linenumber * 3600 as ts_epoch,
                     case l_linenumber % 4 when 0 then 'Mobile' when 1 then 'Desktop'
                                           when 2 then 'Laptop' else 'Tablet' end as device
              from lineitem join orders on l_orderkey = o_orderkey) ib""",
    "online": """
        select event_id as interaction_id, user_id,
               cast(json_extract_string(props, '$.k') as bigint) as video_id,
               'req_' || cast(user_id as varchar) || '_' || strftime(ts, '%Y%m%d') as request_id,
               ts,
               case event_type when 'view' then 'impression' when 'click' then 'click'
                               when 'purchase' then 'complete' when 'signup' then 'like'
                               else 'dislike' end as interaction_type,
               value as watch_time_seconds,
               cast(60 as double) * (1 + cast(json_extract_string(props, '$.k') as bigint) % 50)
                   as video_duration_seconds,
               cast(1 + event_id % 10 as int) as position_in_list,
               'v' || cast(1 + user_id % 2 as varchar) as model_version,
               'exp_1' as experiment_id
        from events""",
    "predictions": """
        select 'inf_' || cast(user_id as varchar) || '_' || strftime(day, '%Y%m%d') as inference_id,
               'req_' || cast(user_id as varchar) || '_' || strftime(day, '%Y%m%d') as request_id,
               user_id,
               list_sort(list(video_id)) as recommended_video_ids,
               map_from_entries(list((video_id, score))) as video_scores,
               day as ts,
               day + interval 48 hour as expires_at,
               'v' || cast(1 + user_id % 2 as varchar) as model_version,
               'exp_1' as experiment_id
        from (select user_id, cast(date_trunc('day', ts) as timestamp) as day,
                     cast(json_extract_string(props, '$.k') as bigint) as video_id,
                     max(value) as score
              from events group by all) pv
        group by user_id, day""",
    "feedback": """
        select 'fb_' || cast(event_id as varchar) as feedback_id, event_id, user_id,
               case when event_id % 4 = 0 then k + 100 else k end as video_id,
               'inf_' || cast(user_id as varchar) || '_' || strftime(ts, '%Y%m%d') as inference_id,
               case event_type when 'view' then 'watch' when 'click' then 'click'
                               when 'purchase' then 'complete' when 'signup' then 'like'
                               else 'skip' end as interaction_type,
               ts, value as watch_time_seconds,
               cast(60 as double) * (1 + k % 50) as video_duration_seconds,
               value / (cast(60 as double) * (1 + k % 50)) as watch_percentage,
               case event_id % 4 when 0 then 'Mobile' when 1 then 'Desktop'
                                 when 2 then 'Laptop' else 'Tablet' end as device,
               cast(1 + event_id % 10 as int) as position_in_list
        from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events) fb""",
    "inference_log": """
        select request_id, ts, lat as inference_latency_ms, lat * 0.3 as retrieval_latency_ms,
               lat * 0.5 as ranking_latency_ms, recommendations
        from (select 'req_' || cast(user_id as varchar) || '_' || strftime(ts, '%Y%m%d') as request_id,
                     min(ts) as ts, 10.0 * count(*) + max(value) as lat,
                     coalesce(list({'video_id': cast(json_extract_string(props, '$.k') as bigint),
                                    'score': value / 500.0, 'retrieval_score': value / 1000.0,
                                    'ranker_score': value / 400.0})
                              filter (where event_type in ('view', 'click')), []) as recommendations
              from events group by 1) il""",
    "feature_records": """
        select o.interaction_id as request_id, o.ts,
               case when o.interaction_id % 13 = 0 then null else u.age end as age,
               v.duration, u.country_code as country, v.category
        from online o left join users u on o.user_id = u.id left join videos v on o.video_id = v.id""",
    "items": """
        select vec_id as id, embedding, 'Cat' || cast(label as varchar) as category
        from embeddings""",
}


def with_views(body: str, *names: str) -> str:
    """``WITH <views> <body>``; ``body`` may itself start with more CTEs
    written as ``name AS (...), ...`` after a leading comma-free list."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}" if names else body
