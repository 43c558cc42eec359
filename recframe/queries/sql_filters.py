"""Oracle SQL (DuckDB) for ``q_filters``."""

from recframe.queries.views import with_views

CANDS = """
cands AS (
  select c.inference_id, c.user_id, c.video_id, c.score, v.category, v.title,
         v.duration as video_duration, v.view_count, v.like_count, v.channel_id, v.language,
         c.video_id % 50 = 0 as is_nsfw, (v.view_count % 100) / cast(100 as double) as quality_score
  from (select inference_id, user_id, video_id, video_scores[video_id] as score
        from (select inference_id, user_id, video_scores, unnest(recommended_video_ids) as video_id
              from predictions) x) c
  left join videos v on c.video_id = v.id
),
completes AS (select distinct user_id, video_id from online where interaction_type = 'complete'),
prefs AS (
  select id as user_id, case when id % 3 = 0 then 600 end as min_duration,
         case when id % 3 = 1 then 1800 end as max_duration,
         case when id % 5 = 0 then ['ECONOMY'] end as blocked_categories
  from users
)"""


def _reason(with_prefs: bool) -> str:
    mn = "coalesce(p.min_duration, 0)" if with_prefs else "0"
    mx = "coalesce(p.max_duration, 7200)" if with_prefs else "7200"
    blk = "coalesce(p.blocked_categories, ['PROMO'])" if with_prefs else "['PROMO']"
    join = "left join prefs p on c.user_id = p.user_id" if with_prefs else ""
    return f"""
  select c.*, case
    when x.user_id is not null then 'exclusion: recently watched or blocked'
    when list_contains({blk}, coalesce(c.category, '')) then 'category: blocked (' || coalesce(c.category, '') || ')'
    when coalesce(c.video_duration, 0) > 0 and coalesce(c.video_duration, 0) < {mn}
      then 'duration: too short (' || cast(coalesce(c.video_duration, 0) as varchar) || 's)'
    when coalesce(c.video_duration, 0) > 0 and coalesce(c.video_duration, 0) > {mx}
      then 'duration: too long (' || cast(coalesce(c.video_duration, 0) as varchar) || 's)'
    when coalesce(c.is_nsfw, false) then 'content: NSFW flagged'
    when coalesce(c.quality_score, 1.0) < 0.3 then 'quality: low score (' || printf('%.2f', coalesce(c.quality_score, 1.0)) || ')'
    when coalesce(c.view_count, 0) < 1000 then 'engagement: low views (' || cast(coalesce(c.view_count, 0) as varchar) || ')'
    when c.channel_id is not null and c.channel_id <> 0 and c.channel_id in (1, 2, 3)
      then 'channel: blocked (' || cast(c.channel_id as varchar) || ')'
    end as reason
  from cands c left join completes x on c.user_id = x.user_id and c.video_id = x.video_id {join}"""


def cw(body: str) -> str:
    return with_views(f"WITH {CANDS} {body}", "users", "videos", "online", "predictions")


SQL = {
    "p11_business_rules": with_views("""
        select id from videos
        where id % 7 <> 0 and coalesce(category, '') not in ('PROMO') and language = 'FURNITURE'
          and coalesce(duration, 0) >= 600 and (duration is null or duration <= 2400)""", "videos"),
    "p12_filter_reason": cw(f", r AS ({_reason(False)}) select inference_id, video_id, reason from r"),
    "p13_filter_prefs": cw(f", r AS ({_reason(True)}) select inference_id, video_id, reason from r"),
    "p14_duration_preference": cw("""
        select inference_id, video_id from (
          select *, case user_id % 4 when 0 then 'short' when 1 then 'medium' when 2 then 'long' else 'any' end as pref
          from cands) c
        where coalesce(video_duration, 0) >= case pref when 'short' then 0 when 'medium' then 300 when 'long' then 1200 else 0 end
          and (case pref when 'short' then 300 when 'medium' then 1200 end is null
               or coalesce(video_duration, 0) <= case pref when 'short' then 300 when 'medium' then 1200 end)"""),
    "p15_custom_filters": cw("""
        select inference_id, video_id, case
          when coalesce(video_duration, 0) > 0 and coalesce(video_duration, 0) < 0
            then 'duration: too short (' || cast(video_duration as varchar) || 's)'
          when coalesce(video_duration, 0) > 0 and coalesce(video_duration, 0) > 7200
            then 'duration: too long (' || cast(video_duration as varchar) || 's)'
          when contains(title, 'ring') then 'custom: ring in title'
          when channel_id % 2 = 1 then 'custom: odd channel' end as reason
        from cands"""),
    "p16_exclusion_filter": cw("""
        select c.inference_id, c.video_id from cands c
        where not exists (select 1 from completes x where x.user_id = c.user_id and x.video_id = c.video_id)
          and c.video_id not in (select id from videos where id % 10 = 0)"""),
    "j21_watched_exclusion": with_views("""
        select distinct user_id, video_id from feedback
        where interaction_type in ('watch') and ts >= timestamp '2024-01-31' - interval 7 day
          and ts <= timestamp '2024-01-31'""", "feedback"),
    "a21_filter_stats": cw(f""", r AS ({_reason(True)}),
        t AS (select count(*) as total_input, count(*) filter (where reason is null) as total_passed,
                     count(reason) as total_filtered from r)
        select 'total_input' as metric, cast(total_input as double) as value from t
        union all select 'total_passed', cast(total_passed as double) from t
        union all select 'total_filtered', cast(total_filtered as double) from t
        union all select 'pass_rate', round(case when total_input > 0 then total_passed / total_input else 0 end, 6) from t
        union all select 'filtered:' || split_part(reason, ':', 1), cast(count(*) as double) from r
                  where reason is not null group by 1"""),
    "p25_popularity_tier": with_views("select id, view_count, popularity from videos", "videos"),
    "p26_channel_tier": with_views("""
        select id, subscriber_count, case when subscriber_count < 10000 then 'micro'
            when subscriber_count < 100000 then 'small' when subscriber_count < 1000000 then 'mid'
            else 'macro' end as tier from channels""", "channels"),
}
