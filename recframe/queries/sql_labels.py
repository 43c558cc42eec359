"""Oracle SQL (DuckDB) for ``q_labels``."""

from recframe.queries.views import with_views

_RATIO_SECS = r"try_cast(regexp_extract(i.interaction_value, '^\s*(\S+)', 1) as int)"

ENRICHED = f"""
enriched AS (
  select e.*,
         case when interaction_type = 'dislike' then false
              when interaction_type = 'watch' then watch_ratio >= 0.4
              when interaction_type = 'impression' then true
              else interaction_type in ('like', 'comment', 'click', 'share') end as is_positive
  from (select i.*, coalesce(pv.category, '-') as previously_watched_category,
               upper(dayname(make_timestamp(i.ts_epoch * 1000000))) as interaction_time_day,
               hour(make_timestamp(i.ts_epoch * 1000000)) as interaction_time_hour,
               case when i.interaction_type <> 'watch' or coalesce(dv.duration, 300) = 0
                         or {_RATIO_SECS} is null then cast(0 as double)
                    else least({_RATIO_SECS} / coalesce(dv.duration, 300), cast(1 as double)) end
                 as watch_ratio
        from interactions i
        left join videos pv on i.previously_watched_video = pv.id
        left join videos dv on i.video_id = dv.id) e
)"""


PAIRS = """
firsts AS (select user_id, video_id, previously_watched_category from enriched where is_positive
           qualify row_number() over (partition by user_id, video_id order by ts_epoch, interaction_id) = 1),
pairs AS (
  select f.user_id, u.country_code as country, u.preferred_language as user_language, u.age,
         f.previously_watched_category, f.video_id, v.category, v.title,
         v.duration as video_duration, v.popularity, v.language as video_language, v.manual_tags as tags
  from firsts f left join users u on f.user_id = u.id left join videos v on f.video_id = v.id
)"""


def enr(body: str, *extra: str) -> str:
    return with_views(f"WITH {ENRICHED} {body}", "videos", "interactions", *extra)


SQL = {
    "p02_watch_ratio": enr("select interaction_id, round(watch_ratio, 6) as watch_ratio from enriched"),
    "p03_is_positive": enr("select interaction_id, interaction_type, is_positive from enriched"),
    "p04_positives": enr("select interaction_id, user_id, video_id from enriched where is_positive"),
    "p04_negatives": enr("select interaction_id, user_id, video_id from enriched where not is_positive"),
    "p05_is_positive_simple": with_views(
        "select interaction_id, interaction_type in ('watch', 'like', 'comment') as is_positive "
        "from interactions", "interactions"),
    "f06_time_features": with_views(
        "select interaction_id, upper(dayname(make_timestamp(ts_epoch * 1000000))) as interaction_time_day, "
        "hour(make_timestamp(ts_epoch * 1000000)) as interaction_time_hour from interactions",
        "interactions"),
    "j01_prev_category": with_views(
        "select i.interaction_id, coalesce(v.category, '-') as previously_watched_category "
        "from interactions i left join videos v on i.previously_watched_video = v.id",
        "videos", "interactions"),
    "j02_enrich_interactions": enr(
        "select * replace (round(watch_ratio, 6) as watch_ratio) from enriched"),
    "j04_two_tower_pairs": enr("""
        , firsts AS (select user_id, video_id, previously_watched_category from enriched where is_positive
                     qualify row_number() over (partition by user_id, video_id
                                                order by ts_epoch, interaction_id) = 1)
        select f.user_id, u.country_code as country, u.preferred_language as user_language, u.age,
               f.previously_watched_category, f.video_id, v.category, v.title,
               v.duration as video_duration, v.popularity, v.language as video_language,
               v.manual_tags as tags
        from firsts f left join users u on f.user_id = u.id left join videos v on f.video_id = v.id""",
        "users"),
    "a22_label_distribution": enr(
        "select count(*) filter (where is_positive) as positive, "
        "count(*) filter (where not is_positive) as negative, count(*) as total from enriched"),
}
