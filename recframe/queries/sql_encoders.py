"""Oracle SQL (DuckDB) for ``q_encoders``."""

from recframe.queries.sql_labels import ENRICHED, PAIRS
from recframe.queries.sql_vectors import HASHED, TAGGED
from recframe.queries.views import with_views


def svocab(src: str, col: str, start: bool = False, mask: str | None = None, unk: str = "[UNK]") -> str:
    n = 3 if start else 2
    spec = f"select '[PAD]' as value, cast(0 as bigint) as idx union all select '{unk}', 1"
    if start:
        spec += " union all select '[START]', 2"
    cond = f" and cast({col} as varchar) <> '{mask}'" if mask else ""
    return (f"{spec} union all select value, {n - 1} + row_number() over (order by value) from "
            f"(select distinct cast({col} as varchar) as value from {src} where {col} is not null{cond})")


def ivocab(src: str, col: str) -> str:
    return (f"select value, 1 + row_number() over (order by value) as idx from "
            f"(select distinct cast({col} as bigint) as value from {src} where {col} is not null)")


def digitize(x: str, bounds) -> str:
    arr = "[" + ", ".join(f"cast({b} as double)" for b in bounds) + "]"
    return f"len(list_filter({arr}, lambda b: coalesce(cast({x} as double), 'nan'::double) >= b))"


ALLV = """
allv_src AS (
  select 'user_id' as vocab, cast(id as varchar) as value from users
  union select 'country', country_code from users
  union select 'user_language', preferred_language from users
  union select 'language', preferred_language from users
  union select 'video_id', cast(id as varchar) from videos
  union select 'category', category from videos
  union select 'video_language', language from videos
  union select 'language', language from videos
  union select 'popularity', popularity from videos),
allv AS (
  select vocab, value, 1 + row_number() over (partition by vocab order by value) as idx
  from allv_src where value is not null and value not in ('[PAD]', '[OOV]')
  union all select distinct vocab, '[PAD]', cast(0 as bigint) from allv_src where value is not null and value not in ('[PAD]', '[OOV]')
  union all select distinct vocab, '[OOV]', cast(1 as bigint) from allv_src where value is not null and value not in ('[PAD]', '[OOV]'))"""

LANGS = "(select preferred_language as v from users union select language from videos)"

USERF = f"""
uid_v AS ({ivocab('users', 'id')}),
country_v AS ({svocab('users', 'country_code')}),
lang_v AS ({svocab(LANGS, 'v')}),
catu_v AS ({svocab('videos', 'category', start=True, mask='-')}),
ustats AS (select avg(age) as m, stddev_pop(age) as s from users),
userf AS (
  select p.user_id, p.video_id,
         case when p.user_id is null then 0 else coalesce(a.idx, 1) end as user_id_idx,
         case when p.country is null then 0 else coalesce(b.idx, 1) end as country_idx,
         case when p.user_language is null then 0 else coalesce(c.idx, 1) end as user_language_idx,
         (p.age - (select m from ustats)) / ((select s from ustats) + 1e-8) as age_normalized,
         {digitize('p.age', [18, 25, 35, 45, 55, 65])} as age_bucket_idx,
         case when p.previously_watched_category is null then 0
              when p.previously_watched_category = '-' then 2 else coalesce(d.idx, 1) end as prev_category_idx
  from pairs p left join uid_v a on p.user_id = a.value left join country_v b on p.country = b.value
  left join lang_v c on p.user_language = c.value left join catu_v d on p.previously_watched_category = d.value)"""

VIDEOF = f"""
vid_v AS ({ivocab('videos', 'id')}),
catv_v AS ({svocab('videos', 'category')}),
vlang_v AS ({svocab(LANGS, 'v')}),
pop_v AS ({svocab("(select unnest(['low', 'medium', 'high', 'viral']) as p)", 'p')}),
vstats AS (select avg(ln(1 + duration)) as m, stddev_pop(ln(1 + duration)) as s from videos),
videof AS (
  select p.user_id, p.video_id,
         case when p.video_id is null then 0 else coalesce(a.idx, 1) end as video_id_idx,
         case when p.category is null then 0 else coalesce(b.idx, 1) end as category_idx,
         case when p.video_language is null then 0 else coalesce(c.idx, 1) end as video_language_idx,
         case when p.popularity is null then 0 else coalesce(d.idx, 1) end as popularity_idx,
         case when p.popularity = 'low' or p.popularity is null or p.popularity not in ('low', 'medium', 'high', 'viral') then cast(1 as double) else cast(0 as double) end as popularity_low,
         case when p.popularity = 'medium' then cast(1 as double) else cast(0 as double) end as popularity_medium,
         case when p.popularity = 'high' then cast(1 as double) else cast(0 as double) end as popularity_high,
         case when p.popularity = 'viral' then cast(1 as double) else cast(0 as double) end as popularity_viral,
         (ln(1 + p.video_duration) - (select m from vstats)) / ((select s from vstats) + 1e-8) as duration_log_normalized,
         {digitize('p.video_duration', [60, 300, 600, 1800, 3600])} as duration_bucket_idx
  from pairs p left join vid_v a on p.video_id = a.value left join catv_v b on p.category = b.value
  left join vlang_v c on p.video_language = c.value left join pop_v d on p.popularity = d.value)"""

RANKER = """
rk AS (
  select e.interaction_id, e.user_id, e.video_id, e.device, e.interaction_time_day, e.interaction_time_hour,
         cast(e.is_positive as int) as label, u.country_code as country, u.preferred_language as user_language,
         u.age, v.channel_id, v.category, v.child_categories, v.language as video_language, v.popularity,
         v.duration as video_duration, v.view_count, v.like_count, v.comment_count,
         c.subscriber_count as channel_subscriber_count
  from enriched e left join users u on e.user_id = u.id left join videos v on e.video_id = v.id
  left join channels c on v.channel_id = c.id)"""


def _round_all(cols: list[str], src: str) -> str:
    return "select " + ", ".join(cols) + f" from {src}"


def ew(body: str, *extra: str) -> str:
    return with_views(f"WITH {ENRICHED}, {body}", "users", "videos", "channels", "interactions", *extra)


ZEROS = "list_transform(range(64), lambda k: cast(0 as double))"


RANKER_STRINGS = ["country", "user_language", "category", "child_categories", "video_language", "device",
                  "interaction_time_day", "popularity"]
RANKER_INDEXED = {"country": "country_idx", "user_language": "user_language_idx", "category": "category_idx",
                  "video_language": "video_language_idx", "device": "device_idx",
                  "interaction_time_day": "day_idx", "popularity": "popularity_idx"}

RANKER_VOCABS = "rv_src AS (" + " union ".join(
    f"select '{c}' as vocab, cast({c} as varchar) as value from rk where {c} is not null" for c in RANKER_INDEXED if c != "popularity") + """
  union select 'popularity', unnest(['low', 'medium', 'high', 'viral'])
  union select 'child_categories', unnest(string_split(child_categories, '|')) from rk where child_categories is not null),
rv AS (select vocab, value, 1 + row_number() over (partition by vocab order by value) as idx from rv_src
  union all select distinct vocab, '[PAD]', 0 from rv_src union all select distinct vocab, '[UNK]', 1 from rv_src)"""


def ranker_sql(categoricals: str, extra: str = "") -> str:
    """Both forms of the ranker's feature row."""
    return ew(f"""{RANKER},
        st AS (select avg(age) as am, stddev_pop(age) as asd,
                      avg(ln(1 + video_duration)) filter (where video_duration is not null) as dm,
                      stddev_pop(ln(1 + video_duration)) filter (where video_duration is not null) as dsd from rk){', ' + extra if extra else ''}
        select interaction_id, {categoricals},
          round((coalesce(age, 30) - am) / (asd + 1e-8), 6) as age_normalized,
          {digitize('coalesce(age, 30)', [18, 25, 35, 45, 55, 65])} as age_bucket,
          round((ln(1 + coalesce(video_duration, 300)) - dm) / (dsd + 1e-8), 6) as duration_log_normalized,
          {digitize('coalesce(video_duration, 300)', [60, 300, 600, 1800, 3600])} as duration_bucket,
          round(ln(1 + coalesce(view_count, 0)), 6) as view_count_log,
          round(ln(1 + coalesce(like_count, 0)), 6) as like_count_log,
          round(coalesce(like_count, 0) / coalesce(nullif(view_count, 0), 1), 6) as like_ratio,
          round(ln(1 + coalesce(comment_count, 0)), 6) as comment_count_log,
          round(coalesce(comment_count, 0) / coalesce(nullif(view_count, 0), 1), 6) as comment_ratio,
          round(ln(1 + coalesce(channel_subscriber_count, 0)), 6) as subscriber_count_log,
          {digitize('coalesce(channel_subscriber_count, 0)', [10000, 100000, 1000000])} as subscriber_tier,
          round(coalesce(like_count, 0) / coalesce(nullif(channel_subscriber_count, 0), 1), 6) as engagement_rate,
          coalesce(interaction_time_hour, 12) as hour,
          round(sin(2 * pi() * coalesce(interaction_time_hour, 12) / 24.0), 6) as hour_sin,
          round(cos(2 * pi() * coalesce(interaction_time_hour, 12) / 24.0), 6) as hour_cos,
          label
        from rk, st""")


R = lambda c: f"round({c}, 6) as {c}"

SQL = {
    "e01_string_vocab": with_views(svocab("videos", "category", start=True, mask="-"), "videos"),
    "e02_integer_vocab": with_views(ivocab("interactions", "video_id"), "interactions"),
    "e03_inverse_lookup": with_views(f"""WITH v AS ({ivocab('videos', 'id')}),
        l AS (select i.interaction_id, i.video_id,
                     case when i.video_id is null then 0 else coalesce(v.idx, 1) end as video_id_idx
              from (select interaction_id, case when video_id % 11 = 0 then -1 - video_id else video_id end as video_id from interactions) i
              left join v on i.video_id = v.value)
        select l.*, case when l.video_id_idx = 0 then -1 when l.video_id_idx = 1 then -2 else v.value end as video_id_back
        from l left join v on l.video_id_idx = v.idx""", "videos", "interactions"),
    "e04_hash_bucket": with_views(f"""select id, cast(((('0x' || substr(md5(k), 1, 16))::UBIGINT % 1000) * {(1 << 64) % 1000}
          + ('0x' || substr(md5(k), 17, 16))::UBIGINT % 1000) % 1000 as bigint) as bucket
        from (select id, 'user:' || cast(id as varchar) as k from users)""", "users"),
    "e05_oov_vocab": with_views(svocab("users", "id", unk="[OOV]"), "users"),
    "e06_build_all_vocabs": with_views(f"WITH {ALLV} select vocab, value, idx from allv", "users", "videos"),
    "e07_apply_vocabs": ew(f"""{PAIRS}, {ALLV}
        select p.user_id, p.video_id, """ + ", ".join(
            f"coalesce((select idx from allv where vocab = '{c}' and value = cast(p.{c} as varchar)), 1) as {c}_idx"
            for c in ["user_id", "video_id", "country", "user_language", "category", "popularity"]) + " from pairs p"),
    "e08_zscore": with_views("""WITH s AS (select avg(view_count) as m, stddev_pop(view_count) as sd from videos),
        z AS (select id, (view_count - m) / (sd + 1e-8) as z, m, sd from videos, s)
        select id, round(z, 6) as z, round(z * sd + m, 6) as back from z""", "videos"),
    "e09_minmax": with_views("""WITH s AS (select min(duration) as lo, max(duration) as hi from videos),
        m AS (select id, case when hi - lo = 0 then 0.0 else (duration - lo) / (hi - lo) end * 2.0 + (-1.0) as scaled, lo, hi from videos, s)
        select id, round(scaled, 6) as scaled, round((scaled - (-1.0)) / 2.0 * (hi - lo) + lo, 6) as back from m""", "videos"),
    "e10_log_transform": with_views("""WITH s AS (select case when min(view_count) < 0 then -min(view_count) else 0 end as sh from videos),
        l AS (select id, log10(view_count + sh + 1) as logv from videos, s)
        select id, round(logv, 6) as logv, round(pow(10, logv) - 1, 6) as back from l""", "videos"),
    "e11_bucketize": with_views(f"""WITH b AS (select quantile_cont(cast(view_count as double), [0.2, 0.4, 0.6, 0.8]) as q from videos)
        select id, {digitize('duration', [60, 300, 600, 1800, 3600])} as duration_bucket,
               len(list_filter(q, lambda x: coalesce(cast(view_count as double), 'nan'::double) >= x)) as view_bucket
        from videos, b""", "videos"),
    "e12_cyclical": with_views("""select interaction_id,
          round(sin(2 * pi() * hour(make_timestamp(ts_epoch * 1000000)) / 24.0), 6) as hour_sin,
          round(cos(2 * pi() * hour(make_timestamp(ts_epoch * 1000000)) / 24.0), 6) as hour_cos
        from interactions""", "interactions"),
    "e13_compose": with_views("""WITH s AS (select avg(ln(1 + view_count)) as m, stddev_pop(ln(1 + view_count)) as sd from videos)
        select id, round((ln(1 + view_count) - m) / (sd + 1e-8), 6) as value from videos, s""", "videos"),
    "e14_user_features": ew(f"""{PAIRS}, {USERF}
        select user_id, video_id, user_id_idx, country_idx, user_language_idx, round(age_normalized, 6) as age_normalized,
               age_bucket_idx, prev_category_idx from userf"""),
    "e15_video_features": ew(f"""{PAIRS}, {VIDEOF}
        select * replace (round(duration_log_normalized, 6) as duration_log_normalized) from videof"""),
    "e26_transformed_pairs": ew(f"""{PAIRS}, {USERF}, {VIDEOF}
        select u.* replace (round(u.age_normalized, 6) as age_normalized),
               v.* exclude (user_id, video_id) replace (round(v.duration_log_normalized, 6) as duration_log_normalized)
        from userf u join videof v on u.user_id = v.user_id and u.video_id = v.video_id"""),
    "j03_ranker_star_join": ew(f"""{RANKER}
        select interaction_id, user_id, video_id, country, age, category, video_duration, channel_subscriber_count, label from rk"""),
    "e17_ranker_features": ranker_sql(", ".join(f"coalesce(cast({c} as varchar), 'UNKNOWN') as {c}" for c in RANKER_STRINGS)),
    "e17_ranker_features_index": ranker_sql(", ".join(
        f"case when {c} is null then 0 else coalesce((select idx from rv where vocab = '{c}' and value = cast(rk.{c} as varchar)), 1) end as {name}"
        for c, name in RANKER_INDEXED.items()), RANKER_VOCABS),
    "e17_ranker_vocabs": ew(f"{RANKER}, {RANKER_VOCABS} select vocab, value, idx from rv"),
    "e18_serving_features": ew(f"""{RANKER}
        select interaction_id, view_count, like_count, comment_count, channel_subscriber_count, interaction_time_hour, video_duration,
          round(ln(1 + view_count), 6) as view_count_log, round(ln(1 + like_count), 6) as like_count_log,
          round(ln(1 + comment_count), 6) as comment_count_log,
          round(ln(1 + channel_subscriber_count), 6) as channel_subscriber_count_log,
          round(sin(2 * pi() * interaction_time_hour / 24.0), 6) as hour_sin,
          round(cos(2 * pi() * interaction_time_hour / 24.0), 6) as hour_cos,
          round(ln(1 + video_duration), 6) as duration_log,
          round(like_count / greatest(channel_subscriber_count, 1), 6) as like_subscriber_ratio,
          round(comment_count / greatest(channel_subscriber_count, 1), 6) as comment_subscriber_ratio
        from rk"""),
    "e19_service_derived": ew(f"""{RANKER}
        select interaction_id, view_count, like_count, comment_count, channel_subscriber_count, video_duration,
          round(ln(1 + coalesce(video_duration, 0)), 6) as video_duration_log,
          round(ln(1 + coalesce(view_count, 0)), 6) as view_count_log,
          round(ln(1 + coalesce(like_count, 0)), 6) as like_count_log,
          case when coalesce(channel_subscriber_count, 0) < 10000 then 'micro'
               when coalesce(channel_subscriber_count, 0) < 100000 then 'small'
               when coalesce(channel_subscriber_count, 0) < 1000000 then 'mid' else 'macro' end as channel_tier,
          round(coalesce(like_count, 0) / greatest(coalesce(view_count, 0), 1), 6) as like_view_ratio,
          round(coalesce(comment_count, 0) / greatest(coalesce(view_count, 0), 1), 6) as comment_view_ratio
        from rk"""),
    "e15_video_embeddings": ew(f"""{PAIRS}, {HASHED.removeprefix("WITH ")}, {TAGGED}
        select p.user_id, p.video_id, list_transform(coalesce(h.u, {ZEROS}), lambda x: round(x, 6)) as title_embedding,
               list_transform(coalesce(t.te, {ZEROS}), lambda x: round(x, 6)) as tag_embedding
        from pairs p left join hv h on p.video_id = h.id left join tagged t on p.video_id = t.id""", "items"),
    "e23_feature_specs": with_views(f"""WITH {ALLV}
        select 'shared' as model, vocab as feature, 'vocabulary' as kind, cast(max(idx) + 1 as bigint) as size from allv group by vocab
        union all select 'user_tower' as model, 'user_id' as feature, 'vocabulary' as kind, count(distinct id) + 2 as size from users
        union all select 'user_tower', 'country', 'vocabulary', count(distinct country_code) + 2 from users
        union all select 'user_tower', 'language', 'vocabulary', count(distinct v) + 2 from {LANGS}
        union all select 'user_tower', 'category', 'vocabulary', count(distinct category) filter (where category <> '-') + 3 from videos
        union all select 'video_tower', 'video_id', 'vocabulary', count(distinct id) + 2 from videos
        union all select 'video_tower', 'category', 'vocabulary', count(distinct category) + 2 from videos
        union all select * from (values ('user_tower', 'age_bucket', 'vocabulary', 7), ('video_tower', 'popularity', 'vocabulary', 6),
          ('video_tower', 'duration_bucket', 'vocabulary', 6), ('user_tower', 'user_id', 'embedding', 32), ('user_tower', 'country', 'embedding', 16),
          ('user_tower', 'language', 'embedding', 16), ('user_tower', 'category', 'embedding', 32), ('user_tower', 'age_bucket', 'embedding', 8),
          ('video_tower', 'video_id', 'embedding', 32), ('video_tower', 'category', 'embedding', 32), ('video_tower', 'popularity', 'embedding', 4),
          ('video_tower', 'duration_bucket', 'embedding', 8), ('video_tower', 'title', 'embedding', 768), ('video_tower', 'tags', 'embedding', 100),
          ('ranker', 'label', 'label', 1))
        union all select 'ranker', unnest({RANKER_STRINGS}), 'categorical', 1
        union all select 'ranker', unnest(['age_normalized', 'age_bucket', 'duration_log_normalized', 'duration_bucket', 'view_count_log', 'like_count_log',
          'comment_count_log', 'like_ratio', 'comment_ratio', 'subscriber_count_log', 'subscriber_tier', 'engagement_rate', 'hour', 'hour_sin', 'hour_cos']),
          'numeric', 1""", "users", "videos"),
    "a23_normalization_stats": with_views("""WITH l AS (
          select 'duration' as feature, cast(duration as double) as v, false as is_log from videos
          union all select 'view_count', view_count, true from videos
          union all select 'like_count', like_count, true from videos
          union all select 'comment_count', comment_count, true from videos
          union all select 'age', age, false from users)
        select feature, round(avg(v), 6) as mean,
               round(case when coalesce(stddev_samp(v), 0) = 0 then 1.0 else stddev_samp(v) end, 6) as std,
               round(min(v), 6) as min, round(max(v), 6) as max,
               round(case when first(is_log) then avg(ln(1 + v)) end, 6) as log_mean,
               round(case when first(is_log) then case when coalesce(stddev_samp(ln(1 + v)), 0) = 0 then 1.0 else stddev_samp(ln(1 + v)) end end, 6) as log_std
        from l where v is not null and not isnan(v) group by feature""", "users", "videos"),
}
