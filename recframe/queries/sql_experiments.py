"""Oracle SQL (DuckDB) for ``q_experiments``."""

from statistics import NormalDist

from recframe.queries.views import with_views

ZCRIT = NormalDist().inv_cdf(0.975)


def bucket(k: str, n: int = 10000) -> str:
    return (f"cast(((('0x' || substr(md5({k}), 1, 16))::UBIGINT % {n}) * {(1 << 64) % n} "
            f"+ ('0x' || substr(md5({k}), 17, 16))::UBIGINT % {n}) % {n} as bigint)")


def h60(k: str) -> str:
    return f"('0x' || substr(md5({k}), 1, 15))::BIGINT"


VM = """
vm AS (
  select variant, sample_size, impressions, clicks, completions, ctr as click_through_rate, se as ctr_std_error,
         case when impressions > 0 then greatest(0.0, ctr - 1.96 * se) else 0.0 end as ci_low,
         case when impressions > 0 then least(1.0, ctr + 1.96 * se) else 0.0 end as ci_high,
         case when clicks > 0 then completions / clicks else 0.0 end as completion_rate, avg_watch_time
  from (select *, case when impressions > 0 then sqrt(ctr * (1 - ctr) / impressions) else 0.0 end as se
        from (select *, case when impressions > 0 then clicks / impressions else 0.0 end as ctr
              from (select case model_version when 'v1' then 'control' when 'v2' then 'treatment' end as variant,
                           count(distinct user_id) as sample_size,
                           count(*) filter (where interaction_type = 'impression') as impressions,
                           count(*) filter (where interaction_type = 'click') as clicks,
                           count(*) filter (where interaction_type = 'complete') as completions,
                           coalesce(avg(watch_time_seconds) filter (where interaction_type in ('watch', 'complete')), 0.0) as avg_watch_time
                    from online where experiment_id = 'exp_1' and model_version in ('v1', 'v2') group by 1))))"""

VM_SEL = ", ".join(["variant", "sample_size", "impressions", "clicks", "completions"]
                   + [f"round({c}, 6) as {c}" for c in ["click_through_rate", "ctr_std_error", "ci_low", "ci_high",
                                                       "completion_rate", "avg_watch_time"]])

TEST = f"""
t0 AS (select max(click_through_rate) filter (where variant = 'control') as p1,
              max(click_through_rate) filter (where variant = 'treatment') as p2,
              max(impressions) filter (where variant = 'control') as n1, max(impressions) filter (where variant = 'treatment') as n2,
              max(clicks) filter (where variant = 'control') as c1, max(clicks) filter (where variant = 'treatment') as c2 from vm),
t1 AS (select *, case when n1 > 0 and n2 > 0 then sqrt(((c1 + c2) / (n1 + n2)) * (1 - (c1 + c2) / (n1 + n2)) * (1 / n1 + 1 / n2)) end as se from t0),
t2 AS (select *, case when se > 0 then (p2 - p1) / se end as z_score from t1),
t3 AS (select *, coalesce(abs(z_score) > {ZCRIT!r}, false) as sig from t2)"""

RANKED = f"""
uscored AS (select user_id, video_id as item_id, max(watch_time_seconds) / 500 as score from online group by user_id, video_id),
ranked AS (select 'u' || cast(user_id as varchar) as request_id, item_id as video_id, score as ranker_score,
                  row_number() over (partition by user_id order by score desc, item_id) as rank from uscored),
b AS (select *, count(*) over (partition by request_id) as n, {bucket('request_id')} < 2000 as sreq from ranked),
c AS (select *, sreq and rank > 10 and rank <= least(n, 30) as in_pool,
             {h60("request_id || ':' || cast(video_id as varchar)")} as key from b),
d AS (select *, case when sreq and least(n, 30) > 10 then least(3, sum(case when in_pool then 1 else 0 end) over (partition by request_id), 3) else 0 end as m from c),
samples AS (select request_id, video_id, rank as original_rank,
                   cast(floor((10 - m) / 2) as bigint) + key % ((10 - m) - cast(floor((10 - m) / 2) as bigint) + 1) + 0.5 as k, rn, true as is_sample
            from (select *, row_number() over (partition by request_id order by key, video_id) as rn from d where in_pool)
            where rn <= m),
top AS (select request_id, video_id, rank as original_rank, cast(rank as double) as k, 0 as rn, false as is_sample
        from d where rank <= 10 - m),
shown AS (select request_id, video_id, original_rank,
                 row_number() over (partition by request_id order by k, rn) as displayed_position, is_sample
          from (select * from top union all select * from samples)),
fbk AS (select 'u' || cast(user_id as varchar) as r, video_id as v,
               max(case when interaction_type = 'click' then 1 else 0 end) as c,
               max(case when interaction_type = 'complete' then 1 else 0 end) as dn,
               sum(case when interaction_type in ('watch', 'complete') then watch_time_seconds else 0.0 end) as w,
               max(case when interaction_type = 'like' then 'like' when interaction_type = 'dislike' then 'dislike' end) as e
        from online group by 1, 2),
sfb AS (select s.*, coalesce(f.c = 1, false) as was_clicked, coalesce(f.dn = 1, false) as was_completed,
               coalesce(f.w, 0.0) as watch_time_seconds, f.e as explicit_feedback
        from shown s left join fbk f on s.request_id = f.r and s.video_id = f.v)"""


def rw(body: str) -> str:
    return with_views(f"WITH {RANKED} {body}", "online")


SQL = {
    "a11_experiment_report_no_data": with_views("""select 'exp_0' as experiment_id, min(ts) as start_time, max(ts) as end_time,
          coalesce((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 0) as duration_hours, cast(null as double) as z_score, cast(1 as double) as p_value,
          cast(0 as double) as relative_improvement, false as is_significant, cast(null as varchar) as winner,
          case when count(*) = 0 then 'Insufficient data for analysis' end as recommendation
        from online where experiment_id = 'exp_0'""", "online"),
    "f01_ab_assign": with_views(f"""select user_id, round(b / 10000.0, 6) as bucket,
          case when b / 10000.0 < 0.5 then 'control' when b / 10000.0 < 1.0 then 'treatment' else 'treatment' end as variant,
          case when b / 10000.0 < 0.5 then 'v1' when b / 10000.0 < 1.0 then 'v2' else 'v2' end as model_version
        from (select id as user_id, {bucket("'exp_1:' || cast(id as varchar)")} as b from users)""", "users"),
    "a09_variant_metrics": with_views(f"WITH {VM} select {VM_SEL} from vm", "online"),
    "a10_two_proportion_test": with_views(f"""WITH {VM}, {TEST}
        select 'control' as control, 'treatment' as treatment, round(z_score, 6) as z_score,
               round(case when z_score is not null and p1 > 0 then (p2 - p1) / p1 else 0.0 end, 6) as relative_improvement,
               sig as is_significant, case when sig then case when p2 > p1 then 'treatment' else 'control' end end as winner
        from t3""", "online"),
    "w12_inject_exploration": rw("select * from shown"),
    "j23_sample_feedback": rw("select * replace (round(watch_time_seconds, 6) as watch_time_seconds) from sfb"),
    "a12_sampled_quality": rw("""
        , q AS (select count(*) filter (where is_sample) as total_samples,
                       count(*) filter (where is_sample and was_clicked) as clk,
                       count(*) filter (where is_sample and was_completed) as cmp,
                       coalesce(avg(watch_time_seconds) filter (where is_sample and watch_time_seconds > 0), 0.0) as avg_watch_time,
                       count(*) filter (where not is_sample and was_clicked) / count(*) filter (where not is_sample) as top_k_ctr
                from sfb),
        q2 AS (select *, case when total_samples > 0 then clk / total_samples else 0.0 end as sampled_ctr from q),
        q3 AS (select *, case when top_k_ctr > 0 then (top_k_ctr - sampled_ctr) / top_k_ctr else 0.0 end as ctr_gap from q2)
        select total_samples, round(sampled_ctr, 6) as sampled_ctr,
               round(case when clk > 0 then cmp / clk else 0.0 end, 6) as sampled_completion_rate,
               round(avg_watch_time, 6) as avg_watch_time, round(top_k_ctr, 6) as top_k_ctr, round(ctr_gap, 6) as ctr_gap,
               round(case when total_samples = 0 then 0.0 when top_k_ctr > 0 then least(1.0, ctr_gap) else 0.5 end, 6) as ranking_quality_score
        from q3"""),
    "a13_rank_tier_metrics": rw("""
        select tier, count(*) as sample_count, round(count(*) filter (where was_clicked) / count(*), 6) as ctr,
               round(avg(ranker_score), 6) as avg_ranker_score
        from (select s.*, r.ranker_score,
                     case when s.original_rank between 11 and 15 then 'tier_11_15' when s.original_rank between 16 and 20 then 'tier_16_20'
                          when s.original_rank between 21 and 25 then 'tier_21_25' when s.original_rank between 26 and 30 then 'tier_26_30' end as tier
              from sfb s left join ranked r on s.request_id = r.request_id and s.video_id = r.video_id
              where s.is_sample)
        where tier is not null group by tier"""),
}
