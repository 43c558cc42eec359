"""Oracle SQL (DuckDB) for ``q_ranking``."""

from recframe.queries.views import with_views

SCORED = """
scored AS (
  select request_id as query_id, user_id, video_id as item_id,
         max(watch_time_seconds) / 500 as score,
         max(case when interaction_type in ('click', 'like', 'complete') then cast(1 as double) else cast(0 as double) end) as label,
         cast(count(*) filter (where interaction_type in ('click', 'like', 'complete')) as double) as gain
  from online group by request_id, user_id, video_id
),
uscored AS (
  select user_id, video_id as item_id, max(watch_time_seconds) / 500 as score,
         max(case when interaction_type in ('click', 'like', 'complete') then cast(1 as double) else cast(0 as double) end) as label
  from online group by user_id, video_id
),
ranked AS (select *, row_number() over (partition by query_id order by score desc, item_id) as r from scored),
iranked AS (select *, row_number() over (partition by query_id order by gain desc, item_id) as r2 from scored),
rp AS (select *, sum(label) over (partition by query_id order by r rows between unbounded preceding and current row) / r as running_precision from ranked)"""


def sw(body: str) -> str:
    return with_views(f"WITH {SCORED} {body}", "online")


P5 = "select query_id, sum(label) filter (where r <= 5) / cast(5 as double) as precision from ranked group by query_id"
MRR = ("select query_id, coalesce(1.0 / min(r) filter (where label > 0), cast(0 as double)) as mrr "
       "from ranked group by query_id")
NDCG5 = """select d.query_id, case when i.idcg > 0 then d.dcg / i.idcg else cast(0 as double) end as ndcg
  from (select query_id, sum(gain / log2(r + 1)) as dcg from (select *, row_number() over (partition by query_id order by score desc, item_id) as r from scored) where r <= 5 group by query_id) d
  join (select query_id, sum(gain / log2(r2 + 1)) as idcg from iranked where r2 <= 5 group by query_id) i using (query_id)"""
MAP5 = """select query_id, case when sum(label) > 0 then sum(running_precision * label) / sum(label) else cast(0 as double) end as map
  from rp where r <= 5 group by query_id"""


def _user_metrics(ks=(5, 10, 20)) -> str:
    parts = ["""select 'mrr' as metric, coalesce(avg(mrr), 0) as value from (
        select user_id, coalesce(1.0 / min(r) filter (where label > 0), cast(0 as double)) as mrr
        from ur where n >= 2 group by user_id)"""]
    for k in ks:
        parts.append(f"""select 'ndcg@{k}' as metric, avg(ndcg) as value from (
          select d.user_id, case when i.idcg > 0 then d.dcg / i.idcg else 0 end as ndcg
          from (select user_id, sum(label / log2(r + 1)) as dcg from ur where n >= {k} and r <= {k} group by user_id) d
          join (select user_id, sum(label / log2(r2 + 1)) as idcg from ur where n >= {k} and r2 <= {k} group by user_id) i
          using (user_id)) having count(*) > 0""")
        parts.append(f"""select 'map@{k}' as metric, avg(ap) as value from (
          select user_id, case when sum(label) > 0 then sum(prc * label) / sum(label) else 0 end as ap
          from (select *, sum(label) over (partition by user_id order by r rows between unbounded preceding and current row) / r as prc
                from ur where n >= {k} and r <= {k}) group by user_id) having count(*) > 0""")
    body = "\nunion all ".join(f"select metric, round(value, 6) as value from ({p})" for p in parts)
    return f""", ur AS (select *, row_number() over (partition by user_id order by score desc, item_id) as r,
                         row_number() over (partition by user_id order by label desc, item_id) as r2,
                         count(*) over (partition by user_id) as n from uscored)
    {body}"""


EDGES = """, edges AS (select list_distinct(list_transform(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda x: round(x, 12))) as e from scored),
binned AS (select s.*, greatest(len(list_filter(e, lambda x: x < round(s.score, 12))) - 1, 0) as bin from scored s, edges)"""

SQL = {
    "w01_rank_topk": sw("select query_id, item_id, r as rank from ranked where r <= 5"),
    "a27_precision_at_k": sw(f"select query_id, round(precision, 6) as precision from ({P5})"),
    "a28_mrr": sw(f"select query_id, round(mrr, 6) as mrr from ({MRR})"),
    "a29_ndcg_at_k": sw(f"select query_id, round(ndcg, 6) as ndcg from ({NDCG5})"),
    "a30_map_at_k": sw(f"select query_id, round(map, 6) as map from ({MAP5})"),
    "w09_running_precision": sw("select query_id, item_id, r as rank, round(running_precision, 6) as running_precision from rp"),
    "a33_weighted_metrics": sw(f"""select round(sum(p.precision * w.w) / (count(*) + 1e-7), 6) as weighted_precision
        from ({P5}) p join (select query_id, 1.0 + first(user_id) % 3 as w from scored group by query_id) w using (query_id)"""),
    "a32_per_user_ranking_eval": sw(_user_metrics()),
    "a25_accuracy": sw("select round(avg(case when cast(score > 0.5 as int) = cast(label as int) then 1.0 else 0.0 end), 6) as accuracy from scored"),
    "a26_auc": sw("""select round(case when sum(pos) > 0 and sum(neg) > 0 then sum(pos * (cneg + neg / 2.0)) / (sum(pos) * sum(neg)) else 0 end, 6) as auc
        from (select *, coalesce(sum(neg) over (order by s rows between unbounded preceding and 1 preceding), 0) as cneg
              from (select score as s, sum(case when label = 1 then 1 else 0 end) as pos,
                           sum(case when label = 1 then 0 else 1 end) as neg from scored group by score))"""),
    "w10_quantile_bins": sw(EDGES + " select query_id, item_id, bin from binned"),
    "a24_lift_table": sw(EDGES + """ select bin, round(avg(score), 6) as score_mean, round(min(score), 6) as score_min,
        round(max(score), 6) as score_max, cast(sum(label) as bigint) as positive_count, count(*) as total_count,
        round(avg(label), 6) as conversion_rate,
        round(avg(label) / (select avg(label) from scored), 6) as lift from binned group by bin"""),
    "m04_ranker_eval": sw(f"""select round(avg(p.precision), 6) as precision_at_10, round(avg(m.mrr), 6) as mrr,
        round(avg(n.ndcg), 6) as ndcg_at_10, round(avg(a.map), 6) as map_at_10, count(*) as n_lists
        from ({P5.replace('5', '10')}) p join ({MRR}) m using (query_id)
        join ({NDCG5.replace('<= 5', '<= 10').replace('gain', 'label')}) n using (query_id)
        join ({MAP5.replace('<= 5', '<= 10')}) a using (query_id)"""),
}
