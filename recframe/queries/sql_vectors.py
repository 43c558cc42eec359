"""Oracle SQL (DuckDB) for ``q_vectors`` (J15 is rows-only)."""

from recframe.queries.views import with_views

UNIT = "list_transform(cast({v} as double[]), lambda x: x / (sqrt(list_dot_product(cast({v} as double[]), cast({v} as double[]))) + 1e-8))"


def unit(v: str) -> str:
    return UNIT.format(v=v)


def topk_sql(qsrc: str, k: int) -> str:
    return f"""(select * from (
        select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank
        from (select q.query_id, i.id as item_id, list_dot_product({unit('q.embedding')}, {unit('i.embedding')}) as score
              from {qsrc} q, items i)) where rank <= {k})"""


QALL = "(select id as query_id, embedding from items)"

RANKED30 = f"""
rl AS (select t.query_id as request_id, t.item_id as video_id, t.score, t.rank, i.category
       from {topk_sql(QALL, 30)} t join items i on t.item_id = i.id)"""

CTX = """
owc AS (select o.*, i.category from online o left join items i on o.video_id = i.id),
recent AS (select *, row_number() over (partition by user_id order by ts desc, interaction_id) as recency_rank from owc qualify recency_rank <= 50),
rcat AS (select user_id, category, row_number() over (partition by user_id order by f, category) as category_rank
         from (select user_id, category, min(recency_rank) as f from recent group by all) qualify category_rank <= 4),
ctx AS (select id as user_id, 'q_primary' as query_id, 'primary' as query_type, cast(null as varchar) as category, 0 as query_index from users
        union all select user_id, 'q_cat_' || cast(category_rank - 1 as varchar), 'category', category, cast(category_rank as int)
        from rcat where category_rank <= 4),
cq AS (select c.*, cast(c.user_id as varchar) || '|' || c.query_id as qkey, i.embedding
       from ctx c join items i on i.id = (c.user_id * 7 + coalesce(length(c.category), 0)) % (select count(*) from items)),
cres AS (select c.user_id, c.query_id, c.query_type, c.category, c.query_index, t.item_id as video_id, t.score
         from (select * from (select q.qkey as query_id, i.id as item_id,
                                     list_dot_product(""" + unit("q.embedding") + ", " + unit("i.embedding") + """) as score,
                                     row_number() over (partition by q.qkey order by list_dot_product(""" + unit("q.embedding") + ", " + unit("i.embedding") + """) desc, i.id) as rank
                              from cq q, items i) where rank <= 20) t
         join cq c on c.qkey = t.query_id),
merged AS (select * from (
  select user_id, video_id, case when sw > 0 then ssw / sw else 0.0 end + least(hits - 1, 3) * 0.05 as merged_score, hits, sources,
         row_number() over (partition by user_id order by case when sw > 0 then ssw / sw else 0.0 end + least(hits - 1, 3) * 0.05 desc, video_id) as rank
  from (select user_id, video_id, sum(score * w) as ssw, sum(w) as sw, count(*) as hits,
               list(query_id order by query_index, query_id) as sources
        from (select *, case query_type when 'primary' then 0.5 when 'category' then 0.3 else 0.2 end as w from cres) group by all))
  where rank <= 30)"""


def vw(body: str, *extra) -> str:
    return with_views(body, "items", *extra)


def cw(body: str) -> str:
    return with_views(f"WITH {CTX} {body}", "users", "online", "items", "videos")


SCORED_CANDS = f"""
{RANKED30.replace('30)', '20)')},
sc AS (select r.request_id, r.video_id, r.category, r.score as retrieval_score,
              coalesce(v.like_count / greatest(v.view_count, 1) * 10, 0.0) as ranker_score, r.rank
       from rl r left join videos v on r.video_id = v.id)"""


def blend(clip: bool) -> str:
    r = "least(greatest(retrieval_score, 0.0), 1.0)" if clip else "retrieval_score"
    k = "least(greatest(ranker_score, 0.0), 1.0)" if clip else "ranker_score"
    return f"0.3 * {r} + 0.7 * {k}"


def mmr(src: str, n: int, w: float, score: str = "score") -> str:
    return f"""(select * from (
        select *, row_number() over (partition by request_id order by
                    case when cnt <= {n} then -cast(rank as double) else {score} - {w} * j end desc, rank) as final_rank
        from (select *, row_number() over (partition by request_id, coalesce(category, 'Unknown') order by {score} desc, rank) - 1 as j,
                     count(*) over (partition by request_id) as cnt from {src}))
      where cnt <= {n} or final_rank <= {n})"""


SCANNED = f"""WITH t AS {topk_sql(QALL, 20)},
        f AS (select t.*, t.item_id % 50 = 1 or coalesce(i.category, '') in ('Cat9') or exists (
                select 1 from online o where o.interaction_type = 'complete' and o.user_id = t.query_id and o.video_id = t.item_id) as drop
              from t join items i on t.item_id = i.id),
        scanned AS (select * from (
          select *, coalesce(sum(case when drop then 0 else 1 end) over (partition by query_id order by score desc, item_id
                                                                         rows between unbounded preceding and 1 preceding), 0) as kept from f)
          where kept < 10)"""


HASHED = f"""WITH raw AS (select id, title, list_transform(range(64), lambda i:
            ('0x' || substr(md5(title || '#' || cast(i as varchar)), 1, 8))::UBIGINT / 2147483648.0 - 1.0) as r from videos),
        hv AS (select id, title, {unit('r')} as u from raw)"""

# unit mean of the vectors of a video's tags; zeros without a known tag
TAGGED = f"""vt AS (select id, unnest(tags) as tag from (
            select id, case when manual_tags is null or trim(manual_tags) = '' or trim(manual_tags) = '-' then []::varchar[]
                            else list_filter(list_transform(string_split(manual_tags, '|'), lambda x: lower(trim(x))), lambda x: x <> '') end as tags
            from videos)),
        tv AS (select t.tag, i.embedding as vector from (select distinct tag from vt) t
               join items i on i.id = (length(t.tag) * 37) % (select count(*) from items)),
        dims AS (select vt.id, d, avg(cast(x as double)) as m from vt join (select tag, generate_subscripts(vector, 1) as d, unnest(vector) as x from tv) e using (tag) group by all),
        mv AS (select id, list(m order by d) as mean from dims group by id),
        nv AS (select id, {unit('mean')} as te from mv),
        tagged AS (select v.id, coalesce(nv.te, list_transform(range(64), lambda k: cast(0 as double))) as te from videos v left join nv on v.id = nv.id)"""


SQL = {
    "j14_vector_topk_exact": vw(f"select query_id, item_id, round(score, 6) as score, rank from {topk_sql(QALL, 10)}"),
    "k01_global_topk": vw(f"select item_id, round(score, 6) as score, rank from {topk_sql('(select id as query_id, embedding from items where id = 0)', 10)}"),
    "r04_similar_items": vw(f"""select query_id, item_id, round(score, 6) as score, rank from (
        select query_id, item_id, score, row_number() over (partition by query_id order by score desc, item_id) as rank
        from {topk_sql(QALL, 6)} where query_id <> item_id) where rank <= 5"""),
    "a31_list_diversity": vw(f"""WITH t AS {topk_sql(QALL, 10)},
        u AS (select t.query_id, t.item_id, {unit('i.embedding')} as u from t join items i on t.item_id = i.id),
        dims AS (select query_id, d, sum(x) as s from (select query_id, generate_subscripts(u, 1) as d, unnest(u) as x from u) group by all),
        tot AS (select query_id, sum(s * s) as ss from dims group by query_id),
        sq AS (select query_id, sum(list_dot_product(u, u)) as n2, count(*) as k from u group by query_id)
        select query_id, round(case when k > 1 then 1 - (ss - n2) / (k * (k - 1)) end, 6) as diversity from tot join sq using (query_id)"""),
    "a46_in_batch_loss": vw(f"""WITH p AS (select cast(id // 16 as bigint) as batch_id, id % 16 as pos, {unit('embedding')} as u,
                                   {unit('list_reverse(embedding)')} as v from items),
        s AS (select a.batch_id, a.pos as i, b.pos as j, list_dot_product(a.u, b.v) / 0.05 as s from p a join p b on a.batch_id = b.batch_id),
        pi AS (select batch_id, i, max(s) as m, max(s) filter (where i = j) as sii,
                      arg_min(j, (-s, j)) as best, sum(exp(s - (select max(s) from s s2 where s2.batch_id = s.batch_id and s2.i = s.i))) as se
               from s group by batch_id, i)
        select batch_id, round(avg(m + ln(se) - sii), 6) as loss, round(avg(case when best = i then 1.0 else 0.0 end), 6) as accuracy
        from pi group by batch_id"""),
    "j11_embedding_lookup": with_views("""select v.id as video_id, cast(coalesce(len(i.embedding), 64) as int) as dim,
          round(coalesce(sqrt(list_dot_product(cast(i.embedding as double[]), cast(i.embedding as double[]))), 0.0), 6) as norm,
          list_transform(coalesce(cast(i.embedding as double[]), list_transform(range(64), lambda k: cast(0 as double))), lambda x: round(x, 6)) as embedding
        from videos v left join items i on v.id = i.id""", "videos", "items"),
    "e20_tag_embedding": with_views(f"""WITH {TAGGED}
        select id, list_transform(te, lambda x: round(x, 6)) as tag_embedding, round(coalesce(sqrt(list_dot_product(te, te)), 0.0), 6) as norm from tagged""",
                                    "videos", "items"),
    "e21_text_embedding": with_views(f"""{HASHED} select id, list_transform(u, lambda x: round(x, 6)) as embedding from hv""", "videos"),
    "e22_embedding_cache": with_views(f"""{HASHED} select id, title in (select title from videos where id < (select avg(id) from videos)) as cached,
          round(u[1], 6) as e0, round(u[64], 6) as e63 from hv""", "videos"),
    "f08_parse_tags": with_views("""select id, case when manual_tags is null or trim(manual_tags) = '' or trim(manual_tags) = '-' then []::varchar[]
          else list_filter(list_transform(string_split(manual_tags, '|'), lambda x: lower(trim(x))), lambda x: x <> '') end as tags
        from videos""", "videos"),
    "w03_recent_interactions": cw("select user_id, interaction_id, recency_rank from recent"),
    "w04_recent_categories": cw("select user_id, category, category_rank from rcat"),
    "f05_query_contexts": cw("select * from ctx"),
    "f04_merge_query_scores": cw("select user_id, video_id, round(merged_score, 6) as merged_score, hits, sources, rank from merged"),
    "f04_merge_summary": cw("""select c.user_id, count(*) as total_candidates, any_value(m.n) as unique_candidates, count(distinct c.category) as category_coverage
        from cres c left join (select user_id, count(*) as n from merged group by user_id) m using (user_id) group by c.user_id"""),
    "u06_multi_query_union": cw("select user_id, video_id, list(query_id order by query_index, query_id) as sources from cres group by all"),
    "w06_mmr_by_category": vw(f"WITH {RANKED30} select request_id, video_id, final_rank from {mmr('rl', 10, 0.1)}"),
    "w07_diversity_sample": vw(f"""WITH {RANKED30},
        p AS (select *, row_number() over (partition by request_id, coalesce(category, 'Unknown') order by score desc, rank) as pp,
                     count(*) over (partition by request_id) as cnt,
                     min(rank) over (partition by request_id, coalesce(category, 'Unknown')) as head from rl),
        k AS (select *, row_number() over (partition by request_id order by
                  case when cnt <= 10 then 0 when pp = 1 then 0 else 1 end,
                  case when cnt <= 10 or pp = 1 then cast(rank as double) else -score end,
                  case when cnt <= 10 or pp = 1 then 0 else head end, rank) as final_rank
              from p where cnt <= 10 or pp <= 3)
        select request_id, video_id, final_rank from k where cnt <= 10 or final_rank <= 10"""),
    "w08_required_categories": vw(f"""WITH {RANKED30},
        p AS (select *, list_position(['Cat1', 'Cat3'], category) as pos,
                     row_number() over (partition by request_id, category order by rank) as pp from rl),
        q AS (select *, coalesce(pos, 0) > 0 and pp = 1 as isreq from p),
        r AS (select *, sum(cast(isreq as int)) over (partition by request_id) as nreq,
                     row_number() over (partition by request_id order by isreq desc, case when isreq then pos else 0 end, rank) as final_rank from q)
        select request_id, video_id, final_rank from r where isreq or final_rank <= greatest(10, nreq)"""),
    "w14_label_ordered_list": vw(f"""WITH {RANKED30}
        select request_id, video_id, round(score, 6) as retrieval_score,
               row_number() over (partition by request_id order by score desc, video_id) as rank from rl"""),
    "f02_blend_scores": with_views(f"""WITH {SCORED_CANDS}
        select request_id, video_id, round({blend(True)}, 6) as final_score,
               row_number() over (partition by request_id order by {blend(True)} desc, video_id) as rank from sc""", "items", "videos"),
    "f03_blend_scores_raw": with_views(f"""WITH {SCORED_CANDS}
        select request_id, video_id, round({blend(False)}, 6) as final_score,
               row_number() over (partition by request_id order by {blend(False)} desc, video_id) as rank from sc""", "items", "videos"),
    "r02_recommend_mmr": with_views(f"""WITH {SCORED_CANDS},
        bl AS (select request_id, video_id, category, {blend(False)} as score,
                      row_number() over (partition by request_id order by {blend(False)} desc, video_id) as rank from sc)
        select request_id, video_id, round(score, 6) as score, final_rank from {mmr('bl', 10, 0.1)}""", "items", "videos"),
    "j16_retrieve_candidates": with_views(f"""{SCANNED}
        select query_id, item_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, item_id) as candidate_rank, num_filtered
        from (select *, count(*) filter (where drop) over (partition by query_id) as num_filtered from scanned) where not drop""", "items", "online"),
    "j16_retrieval_counts": with_views(f"""{SCANNED}
        select query_id, count(*) filter (where not drop) as num_candidates, count(*) filter (where drop) as num_filtered
        from scanned group by query_id""", "items", "online"),
    "j17_retrieve_batch": vw(f"""WITH t AS {topk_sql(QALL, 20)}
        select query_id, item_id, round(score, 6) as score, candidate_rank from (
          select *, row_number() over (partition by query_id order by score desc, item_id) as candidate_rank from t where item_id % 50 <> 1)
        where candidate_rank <= 10"""),
    "k05_over_fetch": vw(f"select query_id, item_id, rank from {topk_sql(QALL, 20)}"),
    "k04_request_cap": with_views("""select id, least(coalesce(case when id % 3 = 0 then null else cast(id % 250 as int) end, 20), 100) as num_results
        from users""", "users"),
    "j12_candidate_enrich": with_views(f"""WITH {CTX}
        select m.user_id, m.video_id, m.user_id as request_id,
               coalesce(u.country_code, 'US') as country, coalesce(u.preferred_language, 'en') as user_language,
               coalesce(u.age, 25) as age, coalesce(v.category, 'Unknown') as video_category,
               coalesce(v.child_categories, 'Unknown') as child_categories, coalesce(v.duration, 300) as video_duration,
               coalesce(v.popularity, 'low') as popularity, coalesce(v.view_count, 0) as view_count,
               coalesce(v.like_count, 0) as like_count, coalesce(v.comment_count, 0) as comment_count,
               coalesce(case when m.user_id % 2 = 0 then 'mobile' end, 'desktop') as device,
               coalesce(cast(m.user_id % 24 as int), 12) as hour, coalesce('Friday', 'Monday') as day
        from merged m left join users u on m.user_id = u.id left join videos v on m.video_id = v.id""",
                                       "users", "online", "items", "videos"),
    "p19_candidate_feature_row": with_views(f"""WITH {CTX}
        select m.user_id, m.video_id + 1900 as video_id, m.user_id as request_id,
               coalesce(u.country_code, 'US') as country, coalesce(u.preferred_language, 'en') as user_language,
               coalesce(u.age, 25) as age, coalesce(v.category, 'Unknown') as video_category,
               coalesce(v.child_categories, 'Unknown') as child_categories, coalesce(v.duration, 300) as video_duration,
               coalesce(v.popularity, 'low') as popularity, coalesce(v.view_count, 0) as view_count,
               coalesce(v.like_count, 0) as like_count, coalesce(v.comment_count, 0) as comment_count,
               'desktop' as device, 12 as hour, 'Monday' as day
        from merged m left join users u on m.user_id = u.id left join videos v on m.video_id + 1900 = v.id""",
                                            "users", "online", "items", "videos"),
    "j13_user_x_candidates": cw("select m.user_id, m.video_id, u.country_code, u.age from merged m join users u on m.user_id = u.id"),
    "p20_service_feature_row": with_views(f"""WITH {CTX}
        select m.user_id as request_id, m.video_id, coalesce(coalesce(u.age, 25), 0) as age,
               coalesce(coalesce(u.country_code, 'US'), '0') as country, 0 as gender,
               coalesce(coalesce(v.view_count, 0), 0) as view_count
        from merged m left join users u on m.user_id = u.id left join videos v on m.video_id = v.id""",
                                          "users", "online", "items", "videos"),
    "r03_precomputed_recs": cw("""select user_id, rank, video_id, round(coalesce(merged_score, 1.0), 6) as score,
          timestamp '2024-01-31 12:00:00' - interval 1 minute * (user_id % 90) as ts
        from merged where rank <= 10
          and timestamp '2024-01-31 12:00:00' - interval 1 minute * (user_id % 90) >= timestamp '2024-01-31 11:00:00'"""),
    "r01_recommend_batch": cw("""
        , mc AS (select m.user_id, m.video_id, m.merged_score as retrieval_score, i.category
                 from merged m left join items i on m.video_id = i.id),
        kept AS (select mc.* from mc
                 where not exists (select 1 from owc o where o.interaction_type = 'complete'
                                   and o.user_id = mc.user_id and o.video_id = mc.video_id)
                   and not list_contains(['Cat9'], coalesce(mc.category, ''))),
        sc AS (select k.*, coalesce(v.like_count / greatest(v.view_count, 1) * 10, 0.0) as ranker_score
               from kept k left join videos v on k.video_id = v.id),
        bl AS (select user_id, video_id, category,
                      0.3 * least(greatest(retrieval_score, 0.0), 1.0) + 0.7 * least(greatest(ranker_score, 0.0), 1.0) as score
               from sc),
        rk AS (select *, row_number() over (partition by user_id order by score desc, video_id) as rank from bl),
        p AS (select *, row_number() over (partition by user_id, coalesce(category, 'Unknown') order by score desc, rank) as pp,
                     count(*) over (partition by user_id) as cnt,
                     min(rank) over (partition by user_id, coalesce(category, 'Unknown')) as head from rk),
        k2 AS (select *, row_number() over (partition by user_id order by
                   case when cnt <= 10 then 0 when pp = 1 then 0 else 1 end,
                   case when cnt <= 10 or pp = 1 then cast(rank as double) else -score end,
                   case when cnt <= 10 or pp = 1 then 0 else head end, rank) as final_rank
               from p where cnt <= 10 or pp <= 3)
        select user_id, video_id, round(score, 6) as score, final_rank from k2 where final_rank <= 10"""),
}
