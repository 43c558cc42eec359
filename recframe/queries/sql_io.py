"""Oracle SQL (DuckDB) for ``q_io``: what was written, read back."""

from recframe.queries.sql_encoders import svocab
from recframe.queries.sql_feedback import LABELS, STR, STV, TR, TV, key, split_case
from recframe.queries.sql_misc import SQL as MISC
from recframe.queries.views import with_views

SPLIT = f"""{LABELS},
        s AS (select * exclude (i, n), {split_case('i', 'n', STR, STV)} as split from (
              select *, row_number() over (partition by label order by {key(['interaction_id'])}, interaction_id) - 1 as i,
                     count(*) over (partition by label) as n from labels))"""
COUNTS = """count(*) as n, count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as z,
        count(distinct user_id) as u, count(distinct video_id) as v"""

SQL = {
    "s01_load_entity": "select * from customer",
    "s02_load_all": """select 'customer' as "table", count(*) as rows from customer
        union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier
        union all select 'orders', count(*) from orders""",
    "s03_load_dir": with_views("select id, category, duration from videos", "videos"),
    "s05_read_jsonl_log": with_views("""select request_id, date_trunc('milliseconds', ts) as ts, inference_latency_ms, cast(null as varchar) as _corrupt_record
        from inference_log where date_trunc('milliseconds', ts) between timestamp '2024-01-05' and timestamp '2024-01-25'""", "inference_log"),
    "s07_write_parquet": with_views("select * from interactions", "interactions"),
    "s09_write_partitioned_by_day": with_views("select *, year(ts) as year, month(ts) as month, day(ts) as day from feedback", "feedback"),
    "s10_write_split_set": with_views(f"""WITH {LABELS}
        select split, count(*) as count from (select {split_case('i', 'n', TR, TV)} as split from (
          select row_number() over (order by {key(['interaction_id'])}, interaction_id) - 1 as i, count(*) over () as n from labels)) group by split""",
                                      "predictions", "feedback"),
    "s11_embeddings_table": with_views("select id, cast(embedding as float[]) as embedding from items", "items"),
    "s14_artifact_tables": with_views(f"select *, 'country,age' as artifacts from ({svocab('users', 'country_code')})", "users"),
    "s16_dataset_version_read": with_views(f"WITH {SPLIT} select *, 1 as remaining_versions from s", "predictions", "feedback"),
    "s21_preprocess_outputs": MISC["e24_preprocess_job"],
    "s22_scan_labels": with_views(f"""WITH {LABELS} select * from labels
        where event_id % 7 <> 0 and cast(feedback_timestamp as date) between date '2024-01-10' and date '2024-01-20'""", "predictions", "feedback"),
    "a19_version_diff": with_views(f"""WITH {LABELS},
        a AS (select {COUNTS} from labels where event_id % 5 <> 0), b AS (select {COUNTS} from labels)
        select 'v1' as version_a, 'v2' as version_b, b.n - a.n as total_records_diff, b.p - a.p as positive_samples_diff,
               b.z - a.z as negative_samples_diff, b.u - a.u as unique_users_diff, b.v - a.v as unique_videos_diff, true as hash_changed from a, b""",
                                   "predictions", "feedback"),
    "s12_feature_store_upsert": with_views("""select user_id, country_code, age, updated_at from (
          select *, row_number() over (partition by user_id order by updated_at desc, src desc) as r from (
            select id as user_id, country_code, age, timestamp '2024-01-01' as updated_at, 0 as src from users
            union all select id, 'XX', age + 1, case when id % 8 = 0 then timestamp '2024-01-02' else timestamp '2023-12-31' end, 1
            from users where id % 4 = 0)) where r = 1""", "users"),
    "s13_feature_store_read": with_views("""select id as user_id, country_code, age from users
        where id in (select user_id from online union all select unnest(range(100000, 100005)))""", "users", "online"),
    "s18_video_catalog_publish": with_views("""select v.id, v.category, i.embedding is not null as has_embedding, 'v7' as model_version
        from videos v left join items i on v.id = i.id""", "videos", "items"),
    "a18_version_stats": with_views(f"""WITH {LABELS},
        s AS (select *, {split_case('i', 'n', STR, STV)} as split from (
              select *, row_number() over (partition by label order by {key(['interaction_id'])}, interaction_id) - 1 as i,
                     count(*) over (partition by label) as n from labels))
        select count(*) as total_records, count(*) filter (where split = 'train') as train_records,
               count(*) filter (where split = 'val') as validation_records, count(*) filter (where split = 'test') as test_records,
               count(*) filter (where label = 1) as positive_samples, count(*) filter (where label = 0) as negative_samples,
               count(distinct user_id) as unique_users, count(distinct video_id) as unique_videos,
               min(feedback_timestamp) as data_start, max(feedback_timestamp) as data_end from s""", "predictions", "feedback"),
    "s23_activity_upsert": with_views("""WITH lastc AS (select * from online where ts < timestamp '2024-01-16'
                                      qualify row_number() over (partition by user_id order by ts desc, interaction_id) = 1),
        lastu AS (select * from online where ts >= timestamp '2024-01-16'
                  qualify row_number() over (partition by user_id order by ts desc, interaction_id) = 1)
        select user_id, updated_at, video_id, interaction_type from (
          select *, row_number() over (partition by user_id order by updated_at desc, src desc) as r from (
            select user_id, ts as updated_at, video_id, interaction_type, 0 as src from lastc
            union all select user_id, ts, video_id, interaction_type, 1 from lastu)) where r = 1""", "online"),
}
