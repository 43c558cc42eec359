"""Sources, sinks and dataset versions (reference facts: 80/10/10 split,
newest-first listing, +20 rows diff)."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from recframe.operators import sampling as S
from recframe.sources import io as IO
from tests.conftest import SF


def _frame(spark, n):
    return spark.range(n).select(F.col("id").alias("user_id"), (F.col("id") * 7 % 13).alias("video_id"),
                                 (F.col("id") % 2).cast("int").alias("label"),
                                 (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"))


def test_load_entity_errors(spark):
    assert IO.load_entity(spark, os.path.join(SF, "customer.parquet")).count() > 0
    with pytest.raises(ValueError):
        IO.load_entity(spark, os.path.join(SF, "customer.xlsx"))
    with pytest.raises(FileNotFoundError):
        IO.load_entity(spark, os.path.join(SF, "nothing.parquet"))


def test_versions_write_list_read_diff(spark):
    base = IO.scratch_dir(spark, "test-versions")
    split = lambda df: S.random_split(df, ["user_id"])
    v1 = IO.write_version(_frame(spark, 100), base, split, ts="ts")
    meta = IO.list_versions(spark, base).first()
    assert (meta.train_records, meta.validation_records, meta.test_records) == (80, 10, 10)
    v2 = IO.write_version(_frame(spark, 120), base, split, ts="ts")
    assert [r.version_id for r in IO.list_versions(spark, base).collect()] == [v2, v1]
    assert IO.read_version(spark, base).count() == 120
    assert IO.read_version(spark, base, v1, "train").count() == 80
    diff = IO.version_diff(spark, base, v1, v2).first()
    assert diff.total_records_diff == 20 and diff.hash_changed
    IO.delete_version(spark, base, v1)
    assert [r.version_id for r in IO.list_versions(spark, base).collect()] == [v2]


def test_content_hash_is_order_free(spark):
    df = _frame(spark, 50)
    a = IO.content_hash(df).first()[0]
    b = IO.content_hash(df.orderBy(F.desc("user_id")).repartition(3)).first()[0]
    c = IO.content_hash(df.where("user_id > 0")).first()[0]
    assert a == b and a != c


def test_upsert_last_write_wins(spark):
    cur = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 1)), (2, "b", dt.datetime(2024, 1, 1))],
                                "user_id int, v string, updated_at timestamp_ntz")
    upd = spark.createDataFrame([(1, "A", dt.datetime(2024, 1, 2)), (2, "B", dt.datetime(2023, 1, 1)),
                                 (3, "C", dt.datetime(2024, 1, 1))], "user_id int, v string, updated_at timestamp_ntz")
    got = {r.user_id: r.v for r in IO.feature_store_upsert(cur, upd, "user_id").collect()}
    assert got == {1: "A", 2: "b", 3: "C"}
