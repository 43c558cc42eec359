"""What is read, drawn and exchanged: stored rows, first draws, vectors searched once, encoded sides, sizes of built vocabularies."""

import re

from pyspark.sql import functions as F

from recframe.operators import encoders as E
from recframe.operators import features as FT
from recframe.operators import sampling as S
from recframe.operators import vectors as V
from recframe.session import store


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stored_rows_are_columns(spark):
    df = spark.createDataFrame([(1, "a", [1.0, None]), (None, None, None)], "k long, s string, v array<double>")
    got = store(df)
    assert got.dtypes == df.dtypes and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert "ReadSchema: struct<s:string>" in got.select("s")._jdf.queryExecution().executedPlan().toString()
    assert store(df.limit(0)).count() == 0


def test_samples_meet_two_tables(spark):
    samples = spark.createDataFrame([(1, 1), (2, 9), (None, None)], "user_id long, video_id long")
    users = spark.createDataFrame([(1, "FR", "en", 30)], "id long, country_code string, preferred_language string, age int")
    videos = spark.createDataFrame([(1, 5, "c", "a|b", "en", "low", 60, 10, 1, 0), (2, None, "c", "a", "en", "low", 60, 10, 1, 0)],
                                   "id long, channel_id long, category string, child_categories string, language string, popularity string, "
                                   "duration int, view_count long, like_count long, comment_count long")
    channels = spark.createDataFrame([(5, 100)], "id long, subscriber_count long")
    out = FT.ranker_star_join(samples, users, videos, channels)
    assert out.columns[:4] == ["channel_id", "video_id", "user_id", "country"]
    assert {(r.user_id, r.channel_id, r.channel_subscriber_count) for r in out.collect()} == {(1, 5, 100), (2, None, None), (None, None, None)}
    # the topmost join, of samples and videos, has the join of videos and channels below it, not above
    top = [len(m.group(1)) for m in re.finditer(r"^([ :+-]*)Join LeftOuter, \(channel_id", plan(out), re.M)]
    rest = [len(m.group(1)) for m in re.finditer(r"^([ :+-]*)Join LeftOuter, \(video_id", plan(out), re.M)]
    assert top and rest and top[0] > rest[0]


def test_negatives_of_repeated_and_null_keys(spark):
    """The draws of a key do not depend on how often it comes; dense users get their whole pool."""
    schema = "interaction_id string, user_id long, video_id long, previously_watched_category string, interaction_time_day string, interaction_time_hour int, device string"
    ctx = ("-", "MONDAY", 1, "Mobile")
    videos = spark.createDataFrame([(i,) for i in range(40)], "id long")
    rows = [(f"a{i}", 1, i, *ctx) for i in range(38)] + [("b", 2, 3, *ctx), ("n", None, 3, *ctx)]
    once = S.negatives_per_positive(spark.createDataFrame(rows, schema), videos).collect()
    twice = S.negatives_per_positive(spark.createDataFrame(rows + rows + [(None, 2, 3, *ctx)], schema), videos).collect()
    assert sorted(map(str, twice)) == sorted(map(str, once + once))
    per = {}
    for r in once:
        per.setdefault(r.source_interaction_id, set()).add(r.video_id)
    assert all(per[f"a{i}"] == {38, 39} for i in range(38)) and len(per["b"]) == len(per["n"]) == 3 and 3 not in per["b"]


def test_text_digests_are_made_once(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, t string")
    assert plan(V.text_embedding(df, "t", "id", dim=4)).count("md5(") == 4  # three times as many before
    assert "1.0E-8" in plan(V.text_embedding(df, "t", "id", dim=4))
    v = V.text_embedding(df, "t", "id", dim=4).first().embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-6


def test_tag_mean_over_the_values_that_are_there(spark):
    items = spark.createDataFrame([(1, "x|y"), (2, "x|x"), (3, "none"), (4, None)], "id long, tags string")
    tags = spark.createDataFrame([("x", [3.0, None]), ("y", [3.0, 8.0]), ("z", [])], "tag string, vector array<double>")
    df = V.tag_embedding(items, tags)
    got = {r.id: r.tag_embedding for r in df.collect()}
    assert [round(x, 6) for x in got[1]] == [round(3 / 73 ** 0.5, 6), round(8 / 73 ** 0.5, 6)]
    assert got[3] == got[4] == [0.0, 0.0]
    assert "posexplode" not in plan(df)


def test_lists_search_in_blocks_equals_whole_lists(spark):
    items = spark.createDataFrame([(i, [float(i % 7) - 3, float(i % 5) - 2, 1.0], i % 3) for i in range(60)], "item_id long, _iv array<double>, cluster int")
    probe = items.select(F.col("item_id").alias("query_id"), F.col("_iv").alias("_qv"), F.explode(F.array(F.lit(0), F.lit(1))).alias("cluster"))
    best = lambda **kw: sorted((r.query_id, r.item_id, round(r.score, 9)) for r in V._search_lists(probe, items, 4, 3, **kw).groupBy(
        "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id"))), 1, 4).alias("l")).select(
        "query_id", F.inline("l")).select("query_id", "item_id", (-F.col("s")).alias("score")).collect())
    assert len(best()) == 240 and best(block_bytes=24 * 5) == best()


def test_sizes_of_built_vocabularies(spark):
    users = spark.createDataFrame([(1, "FR", "en"), (2, "DE", None)], "id long, country_code string, preferred_language string")
    videos = spark.createDataFrame([(1, "a", "it", "low"), (2, "b", "en", "low")], "id long, category string, language string, popularity string")
    got = {r.feature: r.size for r in FT.vocabulary_sizes(E.build_all_vocabs(users, videos)).collect()}
    assert got == {"user_id": 4, "country": 4, "user_language": 3, "language": 4, "video_id": 4, "category": 4, "video_language": 4, "popularity": 3}
