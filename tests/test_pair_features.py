"""User and video features looked up along one row."""

import io
from collections import Counter
from contextlib import redirect_stdout

from recframe.operators import features as FT


def test_pair_features_equal_the_two_joined(spark):
    users = spark.createDataFrame([(1, "FR", "fr", 20), (1, "DE", "de", 30), (2, None, "fr", None), (3, "FR", None, 61)],
                                  "id long, country_code string, preferred_language string, age int")
    videos = spark.createDataFrame([(7, "A", 60, "en", "low"), (7, "B", 300, "fr", "viral"), (8, None, 900, None, None)],
                                   "id long, category string, duration int, language string, popularity string")
    rows = [(u, "FR" if c else None, "fr", a, "A", v, k, 60 * d, p, "en") for u, c, a in ((1, 1, 20), (1, 0, 30), (2, 1, 40), (9, 0, 50), (None, 1, 33))
            for v, k, d, p in ((7, "A", 1, "low"), (7, "B", 5, "viral"), (8, None, 15, None), (None, "A", 2, "high"))]
    pairs = spark.createDataFrame(rows, "user_id long, country string, user_language string, age int, previously_watched_category string, video_id long, "
                                        "category string, video_duration int, popularity string, video_language string")
    got = FT.pair_features(pairs, users, videos)
    want = FT.user_features(pairs, users, videos).join(FT.video_features(pairs, videos, users), ["user_id", "video_id"])
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    # user 1 and video 7 are there twice: 4 rows, each once for every one of them
    assert got.where("user_id = 1 and video_id = 7").count() == 16
    out = io.StringIO()
    with redirect_stdout(out):
        got.explain()
        want.explain()
    mine, joined = out.getvalue().split("== Physical Plan ==")[1:]
    assert mine.count("Scan ExistingRDD") < joined.count("Scan ExistingRDD")
