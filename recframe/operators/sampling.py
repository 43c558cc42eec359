"""Sampling, splitting, balancing and negative sampling (X01–X07, J18–J20,
U01, U02, U04).

Shuffles are md5 orderings of stable keys (never ``rand()``), so splits do
not change with partitioning or re-execution.  Splits find their cut points by
histograms of the key (``order_cuts``) and label rows by comparison, so no row is
sorted, moved or stored for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recframe.operators.encoders import hash_bucket
from recframe.operators.experiments import h60
from recframe.operators.ordering import global_prefix, order_cuts, with_cuts
from recframe.session import cut_lineage, few, store
from recframe.sources.published import PublishedTable

#: Catalogue indices that one row lists at most.
_BLOCK = 4096
#: Catalogue rows (an id each) that are sent to every executor; a larger catalogue is joined by exchange.
_SENT = 8_000_000


def _key(cols: list[str], seed: int) -> Column:
    return h60(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def _cut_points(train: float, val: float, test: float | None, normalise: bool):
    if normalise and test is not None:
        total = train + val + test
        train, val = train / total, val / total
    return train, train + val


def _split_at(df: DataFrame, key: Column, ties: list[str], train: float, upto_val: float, group: str | None = None,
              stored: bool = False) -> DataFrame:
    """Cut at int(n·train) and int(n·upto_val) in the order of (key, ties), in each
    stratum.  Rows are compared with the two cut points; none is sorted or stored."""
    def ranks(sizes: DataFrame) -> DataFrame:
        parts = [F.struct(F.lit(name).alias("cut"), F.floor(F.col("n") * F.lit(part)).alias("rank")) for name, part in (("train", train), ("val", upto_val))]
        return sizes.select("g", F.explode(F.array(*parts)).alias("c")).select("g", "c.*")

    out = with_cuts(df, order_cuts(df, key, ties, ranks, group, stored), ["train", "val"], key, ties, group)
    return out.withColumn("split", F.when(F.col("_before_train"), "train").when(F.col("_before_val"), "val").otherwise("test")).drop(
        "_before_train", "_before_val")


def random_split(df: DataFrame, key_cols: list[str], train: float = 0.8, val: float = 0.1,
                 test: float | None = 0.1, seed: int = 42, normalise: bool = True) -> DataFrame:
    """Shuffle by md5(key ‖ seed), cut at int(n·train), int(n·(train+val)).
    Rows of equal ``key_cols`` stay together."""
    return _split_at(df, _key(key_cols, seed), key_cols, *_cut_points(train, val, test, normalise))


def time_split(df: DataFrame, ts: str, tie_cols: list[str], train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Order by time (ties by ``tie_cols``), cut at int(n·r); rows without a
    time come first."""
    key = F.coalesce(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(-(1 << 60)))
    return _split_at(df, key, tie_cols, train, train + val)


def stratified_split(df: DataFrame, label: str, key_cols: list[str], train: float = 0.8, val: float = 0.1,
                     test: float | None = None, seed: int = 42, stored: bool = False) -> DataFrame:
    """X01 inside each label value (same cut rule per class).
    ``stored``: ``df`` is a stored table (see ``order_cuts``)."""
    return _split_at(df, _key(key_cols, seed), key_cols, *_cut_points(train, val, test, test is not None), label, stored)


def bernoulli_split(df: DataFrame, key_cols: list[str], p_train: float = 0.8, seed: int = 42) -> DataFrame:
    """Each row is train with probability p (hash threshold, stable)."""
    b = hash_bucket(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))), 10000)
    return df.withColumn("split", F.when(b < int(round(p_train * 10000)), "train").otherwise("val"))


def balance_labels(df: DataFrame, key_cols: list[str], ratio: float = 1.0, label: str = "label",
                   seed: int = 42) -> DataFrame:
    """Down-sample to positives / negatives = ratio: negatives to
    int(P / ratio) if more, else positives to int(N · ratio); hash-ordered
    choice inside each label."""
    def ranks(sizes: DataFrame) -> DataFrame:
        of = lambda y: F.coalesce(F.sum(F.when(F.col("g") == y, F.col("n"))), F.lit(0))
        both = sizes.agg(of(1).alias("p"), of(0).alias("n"))
        tneg, tpos = F.floor(F.col("p") / F.lit(float(ratio))), F.floor(F.col("n") * F.lit(float(ratio)))
        none = (F.col("p") == 0) | (F.col("n") == 0)
        neg = F.when(none, F.col("n")).when(F.col("n") > tneg, tneg).otherwise(F.col("n"))
        pos = F.when(none, F.col("p")).when((F.col("n") < tneg) & (F.col("p") > tpos), tpos).otherwise(F.col("p"))
        kind = sizes.schema["g"].dataType
        rows = F.array(*[F.struct(F.lit(y).cast(kind).alias("g"), F.lit("keep").alias("cut"), q.alias("rank")) for y, q in ((1, pos), (0, neg))])
        return both.select(F.explode(rows).alias("c")).select("c.*")

    key = _key(key_cols, seed)
    out = with_cuts(df, order_cuts(df, key, key_cols, ranks, label), ["keep"], key, key_cols, label)
    return out.where(F.col("_before_keep") | ~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).drop("_before_keep")


def merge_gate(merged: DataFrame, labels: DataFrame, min_labels: int = 100) -> DataFrame:
    """``merged`` if there are at least ``min_labels`` labels, else no row."""
    return merged.where(labels.select(F.count(F.lit(1))).scalar() >= F.lit(min_labels))


def retraining_dataset(merged: DataFrame, table: PublishedTable, key: str, min_samples: int = 100, ratio: float = 1.0,
                       train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame | None:
    """Balance, split and publish ``merged`` as the next version of ``table``
    (a folder a split); its summary (A17 and the split sizes).  With fewer than
    ``min_samples`` rows nothing is published and None comes back."""
    from recframe.operators.feedback import retrain_summary
    if merged.limit(min_samples).count() < min_samples:
        return None
    split = random_split(cut_lineage(balance_labels(merged, [key], ratio)), [key], train, val, test)
    table.publish(split, ["split"])
    kept = table.read()
    sizes = [F.count(F.when(F.col("split") == s, 1)).alias(f"{s}_samples") for s in ("train", "val", "test")]
    return retrain_summary(kept).select("*", *[kept.agg(c).scalar().alias(n) for c, n in zip(sizes, ("train_samples", "val_samples", "test_samples"), strict=True)])


def union_samples(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """Positives ∪ negatives; columns missing on one side are NULL."""
    return pos.unionByName(neg, allowMissingColumns=True)


def candidate_difference(all_items: DataFrame, used: DataFrame, key: str = "video_id") -> DataFrame:
    """All items minus the ones used (anti join, keeps duplicates out)."""
    return all_items.select(key).distinct().join(used.select(key).distinct(), key, "left_anti")


def distinct_pairs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key tuple, the first by ``order`` (map-side combined)."""
    from recframe.operators.interactions import first_by
    payload = [c for c in df.columns if c not in keys]
    return first_by(df, keys, order, payload)


def _video_index(videos: DataFrame, id_col: str = "id") -> DataFrame:
    g = global_prefix(videos.select(F.col(id_col).alias("video_id")).distinct(), ["video_id"])
    return g.select("video_id", F.col("_gidx").alias("vidx"))


def _named(df: DataFrame, vidx: DataFrame, size: int) -> DataFrame:
    """``df`` with the ``video_id`` of its ``vidx``.  The ids are sent as one array for
    every _BLOCK of them, 8 bytes a number; more than _SENT are joined by exchange."""
    if size > _SENT:
        return df.join(vidx, "vidx")
    ids = vidx.groupBy(F.floor(F.col("vidx") / _BLOCK).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("vidx", "video_id"))).alias("_v"))
    ids = ids.select("_b", F.transform("_v", lambda x: x["video_id"]).alias("_ids"))
    at = (F.col("vidx") - F.col("_b") * _BLOCK + 1).cast("int")  # indices have no gaps
    return df.withColumn("_b", F.floor(F.col("vidx") / _BLOCK)).join(F.broadcast(ids), "_b").withColumn(
        "video_id", F.element_at("_ids", at)).drop("_b", "_ids")


def negatives_per_positive(pos: DataFrame, videos: DataFrame, ratio: int = 3, seed: int = 42,
                           oversample: int = 4, pos_key: str = "interaction_id", rounds: int = 3, stored: bool = False) -> DataFrame:
    """Per positive, ``ratio`` distinct videos the user has no positive
    with (or the whole pool when smaller), context copied from the positive.

    The first ``ratio`` hashed catalogue indices of every positive are looked for among
    the positives as pairs (user, video), two numbers each.  A key none of whose draws
    is a positive or comes twice has its negatives in place: they are drawn again
    where the positive lies, and nothing else of it is exchanged.  The other keys go
    through rounds: round r draws ``oversample·ratio·4^r`` indices for each that is
    still short, drops the user's positive videos and keeps the first ``ratio``
    distinct survivors in draw order (before round 0 the first ``ratio`` draws alone,
    which are the first of it).  Who is short after the last round has a positive with
    nearly every video; only for those users the pool is listed (a catalogue's worth of
    rows for a user with nearly as many positives), numbered, and read from a hashed start.
    ``stored``: ``pos`` is a stored table."""
    vidx = _video_index(videos)
    size = vidx.count()
    V = F.lit(size)
    ctx = ["previously_watched_category", "interaction_time_day", "interaction_time_hour", "device"]
    base = pos.select(pos_key, "user_id", "video_id", *ctx).where(F.col(pos_key).isNotNull())  # a null key joins nothing
    base = base if stored else store(base, "positives")  # read again at every step
    pairs = base.select("user_id", "video_id").where(F.col("user_id").isNotNull() & F.col("video_id").isNotNull())

    def draw(df: DataFrame, m: int, r: int) -> DataFrame:
        df = df.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
        return df.withColumn("vidx", F.pmod(F.xxhash64(F.col(pos_key), F.col("_a"), F.lit(seed + r)), V))

    def hits_of(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
        return store(pairs.distinct().join(drawn.select("user_id", "video_id"), ["user_id", "video_id"], "left_semi"), "hits")

    drawn = _named(draw(base.select(pos_key, "user_id"), ratio, 0), vidx, size)
    met = drawn.join(few(hits_of(pairs, drawn)), ["user_id", "video_id"], "left_semi").select(pos_key)
    # as draw() makes them
    first = F.transform(F.sequence(F.lit(0), F.lit(ratio - 1)), lambda a: F.pmod(F.xxhash64(F.col(pos_key), a, F.lit(seed)), V))
    twice = base.where(F.size(F.array_distinct(first)) < ratio).select(pos_key)
    rest = few(store(met.unionByName(twice).distinct(), "short"))
    out = draw(base.drop("video_id").join(rest, pos_key, "left_anti"), ratio, 0).drop("_a")
    if not rest.isEmpty():
        base = store(base.join(rest, pos_key, "left_semi"), "rest")
        pairs = store(pairs.join(few(store(base.select("user_id").distinct(), "users")), "user_id", "left_semi").distinct(), "pairs")
        todo, parts = base.select(pos_key, "user_id"), []
        for r, m in [(0, ratio), *[(r, oversample * ratio * 4 ** r) for r in range(rounds)]]:
            draws = _named(draw(todo, m, r), vidx, size)
            hits = hits_of(pairs, draws).withColumn("_hit", F.lit(True))
            free = F.when(F.col("_hit").isNull(), F.struct("_a", "vidx"))
            drawn = store(draws.join(hits, ["user_id", "video_id"], "left").groupBy(pos_key).agg(F.array_sort(F.collect_set(free)).alias("_c")).select(
                pos_key, F.slice(F.array_distinct(F.transform("_c", lambda x: x["vidx"])), 1, ratio).alias("_vids")), "draws")
            parts.append(drawn.where(F.size("_vids") == ratio))
            short = store(drawn.where(F.size("_vids") < ratio).select(pos_key), "short")
            if short.isEmpty():
                break
            todo = base.join(short, pos_key, "left_semi").select(pos_key, "user_id").distinct()
        else:
            todo = store(todo, "todo")
            blocks = todo.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((V - 1) / F.lit(_BLOCK)))).alias("_b"))
            every = blocks.select("user_id", F.explode(F.sequence(F.col("_b") * _BLOCK, F.least(F.col("_b") * _BLOCK + _BLOCK, V) - 1)).alias("vidx"))
            pool = _named(every, vidx, size).join(pairs, ["user_id", "video_id"], "left_anti")
            by_hash = Window.partitionBy("user_id").orderBy(F.xxhash64("user_id", "video_id", F.lit(seed)), "video_id")
            pool = store(pool.select("user_id", "vidx", (F.row_number().over(by_hash) - 1).cast("long").alias("_i")), "pool")
            n = pool.groupBy("user_id").agg(F.count(F.lit(1)).alias("_p"))
            wanted = todo.join(n, "user_id").select(
                pos_key, "user_id", "_p", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(ratio).cast("long"), F.col("_p")) - 1)).alias("_j"))
            wanted = wanted.select(pos_key, "user_id", F.pmod(F.pmod(F.xxhash64(F.col(pos_key), F.lit(seed)), F.col("_p")) + F.col("_j"), F.col("_p")).alias("_i"))
            parts.append(wanted.join(pool, ["user_id", "_i"]).select(pos_key, F.array("vidx").alias("_vids")))
        picks = parts[0]
        for p in parts[1:]:
            picks = picks.unionByName(p)
        # lists meet the positives before they are spread, so a positive is exchanged once
        out = out.unionByName(base.drop("video_id").join(picks, pos_key).withColumn("vidx", F.explode("_vids")).drop("_vids"))
    return _named(out, vidx, size).select(F.col(pos_key).alias("source_interaction_id"), "user_id", "video_id",
                                          F.lit("negative_sample").alias("interaction_type"), F.lit("-").alias("interaction_value"),
                                          *ctx, F.lit(False).alias("is_positive"))


def negatives_global(inter: DataFrame, users: DataFrame, videos: DataFrame, n_target: int | Column,
                     seed: int = 42, oversample: int = 3) -> DataFrame:
    """``n_target`` distinct random (user, video) pairs absent from all
    interactions (label 0).  Hashed draws; while short, twice as many for the
    missing ones, so exactly ``n_target`` pairs come back.  Raises if fewer exist."""
    U = users.select(F.count(F.lit(1))).collect()[0][0]
    uidx = global_prefix(users.select(F.col("id").alias("user_id")).distinct(), ["user_id"]).select(
        "user_id", F.col("_gidx").alias("uidx"))
    vidx = _video_index(videos)
    V = vidx.select(F.count(F.lit(1))).collect()[0][0]
    n = n_target if isinstance(n_target, int) else inter.sparkSession.range(1).select(n_target).collect()[0][0]
    seen = inter.select("user_id", "video_id").distinct()
    spark = inter.sparkSession
    taken = seen.join(uidx, "user_id").join(vidx, "video_id").count()
    if n > U * V - taken:
        raise ValueError(f"{n} negatives asked, {U * V - taken} unseen pairs exist")
    found, r, have = None, 0, 0
    while found is None or have < n:  # what was found stays; only the rest is drawn
        k = spark.range(0, (n - have) * oversample * 2 ** r).select(F.col("id").alias("_j"))
        tag = F.concat_ws("|", F.col("_j").cast("string"), F.lit(str(seed)), F.lit(str(r)))
        pairs = k.select("_j", F.pmod(h60(F.concat(tag, F.lit("u"))), U).alias("uidx"),
                         F.pmod(h60(F.concat(tag, F.lit("v"))), V).alias("vidx"))
        pairs = (pairs.join(uidx, "uidx").join(vidx, "vidx")
                 .groupBy("user_id", "video_id").agg(F.min(F.struct(F.lit(r).alias("r"), "_j")).alias("_ord"))
                 .join(seen, ["user_id", "video_id"], "left_anti"))
        if found is not None:
            pairs = pairs.join(found.select("user_id", "video_id"), ["user_id", "video_id"], "left_anti")
        new = cut_lineage(pairs)
        found = new if found is None else found.unionByName(new)
        have, r = have + new.count(), r + 1
    g = global_prefix(found, ["_ord", "user_id", "video_id"])
    return g.where(F.col("_gidx") < n).select("user_id", "video_id", F.lit(0).alias("label"))
