"""Exact global order statistics without a single-partition window.

``global_prefix`` gives every row its 0-based position in a total order and
the sum of a weight over all rows before it.  Plan: range-partition on the
full order tuple (which must end in a unique tie-break so hot values are
spread over partitions), sort inside partitions, take per-partition running
counts in one Arrow pass, materialise that in the shared checkpoint folder
(so the counting job and the final job see the same partitions even after an
executor loss), then add per-partition offsets (one number per partition).

Exact quantiles (``exact_quantiles``) and ranks build on it: values are first
collapsed to (group, value, count) by a map-side combining aggregate, so a
value repeated a billion times is one row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recframe.session import cut_lineage, shuffle_partitions, store


def _running(weight: str | None):
    def fn(batches):
        from pyspark import TaskContext
        pid = TaskContext.get().partitionId()
        n, w = 0, 0.0
        for pdf in batches:
            m = len(pdf)
            pdf["_pid"] = pid
            pdf["_lidx"] = range(n, n + m)
            n += m
            if weight is not None:
                cs = pdf[weight].astype("float64").cumsum()
                pdf["_lcum"] = cs - pdf[weight].astype("float64") + w
                if m:
                    w += float(cs.iloc[-1])
            yield pdf
    return fn


def global_prefix(df: DataFrame, order: list, weight: str | None = None,
                  partitions: int | None = None) -> DataFrame:
    """Add ``_gidx`` (0-based position in ``order``) and, with ``weight``,
    ``_gcum`` (sum of ``weight`` over the rows before).  ``order`` items are
    column names or Columns (use ``F.desc`` for descending)."""
    spark = df.sparkSession
    n = partitions or shuffle_partitions(spark)
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if weight is None:
        # JVM only: partition id and the row's position inside its sorted
        # partition (monotonically_increasing_id = pid << 33 | row index)
        tagged = ordered.select("*", F.spark_partition_id().alias("_pid"),
                                F.monotonically_increasing_id().alias("_mid"))
        staged = cut_lineage(tagged)
        staged = staged.withColumn("_lidx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)).drop("_mid")
    else:
        # running sums of the weight need one Arrow pass per partition
        fields = list(df.schema.fields) + [T.StructField("_pid", T.IntegerType()),
                                           T.StructField("_lidx", T.LongType()),
                                           T.StructField("_lcum", T.DoubleType())]
        staged = cut_lineage(ordered.mapInPandas(_running(weight), T.StructType(fields)))
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight is not None:
        aggs.append(F.sum(F.col(weight).cast("double")).alias("w"))
    per_part = {r["_pid"]: r for r in staged.groupBy("_pid").agg(*aggs).collect()}  # ≤ n rows
    top = max(per_part) + 1 if per_part else 1
    cnt_off, w_off = [], []
    c_acc, w_acc = 0, 0.0
    for p in range(top):
        cnt_off.append(c_acc)
        w_off.append(w_acc)
        r = per_part.get(p)
        if r is not None:
            c_acc += r["n"]
            if weight is not None:
                w_acc += float(r["w"] or 0.0)
    idx = F.element_at(F.array(*[F.lit(v) for v in cnt_off]).cast("array<bigint>"), F.col("_pid") + 1)
    out = staged.withColumn("_gidx", idx + F.col("_lidx"))
    if weight is not None:
        woff = F.element_at(F.array(*[F.lit(float(v)) for v in w_off]), F.col("_pid") + 1)
        out = out.withColumn("_gcum", woff + F.col("_lcum"))
    return out.drop("_pid", "_lidx", *(["_lcum"] if weight is not None else []))


#: Strata of one split: bounds the cut points that every task gets.
MAX_STRATA = 10_000
#: Bits of one histogram: few enough that a task's rows collapse before they are exchanged.
_DIGIT = 12


def order_cuts(df: DataFrame, key: Column, ties: list[str], ranks: Callable[[DataFrame], DataFrame], group: str | None = None,
               stored: bool = False) -> DataFrame:
    """The rows at given ranks of an order, found without sorting: (g, cut, k, t).

    ``ranks`` turns the sizes (g, n) of the strata (g is null without ``group``)
    into (g, cut, rank), cut being a name; the order is the whole number ``key``,
    then ``ties``.  A histogram over the leading bits of
    the key says in which range each rank lies; the range is refined ``_DIGIT``
    bits at a time, and the last few rows are told apart by their ties.  Only the
    columns of the order are stored (once); a rank beyond the last row has no cut.
    ``stored``: ``df`` is a stored table, so the ties are read there and not stored again."""
    rows = df.select((F.col(group) if group else F.lit(None).cast("int")).alias("g"), key.cast("long").alias("k"), F.struct(*ties).alias("t"))
    rel = store(rows.drop("t") if stored else rows, "order")
    low, high = rel.agg(F.min("k"), F.max("k")).first()
    if low is None:
        return rows.select("g", F.lit("").alias("cut"), "k", "t").limit(0)
    sizes = rel.groupBy("g").agg(F.count("*").alias("n"))
    if group is not None and sizes.limit(MAX_STRATA + 1).count() > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    rel = rel.withColumn("k", F.col("k") - F.lit(low))
    tied = rows.withColumn("k", F.col("k") - F.lit(low)) if stored else rel
    left = (high - low).bit_length()
    found = ranks(sizes).select("g", "cut", F.col("rank").alias("_rest"), F.lit(0).cast("long").alias("_pre"))

    def pick(rows: DataFrame, by: str) -> DataFrame:
        """The value of ``by`` in which each rank lies, and the rank inside it."""
        upto = F.sum("_n").over(Window.partitionBy("g", "cut").orderBy(by))
        return (rows.groupBy("g", "cut", "_rest", by).agg(F.count("*").alias("_n")).withColumn("_upto", upto)
                .where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_n") <= F.col("_rest")))
                .select("g", "cut", (F.col("_rest") - F.col("_upto") + F.col("_n")).alias("_rest"), by))

    def inside(width: int, rel: DataFrame = rel) -> DataFrame:
        c = found.select(F.col("g").alias("_g"), "cut", "_rest", "_pre")  # at most MAX_STRATA strata, checked above
        return rel.join(F.broadcast(c), F.col("g").eqNullSafe(F.col("_g")) & (F.shiftright("k", width) == F.col("_pre"))).drop("_g")

    while left > 0:
        step = min(_DIGIT, left)
        found = pick(inside(left).withColumn("_p", F.shiftright("k", left - step)), "_p").withColumnRenamed("_p", "_pre")
        left -= step
    last = pick(inside(0, tied), "t").select("g", "cut", "t")
    keys = found.select(F.col("g").alias("_g"), F.col("cut").alias("_c"), (F.col("_pre") + F.lit(low)).alias("k"))
    return last.join(keys, F.col("g").eqNullSafe(F.col("_g")) & (F.col("cut") == F.col("_c"))).select("g", "cut", "k", "t")


def with_cuts(df: DataFrame, cuts: DataFrame, names: list[str], key: Column, ties: list[str], group: str | None = None) -> DataFrame:
    """``df`` with, for each cut, whether a row comes before it (``_before_<name>``)."""
    spark = df.sparkSession
    rows = cuts.collect()  # a cut for each name and stratum
    place = F.struct(key.cast("long").alias("k"), F.struct(*ties).alias("t"))
    if group is None:
        at = {r["cut"]: r for r in rows}
        kept = spark.createDataFrame(rows, cuts.schema) if rows else cuts.limit(0)
        out = df
        for n in names:
            one = kept.where(F.col("cut") == n).select(F.first(F.struct("k", "t")).alias("c")).scalar()
            out = out.withColumn(f"_before_{n}", place < one if n in at else F.lit(True))
        return out
    kept = spark.createDataFrame(rows, cuts.schema) if rows else cuts.limit(0)
    out = df
    for n in names:
        c = kept.where(F.col("cut") == n).select(F.col("g").alias("_g"), F.struct("k", "t").alias("_c"))
        out = (out.join(F.broadcast(c), F.col(group).eqNullSafe(F.col("_g")), "left")
               .withColumn(f"_before_{n}", F.coalesce(place < F.col("_c"), F.lit(True))).drop("_g", "_c"))
    return out


def dense_index(values: DataFrame, col: str, start: int = 0) -> DataFrame:
    """Sorted distinct values of ``col`` numbered ``start, start+1, …``."""
    d = values.select(col).where(F.col(col).isNotNull()).distinct()
    return global_prefix(d, [col]).select(col, (F.col("_gidx") + start).alias("idx"))


def exact_quantiles(df: DataFrame, value: str, qs: list[float], groups: list[str] | None = None
                    ) -> DataFrame:
    """Linear-interpolated quantiles (numpy / DuckDB ``quantile_cont``) per group.

    Returns (groups…, q, value).  NULL values are ignored.
    """
    g = list(groups or [])
    v = F.col(value).cast("double")
    cnt = (df.where(F.col(value).isNotNull()).groupBy(*g, v.alias("_v"))
           .agg(F.count(F.lit(1)).alias("_c")))
    pref = global_prefix(cnt, [*g, "_v"], weight="_c")
    if g:
        gstats = pref.groupBy(*g).agg(F.min("_gcum").alias("_g0"), F.sum("_c").alias("_n"))
        j = pref.join(gstats, g, "inner")
    else:  # one group: its offset and size are scalar subqueries
        j = pref.select("*", pref.select(F.min("_gcum")).scalar().alias("_g0"),
                        pref.select(F.sum("_c")).scalar().alias("_n"))
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    j = j.select(*g, "_v", (F.col("_gcum") - F.col("_g0")).alias("_lo"), "_c", "_n",
                 F.explode(qarr).alias("q"))
    h = (F.col("_n") - 1) * F.col("q")
    j = j.select(*g, "q", "_v", "_lo", "_c", h.alias("_h"),
                 F.floor(h).alias("_fl"), F.ceil(h).alias("_cl"))
    inside = lambda p: (p >= F.col("_lo")) & (p < F.col("_lo") + F.col("_c"))
    hit = j.where(inside(F.col("_fl")) | inside(F.col("_cl")))
    agg = hit.groupBy(*g, "q").agg(
        F.max(F.when(inside(F.col("_fl")), F.col("_v"))).alias("_vf"),
        F.max(F.when(inside(F.col("_cl")), F.col("_v"))).alias("_vc"),
        F.first("_h").alias("_h"), F.first("_fl").alias("_fl"))
    return agg.select(*g, "q", (F.col("_vf") + (F.col("_h") - F.col("_fl")) * (F.col("_vc") - F.col("_vf")))
                      .alias("value"))


def quantile_array(df: DataFrame, value: str, qs: list[float], groups: list[str] | None = None,
                   name: str = "quantiles") -> DataFrame:
    """``exact_quantiles`` folded into one array column ordered like ``qs``."""
    g = list(groups or [])
    q = exact_quantiles(df, value, qs, g)
    folded = q.groupBy(*g).agg(F.array_sort(F.collect_list(F.struct("q", "value"))).alias("_qs"))
    return folded.select(*g, F.transform("_qs", lambda s: s["value"]).alias(name))


def _chunks(it, n):
    it = iter(it)
    while chunk := list(itertools.islice(it, n)):
        yield chunk
