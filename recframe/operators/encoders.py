"""Feature fitting and encoding.

A fit is an aggregate producing a small state: a vocabulary DataFrame
(value, idx) joined at transform time, or a few statistics kept as lazy
scalar subqueries (``DataFrame.scalar()``), so neither the data nor the
vocabulary passes through the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recframe import constants as C
from recframe.operators.ordering import dense_index, exact_quantiles, global_prefix
from recframe.session import few, store


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- vocabularies -----------------------------------------------------------

def string_vocab(values: DataFrame, col: str, include_pad: bool = True, include_unk: bool = True,
                 include_start: bool = False, mask_value: str | None = None,
                 pad_token: str = C.PAD, unk_token: str = C.UNK) -> DataFrame:
    """Specials first ([PAD] 0, [UNK] 1, optional [START] 2), then the
    sorted distinct non-null values (mask value excluded) → (value, idx)."""
    specials = ([pad_token] if include_pad else []) + ([unk_token] if include_unk else []) \
        + ([C.START] if include_start else [])
    v = values.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull())
    if mask_value is not None:
        v = v.where(F.col("value") != mask_value)
    regular = dense_index(v, "value", start=len(specials))
    spark = values.sparkSession
    sp = spark.createDataFrame([(s, i) for i, s in enumerate(specials)], "value string, idx bigint")
    return sp.unionByName(regular.select("value", F.col("idx").cast("bigint")))


def lookup_string(df: DataFrame, col, vocab: DataFrame, out: str, include_pad: bool = True,
                  include_unk: bool = True, include_start: bool = False,
                  mask_value: str | None = None) -> DataFrame:
    """E01 lookup: NULL → PAD, mask value → START, known → idx, else UNK."""
    key = f"_k_{out}"
    v = vocab.select(F.col("value").alias(key), F.col("idx").alias(f"_i_{out}"))
    src = _c(col).cast("string")
    j = df.withColumn(f"_s_{out}", src)
    j = j.join(few(v), F.col(f"_s_{out}") == F.col(key), "left")
    pad = 0 if include_pad else (1 if include_unk else 0)
    unk = (1 if include_pad else 0) if include_unk else None
    start = (2 if include_pad and include_unk else int(include_pad) + int(include_unk)) if include_start else unk
    expr = F.when(F.col(f"_s_{out}").isNull(), F.lit(pad))
    if mask_value is not None:
        expr = expr.when(F.col(f"_s_{out}") == mask_value, F.lit(start if start is not None else 0))
    expr = expr.otherwise(F.coalesce(F.col(f"_i_{out}"), F.lit(unk)))
    return j.withColumn(out, expr.cast("bigint")).drop(key, f"_i_{out}", f"_s_{out}")


def integer_vocab(values: DataFrame, col: str) -> DataFrame:
    """PAD 0, UNK 1, then ids sorted numerically from 2 → (value, idx)."""
    v = values.select(F.col(col).cast("bigint").alias("value")).where(F.col("value").isNotNull())
    return dense_index(v, "value", start=2).select("value", F.col("idx").cast("bigint"))


def lookup_integer(df: DataFrame, col: str, vocab: DataFrame, out: str) -> DataFrame:
    """E02 lookup: NULL → 0, unknown → 1."""
    v = vocab.select(F.col("value").alias(f"_k_{out}"), F.col("idx").alias(f"_i_{out}"))
    j = df.join(few(v), F.col(col).cast("bigint") == F.col(f"_k_{out}"), "left")
    expr = F.when(F.col(col).isNull(), F.lit(0)).otherwise(F.coalesce(F.col(f"_i_{out}"), F.lit(1)))
    return j.withColumn(out, expr.cast("bigint")).drop(f"_k_{out}", f"_i_{out}")


def inverse_integer(df: DataFrame, idx_col: str, vocab: DataFrame, out: str) -> DataFrame:
    """Index → value; 0 → −1 (PAD), 1 → −2 (UNK); absent → NULL."""
    v = vocab.select(F.col("idx").alias(f"_k_{out}"), F.col("value").alias(f"_v_{out}"))
    j = df.join(v, F.col(idx_col) == v[f"_k_{out}"], "left")
    expr = (F.when(F.col(idx_col) == 0, F.lit(-1)).when(F.col(idx_col) == 1, F.lit(-2))
            .otherwise(F.col(f"_v_{out}")))
    return j.withColumn(out, expr.cast("bigint")).drop(f"_k_{out}", f"_v_{out}")


def hash_bucket(col, n: int) -> Column:
    """md5 of the text as a 128-bit integer, mod n.

    Written with two 64-bit halves: (hi·2⁶⁴ + lo) mod n =
    ((hi mod n)·(2⁶⁴ mod n) + lo mod n) mod n, exact in DECIMAL(38).
    """
    h = F.md5(_c(col).cast("string"))
    hi = F.conv(F.substring(h, 1, 16), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.substring(h, 17, 16), 16, 10).cast("decimal(20,0)")
    two64 = (1 << 64) % n
    return ((F.pmod(hi, F.lit(n)) * F.lit(two64) + F.pmod(lo, F.lit(n))) % F.lit(n)).cast("bigint")


def oov_vocab(values: DataFrame, col: str) -> DataFrame:
    """[PAD] 0, [OOV] 1, then distinct values sorted as text."""
    return string_vocab(values, col, True, True, False, None, C.PAD, C.OOV)


def _vocabs_of(pairs: DataFrame) -> DataFrame:
    """(vocab, value) rows, nulls and specials dropped → (vocab, value, idx):
    one exact ordering over (vocab, value), each vocabulary's indices restarting
    at 2 after [PAD] 0 and the unknown token 1."""
    g = global_prefix(pairs, ["vocab", "value"])
    first = g.groupBy("vocab").agg(F.min("_gidx").alias("_g0"))
    return g.join(first, "vocab").select("vocab", "value", (F.col("_gidx") - F.col("_g0") + 2).alias("idx"))


def _vocab_specials(names: DataFrame, unk_token: str) -> DataFrame:
    return names.select("vocab", F.explode(F.array(
        F.struct(F.lit(C.PAD).alias("value"), F.lit(0).cast("bigint").alias("idx")),
        F.struct(F.lit(unk_token).alias("value"), F.lit(1).cast("bigint").alias("idx")))).alias("s")
    ).select("vocab", "s.value", "s.idx")


def _unpivot(df: DataFrame, named: list[tuple[str, Column]], lists: dict[str, Column] | None = None) -> DataFrame:
    pair = lambda n, c: F.struct(F.lit(n).alias("vocab"), c.cast("string").alias("value"))
    pairs = F.array(*[pair(n, c) for n, c in named])
    for n, c in (lists or {}).items():
        values = F.coalesce(c, F.array().cast("array<string>"))
        pairs = F.concat(pairs, F.transform(values, partial(pair, n)))
    return df.select(F.explode(pairs).alias("p")).select("p.*")


def build_all_vocabs(users: DataFrame, videos: DataFrame) -> DataFrame:
    """user_id, country, user_language, video_id, category,
    video_language, shared language and popularity vocabularies in one pass
    → (vocab, value, idx).

    One unpivot, one distinct, one exact ordering over (vocab, value); each
    vocabulary's indices restart at 2 after [PAD] 0 and [OOV] 1.
    """
    pairs = (_unpivot(users, [("user_id", F.col("id")), ("country", F.col("country_code")),
                              ("user_language", F.col("preferred_language")), ("language", F.col("preferred_language"))])
             .unionByName(_unpivot(videos, [("video_id", F.col("id")), ("category", F.col("category")),
                                            ("video_language", F.col("language")), ("language", F.col("language")),
                                            ("popularity", F.col("popularity"))]))
             .where(F.col("value").isNotNull() & ~F.col("value").isin(C.PAD, C.OOV)).distinct())
    return _vocab_specials(pairs.select("vocab").distinct(), C.OOV).unionByName(_vocabs_of(pairs))


def column_vocabs(df: DataFrame, cols: list[str], fixed: dict[str, list[str]] | None = None,
                  lists: dict[str, Column] | None = None) -> DataFrame:
    """E06 over the columns of one table → (vocab, value, idx), one vocabulary
    a column, [PAD] 0 and [UNK] 1 first, even of a column without values.
    ``fixed`` gives the whole values of vocabularies that are not fitted, ``lists``
    array columns whose elements make one.  The table is read once for all."""
    spark = df.sparkSession
    fixed, lists = fixed or {}, lists or {}
    pairs = (_unpivot(df, [(c, F.col(c)) for c in cols], lists)
             .where(F.col("value").isNotNull() & ~F.col("value").isin(C.PAD, C.UNK)).distinct())
    if fixed:
        pairs = pairs.unionByName(spark.createDataFrame([(n, v) for n, vs in fixed.items() for v in vs], "vocab string, value string"))
    names = spark.createDataFrame([(n,) for n in [*cols, *fixed, *lists]], "vocab string")
    return _vocab_specials(names, C.UNK).unionByName(_vocabs_of(pairs))


def apply_vocabs(df: DataFrame, vocabs: DataFrame, cols: list[str], null_index: int = 1) -> DataFrame:
    """``<col>_idx`` by vocabulary of the same name; unknown → [OOV] 1,
    NULL → ``null_index``."""
    out, vocabs = df, store(vocabs, "vocabs")  # read once a column
    for c in cols:
        v = vocabs.where(F.col("vocab") == c).select(F.col("value").alias(f"_k_{c}"),
                                                      F.col("idx").alias(f"_i_{c}"))
        out = out.join(few(v), F.col(c).cast("string") == F.col(f"_k_{c}"), "left")
        out = out.withColumn(f"{c}_idx", F.coalesce(F.col(f"_i_{c}"), F.when(F.col(c).isNull(), null_index).otherwise(1)).cast("bigint")) \
                 .drop(f"_k_{c}", f"_i_{c}")
    return out


# --- numeric transforms -------------------------------------------------------

@dataclass
class ZScore:
    """(x − μ) / (σ + 1e-8) with population σ; inverse without ε."""
    mean: Column
    std: Column

    @classmethod
    def fit(cls, df: DataFrame, col) -> "ZScore":
        x = _c(col).cast("double")
        return cls(df.select(F.avg(x)).scalar(), df.select(F.stddev_pop(x)).scalar())

    def transform(self, col) -> Column:
        return (_c(col).cast("double") - self.mean) / (self.std + F.lit(1e-8))

    def inverse(self, col) -> Column:
        return _c(col) * self.std + self.mean


@dataclass
class MinMax:
    """Scale to ``feature_range``; zero range → the lower bound."""
    lo: Column
    hi: Column
    feature_range: tuple = (0.0, 1.0)

    @classmethod
    def fit(cls, df: DataFrame, col, feature_range=(0.0, 1.0)) -> "MinMax":
        x = _c(col).cast("double")
        return cls(df.select(F.min(x)).scalar(), df.select(F.max(x)).scalar(), feature_range)

    def transform(self, col) -> Column:
        a, b = self.feature_range
        rng = self.hi - self.lo
        scaled = F.when(rng == 0, F.lit(0.0)).otherwise((_c(col).cast("double") - self.lo) / rng)
        return scaled * F.lit(float(b - a)) + F.lit(float(a))

    def inverse(self, col) -> Column:
        a, b = self.feature_range
        return (_c(col) - F.lit(float(a))) / F.lit(float(b - a)) * (self.hi - self.lo) + self.lo


@dataclass
class LogTransform:
    """log1p / log10(x+1) / log2(x+1), shifted by −min when the fitted
    minimum is negative (fixed at fit time, T06); inverse expm1 / 10^x−1 / 2^x−1."""
    base: str = "natural"
    shift: Column | None = None

    @classmethod
    def fit(cls, df: DataFrame, col, base: str = "natural") -> "LogTransform":
        m = df.select(F.min(_c(col).cast("double"))).scalar()
        return cls(base, F.when(m < 0, -m).otherwise(F.lit(0.0)))

    def transform(self, col) -> Column:
        x = _c(col).cast("double") + (self.shift if self.shift is not None else F.lit(0.0))
        if self.base == "10":
            return F.log10(x + 1)
        if self.base == "2":
            return F.log2(x + 1)
        return F.log1p(x)

    def inverse(self, col) -> Column:
        if self.base == "10":
            return F.pow(F.lit(10.0), _c(col)) - 1
        if self.base == "2":
            return F.pow(F.lit(2.0), _c(col)) - 1
        return F.expm1(_c(col))


def bucketize(col, boundaries) -> Column:
    """Numpy.digitize — number of boundaries ≤ x; NULL / NaN → last bucket.

    ``boundaries`` is a Python list or an array Column (fitted)."""
    arr = F.array(*[F.lit(float(b)) for b in boundaries]) if isinstance(boundaries, (list, tuple)) \
        else boundaries
    x = F.coalesce(_c(col).cast("double"), F.lit(float("nan")))
    return F.size(F.filter(arr, lambda b: x >= b))


def quantile_boundaries(df: DataFrame, col: str, num_buckets: int = 10) -> Column:
    """E11 fit: interior percentiles (linear) as a lazy array column."""
    qs = [i / num_buckets for i in range(1, num_buckets)]
    q = exact_quantiles(df, col, qs)
    return q.select(F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))),
                                lambda s: s["value"])).scalar()


def bucket_labels(boundaries: list[float]) -> list[str]:
    """E11 labels: "< b0", "b0 - b1", …, ">= bn"."""
    b = [-math.inf] + list(boundaries) + [math.inf]
    out = []
    for i in range(len(b) - 1):
        if b[i] == -math.inf:
            out.append(f"< {b[i + 1]}")
        elif b[i + 1] == math.inf:
            out.append(f">= {b[i]}")
        else:
            out.append(f"{b[i]} - {b[i + 1]}")
    return out


def cyclical(col, period: float) -> tuple[Column, Column]:
    """Sin / cos of 2πx / period."""
    ang = F.lit(2 * math.pi) * _c(col).cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


class Compose:
    """Fit each step on the previous step's output, transform in order."""

    def __init__(self, steps):
        self.steps = steps  # list of (fit_fn(df, col) -> transformer)
        self.fitted = []

    def fit(self, df: DataFrame, col: str) -> "Compose":
        cur = df.select(F.col(col).alias("_x"))
        self.fitted = []
        for fit in self.steps:
            t = fit(cur, "_x")
            self.fitted.append(t)
            cur = cur.select(t.transform("_x").alias("_x"))
        return self

    def transform(self, col) -> Column:
        out = _c(col)
        for t in self.fitted:
            out = t.transform(out)
        return out


def normalization_stats(df: DataFrame, cols: list[str], log_cols: list[str] = ()) -> DataFrame:
    """Mean, sample std (0 or undefined → 1.0), min, max and, for
    ``log_cols``, log1p mean / sample std; one row per feature (one pass)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"),
                 F.lit(c in log_cols).alias("is_log")) for c in cols])).alias("r")).select("r.*")
    long = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
    std = F.stddev_samp("v")
    lstd = F.stddev_samp(F.log1p("v"))
    return long.groupBy("feature").agg(
        F.avg("v").alias("mean"),
        F.when(F.coalesce(std, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(std).alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"),
        F.when(F.first("is_log"), F.avg(F.log1p("v"))).alias("log_mean"),
        F.when(F.first("is_log"), F.when(F.coalesce(lstd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(lstd))
        .alias("log_std"))
