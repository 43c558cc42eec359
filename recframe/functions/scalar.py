"""Named scalar functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from recframe import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def channel_tier(subs) -> Column:
    """<10k micro, <100k small, <1M mid, else macro."""
    s = _c(subs)
    return (F.when(s < 10_000, "micro").when(s < 100_000, "small")
            .when(s < 1_000_000, "mid").otherwise("macro"))


def blend_scores(retrieval, ranker, clip: bool = True) -> Column:
    """F02 (clipped to [0, 1]) / F03 (raw): 0.3·retrieval + 0.7·ranker."""
    r, k = _c(retrieval), _c(ranker)
    if clip:
        r = F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0))
        k = F.least(F.greatest(k, F.lit(0.0)), F.lit(1.0))
    return F.lit(C.RETRIEVAL_WEIGHT) * r + F.lit(C.RANKER_WEIGHT) * k


def parse_tags(tags) -> Column:
    """split on '|', trim, lower, drop empties; NULL, '' and '-' → []."""
    t = _c(tags)
    parts = F.filter(F.transform(F.split(t, r"\|"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(t.isNull() | (F.trim(t) == "") | (F.trim(t) == "-"),
                  F.array().cast("array<string>")).otherwise(parts)


def one_hot(col, levels) -> list[Column]:
    """one indicator column per level (unknown → the 'low' rule is the caller's)."""
    return [(_c(col) == lv).cast("double").alias(f"popularity_{lv}") for lv in levels]


def safe_ratio(num, den) -> Column:
    """num / den with NULL or 0 denominators read as 1."""
    d = F.coalesce(F.nullif(_c(den), F.lit(0)), F.lit(1))
    return F.coalesce(_c(num), F.lit(0)) / d


def cyclical(x, period: float) -> tuple[Column, Column]:
    """Sin / cos of 2πx / period."""
    ang = F.lit(2 * math.pi) * _c(x) / F.lit(float(period))
    return F.sin(ang), F.cos(ang)
