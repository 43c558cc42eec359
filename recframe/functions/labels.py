"""Interaction labelling rules as Column expressions.

The five "positive" rules differ on purpose (impressions, clicks and watches
are treated differently by each); every rule is a separate function.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recframe import constants as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def watch_seconds(value) -> Column:
    """Integer prefix of an "N seconds" value; NULL when it is not an integer."""
    token = F.regexp_extract(_c(value), r"^\s*(\S+)", 1)
    return token.try_cast("int")


def watch_ratio(itype, value, duration) -> Column:
    """Watch rows → min(seconds / duration, 1.0); other rows, bad values or
    zero duration → 0.0.  ``duration`` must already default to 300 for
    unknown videos."""
    secs = watch_seconds(value)
    dur = _c(duration)
    return (F.when((_c(itype) != "watch") | (dur == 0) | secs.isNull(), F.lit(0.0))
            .otherwise(F.least(secs / dur, F.lit(1.0))))


def is_positive(itype, ratio) -> Column:
    """Dislike → false; watch → ratio ≥ 0.4; impression → true;
    else the type is one of like, comment, click, share."""
    t = _c(itype)
    return (F.when(t == "dislike", F.lit(False))
            .when(t == "watch", _c(ratio) >= C.MIN_WATCH_RATIO)
            .when(t == "impression", F.lit(True))
            .otherwise(t.isin(*C.POSITIVE_TYPES)))


def is_positive_simple(itype) -> Column:
    """Watch, like and comment are positive, nothing else."""
    return _c(itype).isin(*C.SIMPLE_POSITIVE_TYPES)


def rule_label(itype, watch_pct, watch_secs, rules: dict | None = None) -> Column:
    """Three-valued label 1 / 0 / NULL (unknown).

    Unknown interaction types are read as impressions, which are unknown.
    """
    r = dict(C.LABEL_RULES, **(rules or {}))
    t = _c(itype)
    pct, secs = _c(watch_pct), _c(watch_secs)

    def flag(on: bool, value: int) -> Column:
        return F.lit(value if on else None).cast("int")

    return (F.when(t == "like", flag(r["like_is_positive"], 1))
            .when(t == "dislike", flag(r["dislike_is_negative"], 0))
            .when(t == "complete", flag(r["complete_is_positive"], 1))
            .when(t == "share", flag(r["share_is_positive"], 1))
            .when(t == "skip", flag(r["skip_is_negative"], 0))
            .when(t == "click", flag(r["click_is_positive"], 1))
            .when(t == "watch",
                  F.when((pct >= r["min_watch_percentage_positive"])
                         & (secs >= r["min_watch_seconds_positive"]), F.lit(1))
                  .when(pct < r["min_watch_percentage_negative"], F.lit(0))
                  .otherwise(F.lit(None).cast("int")))
            .otherwise(F.lit(None).cast("int")))


def event_label(itype, watch_pct) -> Column:
    """Like, comment, impression → 1; watch with ≥ 40 % → 1; else 0."""
    t = _c(itype)
    return (F.when(t.isin("like", "comment", "impression"), F.lit(1))
            .when((t == "watch") & (F.coalesce(_c(watch_pct), F.lit(0.0)) >= C.MIN_WATCH_RATIO), F.lit(1))
            .otherwise(F.lit(0)))


def event_time(ts_epoch) -> Column:
    return F.timestamp_seconds(_c(ts_epoch))


def day_name_upper(ts) -> Column:
    """MONDAY … SUNDAY."""
    return F.upper(F.date_format(_c(ts), "EEEE"))


def watch_percentage(watch_secs, duration) -> Column:
    """watch / duration, 0 when the duration is not positive."""
    d = _c(duration)
    return F.when(d > 0, _c(watch_secs) / d).otherwise(F.lit(0.0))
