"""Keyed state of the stateful jobs (ST04, ST06, ST07, ST12), each a plain step
function that a stream (``applyInPandasWithState``) and a batch replay both run.

Times inside the state are microseconds since the epoch.  A timer is an
event-time timeout: the step runs again once the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

HOUR = 3_600_000_000
DAY = 24 * HOUR


def _watermark(state) -> int:
    return max(0, state.getCurrentWatermarkMs()) * 1000


def _timer(state, at_us: int) -> None:
    """Run again once the watermark is past ``at_us``."""
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, at_us // 1000 + 1))


# ------------------------------------------------------------------ ST04 attribution
ATTRIBUTION_STATE = "fb_us array<bigint>, fb_id array<string>, p_us array<bigint>, p_id array<string>"
ATTRIBUTION_OUT = "feedback_id string, inference_id string, inference_us bigint, status string"


def attribute(feedback: list[tuple[int, str]], predictions: list[tuple[int, str]], delay_us: int) -> list[tuple]:
    """(feedback, newest prediction at or before it, attributed / late / unmatched)."""
    out = []
    for us, fid in feedback:
        best = max((p for p in predictions if p[0] <= us), default=None)
        if best is None:
            out.append((fid, None, None, "unmatched"))
        else:
            out.append((fid, best[1], best[0], "attributed" if us - best[0] <= delay_us else "late"))
    return out


def attribution_fn(delay_hours: int = 24, ttl_hours: int = 48) -> Callable:
    """A feedback is held until the watermark has passed its time, so that no
    earlier prediction can still come, and then emitted once.  A prediction
    leaves the state ``ttl_hours`` after its time (ST07)."""
    delay, ttl = delay_hours * HOUR, ttl_hours * HOUR

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        fb, pr = [], []
        if state.exists:
            fb_us, fb_id, p_us, p_id = state.get
            fb, pr = list(zip(fb_us, fb_id, strict=True)), list(zip(p_us, p_id, strict=True))
        if not state.hasTimedOut:
            for f in frames:
                for us, fid, pid in zip(f["us"], f["feedback_id"], f["inference_id"], strict=True):
                    if fid is not None:
                        fb.append((int(us), fid))
                    else:
                        pr.append((int(us), pid))
        now = _watermark(state)
        ready, held = [f for f in fb if f[0] < now], [f for f in fb if f[0] >= now]
        out = attribute(ready, pr, delay)
        first = min([now, *(us for us, _ in held)])
        pr = [p for p in set(pr) if p[0] >= first - ttl]
        if held or pr:
            state.update(([u for u, _ in held], [i for _, i in held], [u for u, _ in pr], [i for _, i in pr]))
            _timer(state, min([us for us, _ in held] or [min(us for us, _ in pr) + ttl]))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["feedback_id", "inference_id", "inference_us", "status"]).astype({"inference_us": "Int64"})

    return step


# ------------------------------------------------------------------ ST06 recent state
RECENT_STATE = "videos array<bigint>, times array<bigint>, watched array<bigint>, watched_at array<bigint>"
RECENT_OUT = "user_id bigint, recent_videos array<bigint>, watched_videos array<bigint>, last_us bigint"


class RecentState:
    """What is kept of one user: the newest ``limit`` interactions, gone after
    ``recent_ttl`` without a new one, and the time each video was last watched,
    at most ``most`` videos (the ones watched last stay), gone after
    ``watched_ttl`` without a new one."""

    def __init__(self, limit: int = 50, most: int = 1000, recent_ttl: int = DAY, watched_ttl: int = 30 * DAY):
        self.limit, self.most, self.recent_ttl, self.watched_ttl = limit, most, recent_ttl, watched_ttl

    def step(self, kept: tuple | None, events: list[tuple[int, int]]) -> tuple:
        """State after (time, video) events."""
        recent = list(zip(kept[1], kept[0], strict=True)) if kept else []
        watched = dict(zip(kept[2], kept[3], strict=True)) if kept else {}
        last = max([*(t for t, _ in recent), *watched.values()], default=None)
        for us, video in sorted(events):
            if last is not None and us - last > self.recent_ttl:
                recent = []
            if last is not None and us - last > self.watched_ttl:
                watched = {}
            last = us if last is None else max(last, us)
            recent.append((us, video))
            if len(recent) > 2 * self.limit:
                recent = sorted(recent, key=lambda e: (-e[0], e[1]))[:self.limit]
            watched[video] = max(us, watched.get(video, us))
        recent = sorted(recent, key=lambda e: (-e[0], e[1]))[:self.limit]
        kept_videos = sorted(watched.items(), key=lambda e: (-e[1], e[0]))[:self.most]
        return [v for _, v in recent], [t for t, _ in recent], [v for v, _ in kept_videos], [t for _, t in kept_videos]

    def expire(self, kept: tuple, now: int) -> tuple | None:
        """State at ``now``; None when nothing is left."""
        videos, times, watched, watched_at = kept
        last = max([*times, *watched_at], default=0)
        if now - last > self.watched_ttl:
            return None
        return ([], [], watched, watched_at) if now - last > self.recent_ttl else kept

    def row(self, user: int, kept: tuple) -> pd.DataFrame:
        last = max([*kept[1], *kept[3]], default=None)
        return pd.DataFrame({"user_id": [user], "recent_videos": [list(kept[0])], "watched_videos": [sorted(kept[2])], "last_us": [last]})


def recent_fn(rules: RecentState) -> Callable:
    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        kept = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            kept = rules.expire(kept, _watermark(state))
        else:
            events = [(int(t), int(v)) for f in frames for t, v in zip(f["us"], f["video_id"], strict=True)]
            kept = rules.step(kept, events)
        if kept is None:
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "recent_videos": [[]], "watched_videos": [[]], "last_us": [None]}).astype({"last_us": "Int64"})
            return
        state.update(kept)
        last = max([*kept[1], *kept[3]])
        _timer(state, last + (rules.recent_ttl if kept[0] else rules.watched_ttl))
        yield rules.row(key[0], kept)

    return step


def recent_replay(rules: RecentState) -> Callable:
    """The same step over all of a user's events at once (``applyInPandas``)."""
    def replay(key, frame: pd.DataFrame) -> pd.DataFrame:
        return rules.row(key[0], rules.step(None, [(int(t), int(v)) for t, v in zip(frame["us"], frame["video_id"], strict=True)]))

    return replay


# --------------------------------------------------------------------- ST07 inference
TTL_STATE = "us bigint"
TTL_OUT = "inference_id string, us bigint, status string"


def ttl_fn(ttl_hours: int = 48) -> Callable:
    """A prediction is ``live`` when it comes and ``expired`` once the watermark
    has passed its lifetime; then its key is gone from the state."""
    ttl = ttl_hours * HOUR

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            us, status = state.get[0], "expired"
            state.remove()
        else:
            us, status = max(int(t) for f in frames for t in f["us"]), "live"
            if state.exists:
                us = max(us, state.get[0])
            state.update((us,))
            _timer(state, us + ttl)
        yield pd.DataFrame({"inference_id": [key[0]], "us": [us], "status": [status]})

    return step


# ----------------------------------------------------------------------- ST12 alerts
ALERT_STATE = "last_us bigint"


def fired(last: int | None, alerts: list[tuple[int, str]], pause_us: int) -> tuple[int | None, list[tuple[int, str]]]:
    """Alerts (in time order) that come ``pause_us`` or more after the last one
    that fired, and the time of the last one then."""
    out = []
    for us, name in alerts:
        if last is None or us - last >= pause_us:
            out.append((us, name))
            last = us
    return last, out


def cooldown_fn(minutes: int, schema_key: str) -> Callable:
    pause = minutes * 60_000_000

    def step(key, frames, state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        alerts = sorted((int(t), r) for f in frames for t, r in zip(f["us"], f["request_id"], strict=True))
        last, out = fired(last, alerts, pause)
        state.update((last,))
        if out:
            yield pd.DataFrame({schema_key: key[0], "us": [t for t, _ in out], "request_id": [r for _, r in out]})

    return step
