"""Trading sessions and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..core import CUM, KEY, TS, W, transform

# Each session's time zone, and its local start and end in minutes.
SESSIONS = {
    "Sydney": ("Australia/Sydney", 480, 1020), "Tokyo": ("Asia/Tokyo", 540, 1080), "London": ("Europe/London", 480, 1020), "NewYork": ("America/New_York", 480, 1020),
    "AsianKillZone": ("America/New_York", 1140, 1380), "LondonOpenKillZone": ("America/New_York", 120, 300),
    "NewYorkKillZone": ("America/New_York", 420, 600), "LondonCloseKillZone": ("America/New_York", 600, 720),
}


def minute_of_day(zone: str = "UTC", ts: str = TS) -> Column:
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), zone)
    return F.hour(local) * 60 + F.minute(local) + F.second(local) / 60.0


def in_range(start: float, end: float, zone: str = "UTC", compat: bool = False) -> Column:
    """Whether a time is in a daily range, both ends included; a range over midnight holds
    on both sides of it (compat: only before)."""
    m = minute_of_day(zone)
    if start <= end:
        return (m >= start) & (m <= end)
    return (m >= start) if compat else ((m >= start) | (m <= end))


def _session(s, active: Column) -> dict[str, Column]:
    active = s.add(active)
    before = F.coalesce(F.lag(active).over(W()), F.lit(False))
    opened, closed = s.add(active & ~before), s.add(~active & before)
    run = s.add(F.sum(opened.cast("int")).over(CUM()))
    same = Window.partitionBy(KEY, run, active).orderBy(TS).rowsBetween(Window.unboundedPreceding, 0)
    return {"active": active, "opened": opened, "closed": closed, "high": F.when(active, F.max(s.h).over(same)).otherwise(0.0), "low": F.when(active, F.min(s.l).over(same)).otherwise(0.0)}


@transform("sessions")
def sessions(s, session_type="London", compat=False):
    zone, start, end = SESSIONS[session_type]
    return _session(s, in_range(start, end, zone, compat))


def _minutes(text: str) -> float:
    parts = [int(x) for x in text.split(":")]
    return parts[0] * 60 + parts[1] + (parts[2] / 60 if len(parts) > 2 else 0)


@transform("time_of_day")
def time_of_day(s, start="09:30", end="12:00"):
    return _session(s, in_range(_minutes(start), _minutes(end)))


@transform("session_time_window")
def session_time_window(s, session_type="London", minute_offset=15, boundary_type="start"):
    """True at exactly the offset after the session's local start, or before its end."""
    zone, start, end = SESSIONS[session_type]
    return minute_of_day(zone) == (start + minute_offset if boundary_type == "start" else end - minute_offset)
