"""Windows of time, months of a window, and dates as text; everything in UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: created_at of a post, as it comes.
POST_DATE = "EEE MMM dd HH:mm:ss Z yyyy"


def instant(text: str) -> datetime:
    """A date, or a date and time with T between; no zone means UTC."""
    found = datetime.fromisoformat(text)
    return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)


@dataclass(frozen=True)
class TimeWindow:
    """From start to end.  closed: "both", or "left" for a window that leaves out its end.  An end that is a mere date
    means the last millisecond of that day."""

    start: str | None = None
    end: str | None = None
    closed: str = "both"

    def __post_init__(self) -> None:
        if self.closed not in ("both", "left"):
            raise ValueError(f"a window can't be closed on {self.closed!r}")
        if self.start and self.end and instant(self.start) > self.last():
            raise ValueError(f"{self.start} is after {self.end}")

    def last(self) -> datetime:
        found = instant(self.end)
        return found + timedelta(days=1, milliseconds=-1) if len(self.end) == 10 and self.closed == "both" else found

    def holds(self, ts: Column, ntz: bool = True) -> Column:
        """The predicate; plain comparisons with literals, so that it reaches the scan."""
        kind = "timestamp_ntz" if ntz else "timestamp"
        edge = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
        found = F.lit(True)
        if self.start:
            found = ts >= edge(instant(self.start))
        if self.end:
            upper = ts <= edge(self.last()) if self.closed == "both" else ts < edge(self.last())
            found = upper if not self.start else found & upper
        return found

    def months(self, month: Column) -> Column:
        """The same as a predicate on a partition column ``yyyy-MM``, which Catalyst doesn't infer from ts."""
        found = F.lit(True)
        if self.start:
            found = month >= instant(self.start).strftime("%Y-%m")
        if self.end:
            upper = month <= self.last().strftime("%Y-%m")
            found = upper if not self.start else found & upper
        return found


def month_split(start: str, end: str) -> list[tuple[str, str, str]]:
    """(month, first instant, last instant) of each month that a window touches, to the second."""
    at, last = instant(start), TimeWindow(start, end).last()
    out = []
    while at <= last:
        following = (at.replace(day=1) + timedelta(days=32)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
        stop = min(last, following - timedelta(seconds=1))
        out.append((at.strftime("%Y-%m"), at.strftime("%Y-%m-%dT%H:%M:%S"), stop.strftime("%Y-%m-%dT%H:%M:%S")))
        at = following
    return out


def day(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def post_time(created_at: Column) -> Column:
    """The instant of a created_at text; null where it isn't one."""
    # the weekday is dropped: the parser takes none for input
    return F.try_to_timestamp(F.regexp_replace(created_at, "^[A-Za-z]{3} ", ""), F.lit("MMM dd HH:mm:ss Z yyyy"))
