"""Dashboard filters. A filter that is not given adds no predicate at all."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appwatch.functions.scalars import as_instant, event_month
from appwatch.schema import LOOK_BACK_HOURS


@dataclass(frozen=True)
class Filters:
    """Dimension patterns (``LIKE``: ``%`` and ``_`` are wildcards) and a time range closed at both ends.

    ``to`` defaults to now and ``start`` to 24 hours before it. A blank pattern means any.
    """

    app: str | None = None
    env: str | None = None
    release: str | None = None
    path: str | None = None
    method: str | None = None
    start: datetime | None = None
    to: datetime | None = None

    def bounds(self) -> tuple[datetime, datetime]:
        to = self.to or datetime.now(timezone.utc).replace(tzinfo=None)
        return self.start or to - timedelta(hours=LOOK_BACK_HOURS), to

    @classmethod
    def last_hours(cls, hours: int, to: datetime | None = None, **dims: str | None) -> "Filters":
        to = to or datetime.now(timezone.utc).replace(tzinfo=None)
        return cls(start=to - timedelta(hours=hours), to=to, **dims)


def like_filters(df: DataFrame, filters: Filters, columns: tuple[str, ...]) -> DataFrame:
    for name in columns:
        pattern = getattr(filters, name)
        if pattern is not None and pattern.strip():
            df = df.filter(F.col(name).like(pattern))
    return df


def time_range(df: DataFrame, filters: Filters, column: str = "event_time") -> DataFrame:
    """Closed time range, plus the month predicate that lets stored tables skip whole partitions."""
    start, to = filters.bounds()
    lo, hi = as_instant(start), as_instant(to)
    if "event_month" in df.columns:
        df = df.filter(F.col("event_month").between(event_month(lo), event_month(hi)))
    return df.filter(F.col(column).between(lo, hi))
