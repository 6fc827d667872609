"""Times as ISO text: without a zone they are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_iso(time: Column) -> Column:
    """Milliseconds and Z, whatever the session's zone."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def from_iso(text: Column) -> Column:
    """A timestamp of ISO text with Z, an offset or no zone (then UTC); null if it is none."""
    t = F.trim(text)
    zoned = F.when(t.rlike(r"(?i)(z|[+-][0-9]{2}(:?[0-9]{2})?)$") & t.rlike("[T ]"), t).otherwise(F.concat(t, F.when(t.rlike("[T ]"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), zoned.try_cast("timestamp"))
