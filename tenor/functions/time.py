"""Date helpers. Timestamps stay ISO-8601 strings (``YYYY-MM-DDTHH:MM:SSZ``), as
in the reference, and compare lexicographically; arithmetic is on epoch seconds.
Everything is time-zone independent (TIMESTAMP_NTZ), so a session time zone
cannot shift a year boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenor.functions.text import col

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def year_start_ntz(year) -> Column:
    return F.make_timestamp_ntz(col(year), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def iso(ts_ntz) -> Column:
    return F.date_format(col(ts_ntz), ISO_FORMAT)


def plus_seconds(ts_ntz, secs) -> Column:
    return col(ts_ntz) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(secs).cast("decimal(18,6)"))


def epoch_seconds(ts_ntz) -> Column:
    """Seconds since 1970-01-01T00:00:00 of a TIMESTAMP_NTZ (no zone applied)."""
    epoch = F.make_timestamp_ntz(F.lit(1970), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.timestamp_diff("SECOND", epoch, col(ts_ntz))


def parse_iso(s) -> Column:
    """ISO string with trailing Z -> TIMESTAMP_NTZ (UTC wall clock), fractions of a
    second dropped; null for an empty, missing or impossible date."""
    t = col(s)
    sound = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"), t)
    part = lambda at, n: F.substring(sound, at, n).cast("int")
    return F.try_make_timestamp_ntz(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), F.substring(sound, 18, 2).cast("decimal(8,6)"))


def year_bounds(year, now_iso: str) -> tuple[Column, Column]:
    """[Y-01-01T00:00:00Z, Y-12-31T23:59:59Z]; the upper bound is ``now`` for the
    current year. ``now`` is an argument (ISO string), not read from the clock."""
    y = col(year).cast("int")
    start = F.format_string("%04d-01-01T00:00:00Z", y)
    now_year = int(now_iso[:4])
    end = F.when(y < F.lit(now_year), F.format_string("%04d-12-31T23:59:59Z", y)).otherwise(F.lit(now_iso))
    return start, end


def in_year(published_at, year) -> Column:
    """Publication year by string prefix; a missing date fails."""
    return F.coalesce(F.startswith(col(published_at), col(year).cast("string")), F.lit(False))
