"""Time buckets: fixed steps by arithmetic, months and years by the calendar, with or without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

#: Milliseconds of a step; weeks start on Monday, four days after the epoch's Thursday.
STEPS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
MONDAY = 4 * 86_400_000


def step_ms(n: int, unit: str) -> int:
    if n <= 0:
        raise QueryError("a bucket is longer than nothing")
    if unit not in STEPS:
        raise QueryError(f"no duration {n}{unit}")
    return n * STEPS[unit]


def _floor(ms: Column, step: int, origin: int) -> Column:
    return ms - F.pmod(ms - F.lit(origin), F.lit(step))


def bucket_ms(ms: Column, n: int, unit: str) -> Column:
    """Epoch milliseconds to the start of their bucket."""
    if unit in ("mo", "y"):
        return F.unix_millis(_calendar(F.timestamp_millis(ms), n, unit))
    return _floor(ms, step_ms(n, unit), MONDAY if unit == "w" else 0)


def _calendar(t: Column, n: int, unit: str) -> Column:
    months = n * (12 if unit == "y" else 1)
    k = F.year(t) * 12 + F.month(t) - 1
    k = k - F.pmod(k, F.lit(months))
    return F.make_date(F.floor(k / 12).cast("int"), (F.pmod(k, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")


def _ms(t: Column, ntz: bool) -> Column:
    """Epoch milliseconds; a time without zone is read as UTC."""
    return F.unix_millis(F.to_utc_timestamp(t.cast("timestamp"), F.current_timezone()) if ntz else t)


def bucket(t: Column, n: int, unit: str, zone: str | None, ntz: bool) -> Column:
    """A timestamp's bucket, of the timestamp's own type. Sessions are taken to be in UTC, as tests and deployments set them."""
    at = F.unix_millis(t.cast("timestamp"))
    if zone is None:
        out = F.timestamp_millis(bucket_ms(at, n, unit))
    else:
        out = F.timestamp_millis(zoned_ms(at, n, unit, zone))
    return out.cast("timestamp_ntz") if ntz else out


def offset_ms(ms: Column, zone: str) -> Column:
    """The zone's offset at an instant."""
    t = F.timestamp_millis(ms)
    return F.unix_millis(F.from_utc_timestamp(t, zone)) - ms


def zoned_ms(ms: Column, n: int, unit: str, zone: str) -> Column:
    """Days and longer start at local midnight; shorter steps keep the two buckets of an hour that comes twice."""
    local = ms + offset_ms(ms, zone)
    if unit in ("d", "w", "mo", "y"):
        start = bucket_ms(local, n, unit)
        return F.unix_millis(F.to_utc_timestamp(F.timestamp_millis(start), zone))
    # within one offset, local steps are steps of the instant: subtract what has passed of the step
    return ms - F.pmod(local, F.lit(step_ms(n, unit)))
