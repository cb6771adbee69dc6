"""Session times, pacing and dates as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The form of a clock time, and the bounds of pacing in seconds.
TIME = r"(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?"
RETRY_DEFAULT, RETRY_MIN, RETRY_MAX, CRAWL_DELAY_MAX = 5, 1, 60, 30
UNITS = {"s": 1.0, "ms": 1000.0, "ticks": 10_000_000.0}


def seconds_to_clock(sec: Column) -> Column:
    """hh:mm:ss of a number of seconds: truncated, never negative, any number of hours."""
    n = F.greatest(F.lit(0), F.when(sec < 0, 0).otherwise(F.floor(sec))).cast("long")
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", two(F.floor(n / 3600)), two(F.floor(F.pmod(n, F.lit(3600)) / 60)), two(F.pmod(n, F.lit(60))))


def clock(t: Column) -> Column:
    """hh:mm:ss of a clock string of two or three parts; fractions are cut."""
    parts = F.transform(F.split(F.substring_index(F.replace(t, F.lit(","), F.lit(".")), ".", 1), ":"), lambda x: x.try_cast("long"))
    full = F.slice(F.concat(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), parts), -3, 3)
    two = lambda c: F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))
    return F.concat_ws(":", two(full[0]), two(full[1]), two(full[2]))


def clock_seconds(t: Column) -> Column:
    """Seconds of h:mm:ss, null for any other text."""
    part = lambda k: F.regexp_extract(t, r"^(\d+):(\d{2}):(\d{2})$", k).try_cast("long")
    return part(1) * 3600 + part(2) * 60 + part(3)


def time_value(v: Column, unit: str = "s") -> Column:
    """hh:mm:ss of a time in a common form: a number in ``unit``, '1.5s', ISO 8601 'PT1M2S', or a clock; '' for anything else."""
    s = F.trim(v)
    iso = r"(?i)^P?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?$"
    part = lambda k: F.coalesce(F.regexp_extract(s, iso, k).try_cast("double"), F.lit(0.0))
    some = F.concat(*(F.regexp_extract(s, iso, k) for k in (1, 2, 3))) != ""
    return (
        F.when(v.isNull() | (s == ""), "")
        .when(s.rlike(r"^-?\d+(?:\.\d+)?$"), seconds_to_clock(s.try_cast("double") / UNITS[unit]))
        .when(s.rlike(r"^\d+(?:\.\d+)?s$"), seconds_to_clock(F.regexp_extract(s, r"^(.*)s$", 1).try_cast("double")))
        .when(s.rlike(iso) & some, seconds_to_clock(part(1) * 3600 + part(2) * 60 + part(3)))
        .when(s.rlike(f"^{TIME}$"), clock(s))
        .otherwise("")
    )


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number or an HTTP date, between RETRY_MIN and RETRY_MAX; RETRY_DEFAULT where unreadable."""
    number = F.trim(value).try_cast("long")
    date = F.try_to_timestamp(F.regexp_replace(F.trim(value), r"^\w{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(number, date.cast("long") - now.cast("long"))
    return F.when(wait.isNull(), RETRY_DEFAULT).otherwise(F.greatest(F.lit(RETRY_MIN), F.least(wait, F.lit(RETRY_MAX)))).cast("int")


def effective_delay(floor: Column, delay: Column, requests: Column, secs: Column) -> Column:
    """Seconds between requests: the caller's floor, or what the host asks for up to CRAWL_DELAY_MAX, whichever is more."""
    rate = F.when(requests > 0, secs / requests)
    asked = F.greatest(F.coalesce(delay, F.lit(0.0)), F.coalesce(rate, F.lit(0.0)))
    return F.greatest(floor, F.least(asked, F.lit(float(CRAWL_DELAY_MAX))))
