"""Date and time expressions. Every "now" is a parameter; the session time zone is taken to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(text: Column) -> Column:
    """ISO dates and times (with zone: as UTC), compact dates, and overflowing seconds rolled forward; else null."""
    t = F.trim(text.cast("string"))
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
    compact = F.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
    over = r"^(\d{4}-\d{2}-\d{2})[ T](\d{2}):(\d{2}):(\d+)$"
    minute = F.try_to_timestamp(F.concat(F.regexp_extract(t, over, 1), F.lit(" "), F.regexp_extract(t, over, 2), F.lit(":"), F.regexp_extract(t, over, 3), F.lit(":00")))
    seconds = F.regexp_extract(t, over, 4).try_cast("int")
    rolled = F.when(t.rlike(over), minute + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)")))
    return F.coalesce(iso, compact, rolled)


def subtract_months(ts: Column, months: int) -> Column:
    """Calendar months back, day clamped, time of day kept; not positive: the same time."""
    return ts - F.make_ym_interval(F.lit(0), F.lit(months)) if months > 0 else ts


def days_since(ts: Column, as_of: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(as_of) - micros(ts)) / 86_400_000_000)


#: The labels of date_bucket, in order.
BUCKETS = ["Today", "Yesterday", "This week", "This month", "Older", "Unknown date"]


def date_bucket(ts: Column, as_of: Column) -> Column:
    """Future dates fall in "This week"."""
    d = days_since(ts, as_of)
    return F.when(ts.isNull(), "Unknown date").when(d == 0, "Today").when(d == 1, "Yesterday").when(d <= 7, "This week").when(d <= 30, "This month").otherwise("Older")


def age_label(ts: Column, as_of: Column) -> Column:
    d = days_since(ts, as_of)
    old = F.concat(F.floor(d / 30).cast("string"), F.lit("mo ago"))
    return F.when(d < 1, "today").when(d < 30, F.concat(d.cast("string"), F.lit("d ago"))).when(d.isNotNull(), old)


def format_seconds(seconds: Column) -> Column:
    """Like ``1h 2m 3s``; zero hours and minutes are left out."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    part = lambda v, unit: F.concat(v.cast("string"), F.lit(unit))
    return F.concat_ws(" ", F.when(h > 0, part(h, "h")), F.when(m > 0, part(m, "m")), part(s % 60, "s"))


def elapsed_seconds(started: Column, finished: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.coalesce(finished, as_of) - started)).cast("long")


def us_date(text: Column) -> Column:
    """ISO date as MM/dd/yyyy; what is no date passes through."""
    d = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    return F.coalesce(F.date_format(d, "MM/dd/yyyy"), text)


def rfc2822_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
