"""Time expressions; the session time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKUP_ID = "yyyyMMdd'T'HHmmss'Z'"


def iso_utc(ts: Column) -> Column:
    """RFC 3339 with ``Z``; zeros at the end of the fraction are left out."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def backup_id(ts: Column) -> Column:
    return F.date_format(ts, BACKUP_ID)


def backup_time(name: Column) -> Column:
    """The time in a backup's name; null for other names."""
    return F.when(name.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(name, F.lit(BACKUP_ID)))


def day_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def week_bucket(ts: Column) -> Column:
    """ISO year and week."""
    return F.format_string("%04d-%02d", F.extract(F.lit("YEAROFWEEK"), ts).cast("int"), F.weekofyear(ts))


def month_bucket(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def is_due(last: Column, interval_minutes: Column, now: Column) -> Column:
    """Whether a rescan is due: an interval is set and has passed, or nothing was ever scanned."""
    return interval_minutes.isNotNull() & (last.isNull() | (last + F.make_interval(mins=interval_minutes) <= now))


def before_cutoff(ts: Column, now: Column, hours: int) -> Column:
    return ts < now - F.make_interval(hours=F.lit(hours))
