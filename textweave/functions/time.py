"""Time functions: tolerant parsing, mining dates from text, calendar periods, gaps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textweave.functions.text import let

# What counts as a date inside free text.
ISO_DATE = r"\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d{3})?(?:Z|[+-]\d{2}:\d{2})?)?"
SLASH_DATE = r"\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}"

# Period code -> unit of truncation.
PERIODS = {"D": "day", "W": "week", "M": "month", "Y": "year"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _from_iso(text: Column) -> Column:
    return F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))


def _from_slashes(text: Column) -> Column:
    """Month first, else day first; two-digit years 69-99 are 19yy, 00-68 are 20yy."""
    out = F.regexp_replace(text, r"^(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})$", "$1/$2/$3")
    out = F.regexp_replace(out, r"^(\d+/\d+)/(69|[7-9]\d)$", "$1/19$2")
    out = F.regexp_replace(out, r"^(\d+/\d+)/([0-6]\d)$", "$1/20$2")
    return let(out, lambda d: F.coalesce(F.try_to_timestamp(d, F.lit("M/d/yyyy")), F.try_to_timestamp(d, F.lit("d/M/yyyy"))))


def parse_timestamp(text: Column | str) -> Column:
    """Timestamp (no zone, UTC) or null: ISO forms first, then month/day/year, then day/month/year."""
    parsed = let(F.trim(_col(text).cast("string")), lambda v: F.coalesce(_from_iso(v), _from_slashes(v)))
    return parsed.cast("timestamp_ntz")


def timestamp_in_text(text: Column | str) -> Column:
    """First ISO date in the text, else the first slash or dash date; null when neither parses."""
    iso = F.regexp_extract(_col(text), ISO_DATE, 0)
    other = F.regexp_extract(_col(text), SLASH_DATE, 0)
    return F.coalesce(let(iso, _from_iso), _from_slashes(other)).cast("timestamp_ntz")


def period_start(ts: Column | str, period: str) -> Column:
    """First day (DATE) of the D, W (Monday), M or Y period that holds ``ts``."""
    if period not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}")
    day = _col(ts).cast("date")
    return day if period == "D" else F.trunc(day, PERIODS[period])


def period_label(start: Column | str, period: str) -> Column:
    """Label of a period given its first day: 2025-01-15, 2025-01-13/2025-01-19, 2025-01 or 2025."""
    day = _col(start).cast("date")
    if period == "W":
        return F.concat(day.cast("string"), F.lit("/"), F.date_add(day, 6).cast("string"))
    return F.date_format(day, {"D": "yyyy-MM-dd", "M": "yyyy-MM", "Y": "yyyy"}[period])


def gap_seconds(later: Column | str, earlier: Column | str) -> Column:
    """Signed seconds between two timestamps with microsecond precision."""
    micros = lambda c: F.unix_micros(_col(c).cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)
