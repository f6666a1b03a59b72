"""Time functions as columns. Naive times are UTC; conversions go through the zone's rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import ZONE_ALIASES

FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def zone(name: str | None) -> str:
    """A zone that Java knows: legacy names mapped, unknown ones UTC."""
    import zoneinfo

    named = ZONE_ALIASES.get(name or "", name or "UTC")
    try:
        zoneinfo.ZoneInfo(named)
    except (ValueError, zoneinfo.ZoneInfoNotFoundError):
        return "UTC"
    return named


def parsed(text: Column) -> Column:
    """A timestamp of ISO or the plain formats, without its offset; null if it is none."""
    bare = F.regexp_replace(text, r"(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def to_utc(local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(zone(tz)), F.lit("UTC"), local)


def from_utc(utc: Column, tz: str) -> Column:
    """As text of the zone."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone(tz)), utc), "yyyy-MM-dd HH:mm:ss")


def epoch(text: Column) -> Column:
    """Seconds from a number, a numeric text or a UTC date; null for none."""
    t = F.trim(text)
    return F.when(F.lower(t).isin("none", "null", ""), None).otherwise(F.coalesce(t.try_cast("double"), F.unix_micros(F.try_to_timestamp(t)) / 1e6))


def seconds_between(start: Column, end: Column) -> Column:
    return F.greatest(F.timestamp_diff("SECOND", start, end), F.lit(0).cast("long"))


def duration_label(seconds: Column) -> Column:
    """HH:MM:SS, with days in front from one day on."""
    d = lambda unit, of=None: F.floor(seconds / unit) if of is None else F.floor(F.pmod(seconds, F.lit(of)) / unit)
    clock = F.format_string("%02d:%02d:%02d", d(3600, 86400), d(60, 3600), F.pmod(seconds, F.lit(60)))
    return F.when(seconds >= 86400, F.concat(d(86400).cast("string"), F.lit("d "), clock)).otherwise(clock)
