"""Scalar functions as column expressions: distances, paces, text of paces, wire values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The mean earth radius in metres (twice), and the rowing constant of watts and pace.
EARTH_DIAMETER_M = 12_742_000.0
ROWING_WATTS = 2.80


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, clamp: bool = False) -> Column:
    """Great-circle distance in metres between points given in degrees."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return EARTH_DIAMETER_M * F.asin(F.sqrt(F.least(F.lit(1.0), h) if clamp else h))


def pace_seconds(speed: Column, base_m: float = 1000.0) -> Column:
    """Seconds for ``base_m`` metres; null where there is no positive speed."""
    return F.when(speed > 0, F.lit(base_m) / F.when(speed > 0, speed))


def speed_from_pace(seconds: Column, base_m: float = 1000.0) -> Column:
    """Metres a second of a pace; a pace that isn't positive is an error, as it says no speed."""
    return F.when(seconds > 0, F.lit(base_m) / F.when(seconds > 0, seconds)).when(
        seconds.isNotNull(), F.raise_error(F.concat(F.lit("no speed for the pace "), seconds.cast("string"))).cast("double")
    )


def format_speed_kmh(speed: Column) -> Column:
    """km/h with one decimal, half to even of the exact binary value."""
    exact = (speed * 3.6).cast("decimal(38,18)")
    return F.when(speed.isNotNull(), F.bround(exact, 1).cast("decimal(20,1)").cast("string"))


def format_minutes(seconds: Column) -> Column:
    """m:ss of a duration, half seconds up; minutes go on beyond an hour."""
    return format_pace(seconds)


def format_tenths(seconds: Column) -> Column:
    """m:ss.t, half tenths up: how rowers write the pace of 500 m."""
    tenths = F.floor(seconds * 10 + 0.5).cast("long")
    rest = tenths % 600
    return F.concat(
        F.floor(tenths / 600).cast("string"), F.lit(":"), F.lpad(F.floor(rest / 10).cast("string"), 2, "0"), F.lit("."), (rest % 10).cast("string")
    )


def iso_utc(seconds: Column) -> Column:
    """yyyy-mm-ddThh:mm:ssZ of seconds since 1970, whatever the session's zone."""
    return F.concat(iso_local(seconds), F.lit("Z"))


def iso_local(seconds: Column) -> Column:
    """yyyy-mm-ddThh:mm:ss of seconds since 1970 as a local clock shows them: without a zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    rest = F.pmod(seconds.cast("long"), F.lit(86400))
    two = lambda c: F.lpad(F.floor(c).cast("long").cast("string"), 2, "0")
    return F.concat(
        F.lpad(F.year(day).cast("string"), 4, "0"), F.lit("-"), two(F.month(day)), F.lit("-"), two(F.dayofmonth(day)),
        F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60),
    )


def may_be_fast(lat1: Column, lon1: Column, lat2: Column, lon2: Column, seconds: Column, ceiling: float) -> Column:
    """Whether two points could be farther apart than ``ceiling`` metres a second allows: a bound by degrees, without trigonometry."""
    return 111_320.0 * (F.abs(lat2 - lat1) + F.abs(lon2 - lon1)) > F.lit(float(ceiling)) * seconds


def zone_bounds(text: str) -> list[float]:
    """Bounds out of "120,140,160"; ValueError if one is no number or they don't ascend."""
    bounds = [float(x) for x in text.split(",")]
    if bounds != sorted(bounds):
        raise ValueError("bounds must ascend")
    return bounds


def format_pace(seconds: Column) -> Column:
    """m:ss, half seconds up."""
    whole = F.floor(seconds + 0.5).cast("long")
    return F.concat(
        F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0")
    )


def rowing_watts(pace_500: Column) -> Column:
    return ROWING_WATTS / F.pow(pace_500 / 500, F.lit(3.0))


def rowing_pace(watts: Column) -> Column:
    return 500 * F.pow(ROWING_WATTS / watts, F.lit(1 / 3))


def sentinel_to_null(raw: Column, sentinel: int, scale: float = 1.0, offset: float = 0.0) -> Column:
    """The sentinel means absent and goes before scaling; 0 is a value."""
    return F.when(raw != sentinel, raw / F.lit(float(scale)) - F.lit(float(offset)))


def left_right_balance(raw: Column) -> Column:
    """Right side's percent of an 8-bit balance, whichever side the flag names; null beyond 100."""
    percent = raw.bitwiseAND(F.lit(0x7F))
    return F.when(percent <= 100, F.when(raw.bitwiseAND(F.lit(0x80)) != 0, percent).otherwise(100 - percent))


def sniff(content: Column) -> Column:
    """What bytes (or a text) are that hold no activity: gpx, tcx, html, xml, json, text or none; by their first 512."""
    head = F.decode(F.substring(content.cast("binary"), 1, 512), "ISO-8859-1")
    head = F.lower(F.ltrim(head, F.lit("\u00ef\u00bb\u00bf \t\r\n")))
    return (
        F.when(head.startswith("<") & head.contains("<gpx"), "gpx")
        .when(head.startswith("<") & head.contains("<trainingcenterdatabase"), "tcx")
        .when(head.startswith("<") & (head.contains("<!doctype html") | head.contains("<html")), "html")
        .when(head.startswith("<"), "xml")
        .when(head.startswith("{") | head.startswith("["), "json")
        .when(F.substring(head, 1, 256).rlike(r"^[\x09-\x7E]+$"), "text")
        .otherwise("none")
    )
