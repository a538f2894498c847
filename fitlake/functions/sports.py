"""How each sport measures itself: a small table, and what follows from it for paces, cadences and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import scalar

#: Fixed values by profile: how speed is shown, the signal that tells effort, the unit of cadence.
PROFILES = {
    "running": ("per_km", "speed", "spm"),
    "cycling": ("speed", "power", "rpm"),
    "pool_swim": ("per_100m", "speed", "strokes/min"),
    "open_water_swim": ("per_100m", "speed", "strokes/min"),
    "rowing": ("per_500m", "power", "strokes/min"),
    "hiking": ("per_km", "speed", "spm"),
    "cross_country_skiing": ("per_km", "speed", "spm"),
    "generic": ("per_km", "speed", "rpm"),
}
#: Sports with a profile of another name, metres of a pace, cadence below which runners count one leg.
SAME_AS = {"walking": "hiking"}
BASE_M = {"per_km": 1000.0, "per_100m": 100.0, "per_500m": 500.0}
SUFFIX = {"per_km": "/km", "per_100m": "/100m", "per_500m": "/500m"}
ONE_LEG_BELOW = 130.0


def _lookup(key: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[key]


def profile_of(sport: Column, sub_sport: Column) -> Column:
    """The name of the profile of a sport; one that isn't known is generic."""
    sport, sub = F.lower(F.coalesce(sport, F.lit(""))), F.lower(F.coalesce(sub_sport, F.lit("")))
    named = F.coalesce(_lookup(sport, SAME_AS), sport)
    by_name = [k for k in PROFILES if k not in ("pool_swim", "open_water_swim", "generic")]
    return (
        F.when(sport == "swimming", F.when(sub == "open_water", "open_water_swim").otherwise("pool_swim"))
        .when((sub == "indoor_rowing") | (sport == "fitness_equipment") & sub.contains("row"), "rowing")
        .when(named.isin(*by_name), named)
        .otherwise("generic")
    )


def pace_style(profile: Column) -> Column:
    return _lookup(profile, {k: v[0] for k, v in PROFILES.items()})


def primary_signal(profile: Column, has_power: Column, has_speed: Column) -> Column:
    """power, speed or none: what the profile prefers, of what there is."""
    prefers = _lookup(profile, {k: v[1] for k, v in PROFILES.items()})
    return F.when((prefers == "power") & has_power, "power").when(has_speed, "speed").otherwise("none")


def cadence_display(cadence: Column, profile: Column) -> Column:
    """(value, units, note): a runner's cadence of one leg is doubled, and the note says so."""
    one_leg = (profile == "running") & (cadence < ONE_LEG_BELOW)
    return F.struct(
        F.when(one_leg, cadence * 2.0).otherwise(cadence).alias("value"),
        _lookup(profile, {k: v[2] for k, v in PROFILES.items()}).alias("units"),
        F.when(one_leg, "doubled_per_leg_cadence").alias("note"),
    )


def pace(speed: Column, style: Column) -> Column:
    """Seconds for the distance of a style; null without a positive speed, or if the style shows speed."""
    base = _lookup(style, BASE_M)
    return F.when(speed > 0, base / F.when(speed > 0, speed))


def pace_text(seconds: Column, style: Column, suffix: bool = False) -> Column:
    """m:ss, with tenths for 500 m; null for a style without pace."""
    text = F.when(style == "per_500m", scalar.format_tenths(seconds)).when(style.isin("per_km", "per_100m"), scalar.format_pace(seconds))
    return F.concat(text, _lookup(style, SUFFIX)) if suffix else text


def interval_label(n: Column, duration_s: Column, distance_m: Column, intensity: Column, rest_s: Column, style: Column, swim: Column) -> Column:
    """A repeat in words: 6 x 400m @ 3:45/km rest 1:30. Short distances and cyclists go by time."""
    metres = lambda c, d: F.bround(c, d).cast(f"decimal(18,{d})").cast("string")
    by_distance = F.when(distance_m >= 950, F.concat(metres(distance_m / 1000, 1), F.lit("km"))).otherwise(F.concat(metres(distance_m, 0), F.lit("m")))
    head = (
        F.when(swim & distance_m.isNotNull(), F.concat(metres(distance_m, 0), F.lit("m")))
        .when((distance_m >= 200) & (style != "speed"), by_distance)
        .otherwise(F.coalesce(scalar.format_minutes(duration_s), F.lit("?")))
    )
    at = F.when(style == "speed", F.concat(F.lit(" @ "), metres(intensity, 0), F.lit(" W"))).otherwise(
        F.concat(F.lit(" @ "), pace_text(pace(intensity, style), style, suffix=True))
    )
    rest = F.concat(F.lit(" rest "), scalar.format_minutes(rest_s))
    return F.concat(n.cast("string"), F.lit(" x "), head, F.coalesce(at, F.lit("")), F.coalesce(rest, F.lit("")))
