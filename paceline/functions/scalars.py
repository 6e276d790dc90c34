"""Scalar column functions; null means unknown throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of WMO weather codes.
WEATHER_LABELS = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast", 45: "Fog", 48: "Depositing rime fog",
    51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle", 56: "Light freezing drizzle", 57: "Dense freezing drizzle",
    61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain", 66: "Light freezing rain", 67: "Heavy freezing rain",
    71: "Slight snow fall", 73: "Moderate snow fall", 75: "Heavy snow fall", 77: "Snow grains",
    80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers", 85: "Slight snow showers", 86: "Heavy snow showers",
    95: "Thunderstorm", 96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail",
}
#: The sixteen compass points from north.
COMPASS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Lap roles by intensity.
ROLES = {"warmup": "warmup", "active": "work", "interval": "work", "rest": "recovery", "recovery": "recovery", "cooldown": "cooldown"}


def finite(c: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; false for null."""
    d = c.cast("double")
    return F.coalesce(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), F.lit(False))


def native_total(c: Column) -> Column:
    """c if finite and at least 0, else null."""
    return F.when(finite(c) & (c >= 0), c)


def native_positive(c: Column) -> Column:
    """c if finite and above 0, else null."""
    return F.when(finite(c) & (c > 0), c)


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("int")


def lerp(start: Column, end: Column, ratio: Column) -> Column:
    """Linear interpolation; a missing side gives the other one."""
    return F.coalesce(start + (end - start) * ratio, start, end)


def lerp_int(start: Column, end: Column, ratio: Column) -> Column:
    return half_even(lerp(start.cast("double"), end.cast("double"), ratio))


def seconds(late: Column, early: Column) -> Column:
    """late - early in seconds."""
    return (F.unix_micros(late) - F.unix_micros(early)) / F.lit(1e6)


def plus_seconds(ts: Column, s: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.bround(s * 1e6, 0).cast("long"))


def km_per_hour(distance_m: Column, time_s: Column) -> Column:
    """Average speed; null if either is null or 0."""
    return F.when((distance_m != 0) & (time_s != 0), F.try_divide(distance_m, time_s) * 3.6)


def compass(degrees: Column) -> Column:
    at = F.pmod(F.bround(degrees / 22.5, 0).cast("int"), F.lit(16))
    return F.element_at(F.array(*map(F.lit, COMPASS)), at + 1)


def weather_label(code: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in WEATHER_LABELS.items() for x in pair)), code.cast("int"))


def lap_role(intensity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair)), intensity), F.lit("unknown"))


def title_label(c: Column) -> Column:
    """Underscores become spaces; each run of letters starts with a capital."""
    runs = F.regexp_extract_all(F.trim(F.replace(c, F.lit("_"), F.lit(" "))), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")


def activity_type(sport: Column, sub_sport: Column) -> Column:
    sub = F.when((F.length(sub_sport) > 0) & ~F.lower(sub_sport).isin("generic", "none"), sub_sport)
    return title_label(F.coalesce(sub, F.when(F.length(sport) > 0, sport)))


def step_index(c: Column) -> Column:
    """A message index: a whole number in [0, 65535) without reserved bits, its selected bit ignored; else null."""
    n = F.when(c.rlike(r"^\d{1,5}$"), c.cast("int"))
    return F.when((n < 0xFFFF) & (n.bitwiseAND(F.lit(0x7000)) == 0), n.bitwiseAND(F.lit(0x0FFF)))


def degrees_of_semicircles(c: Column) -> Column:
    return c.cast("double") * 180 / 2**31


def zone_index(hr: Column, thresholds: tuple[int, ...]) -> Column:
    """How many thresholds hr has reached."""
    out = F.lit(0)
    for t in thresholds:
        out = out + (hr >= t).cast("int")
    return out
