"""Parsers of tag values and times as Column expressions; unreadable values are null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def maxspeed_kph(text: Column) -> Column:
    """km/h without a unit or with one of km/h, kmh, kph, mph and knots."""
    t = F.lower(F.trim(text))
    value = number(t, r"^([0-9]+(?:\.[0-9]+)?) *(?:km/h|kmh|kph|mph|knots)?$")
    return value * F.when(t.endswith("mph"), 1.609344).when(t.endswith("knots"), 1.852).otherwise(1.0)


def duration_s(text: Column) -> Column:
    """hh:mm, hh:mm:ss, ISO 8601 (PT1H30M) or minutes."""
    t = F.trim(text)
    h, m, s = (F.coalesce(number(t, rf"([0-9]+){u}"), F.lit(0.0)) for u in "HMS")
    clock = F.transform(F.split(t, ":"), lambda x: x.try_cast("double"))
    return (
        F.when(F.upper(t).rlike(r"^PT([0-9]+H)?([0-9]+M)?([0-9]+S)?$"), h * 3600 + m * 60 + s)
        .when(t.rlike(r"^[0-9]+:[0-9]{2}$"), F.element_at(clock, 1) * 3600 + F.try_element_at(clock, F.lit(2)) * 60)
        .when(t.rlike(r"^[0-9]+:[0-9]{2}:[0-9]{2}$"), F.element_at(clock, 1) * 3600 + F.try_element_at(clock, F.lit(2)) * 60 + F.try_element_at(clock, F.lit(3)))
        .when(t.rlike(r"^[0-9]+$"), t.try_cast("double") * 60)
    )


def length_m(text: Column) -> Column:
    """Metres (with or without m) or feet and inches (6'7")."""
    t = F.trim(text)
    feet, inches = number(t, r"^([0-9]+)'"), F.coalesce(number(t, r"'([0-9]+)\"$"), F.lit(0.0))
    return F.when(t.rlike(r"^[0-9]+'([0-9]+\")?$"), feet * 0.3048 + inches * 0.0254).otherwise(number(t, r"^([0-9]+(?:\.[0-9]+)?) *m?$"))


def weight_t(text: Column) -> Column:
    """Tonnes, kilograms or pounds."""
    t = F.lower(F.trim(text))
    return number(t, r"^([0-9]+(?:\.[0-9]+)?) *(?:t|kg|lbs)?$") * F.when(t.endswith("kg"), 0.001).when(t.endswith("lbs"), 0.00045359237).otherwise(1.0)


def gtfs_time_s(text: Column) -> Column:
    """Seconds of the service day; hours may pass 24."""
    p = F.split(F.trim(text), ":")
    whole = F.trim(text).rlike(r"^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$")
    return F.when(whole, F.element_at(p, 1).try_cast("int") * 3600 + F.try_element_at(p, F.lit(2)).try_cast("int") * 60 + F.try_element_at(p, F.lit(3)).try_cast("int"))


def attribute_name(text: Column) -> Column:
    """Lower case, each run of other characters one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def levels(text: Column) -> Column:
    """Levels of '0;1' lists and '-1-2' ranges, as an array of ints."""
    part = F.split(text, ";")
    bounds = lambda x: (F.regexp_extract(x, r"^(-?[0-9]+)", 1).cast("int"), F.regexp_extract(x, r"(-?[0-9]+)$", 1).cast("int"))

    def one(x: Column) -> Column:
        lo = bounds(x)[0]
        hi = F.when(x.rlike(r"^-?[0-9]+--?[0-9]+$"), F.regexp_extract(x, r"^-?[0-9]+-(-?[0-9]+)$", 1).cast("int")).otherwise(lo)
        return F.sequence(lo, hi)

    return F.flatten(F.transform(part, one))


def bucket_of_week(ts: Column, minutes: int) -> Column:
    """Time-of-week bucket from Monday 00:00."""
    return F.floor((F.weekday(ts) * 1440 + F.hour(ts) * 60 + F.minute(ts)) / minutes).cast("int")


def bucket_label(bucket: Column, minutes: int) -> Column:
    m = bucket * minutes
    day = F.element_at(F.array(*map(F.lit, ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"))), (F.floor(m / 1440) + 1).cast("int"))
    return F.concat(day, F.lit(" "), F.lpad(F.floor(m % 1440 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((m % 60).cast("int").cast("string"), 2, "0"))
