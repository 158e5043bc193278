"""Column expressions on single values: interpolation, motion, names, types and spoken lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import RADIUS

#: Countries and territories that drive on the left, by ISO 3166-1 code.
LEFT_HAND = (
    "AG AI AU BB BD BM BN BS BT BW CC CK CX CY DM FJ FK GB GD GG GY HK IE IM IN IO JE JM JP KE KI KN KY LC LK LS MO MS MT MU MV MW MY MZ "
    "NA NF NP NR NU NZ PG PK PN SB SC SG SH SR SZ TC TH TK TL TO TT TV TZ UG VC VG VI WS ZA ZM ZW"
).split()
#: Modes by route type, single numbers and ranges.
ROUTE_MODES = [(0, 0, "tram"), (1, 1, "subway"), (2, 2, "rail"), (100, 199, "rail"), (3, 3, "bus"), (700, 799, "bus"), (4, 4, "ferry"), (1000, 1099, "ferry"), (5, 5, "cable_car"), (6, 6, "gondola"), (7, 7, "funicular"), (200, 299, "coach"), (1100, 1199, "air")]
#: Metres of a mile, feet of a metre.
MILE_M, FEET_PER_M = 1609.344, 3.280839895013123


def driving_side(code: Column) -> Column:
    return F.when(F.upper(F.trim(code)).isin(LEFT_HAND), "left").otherwise("right")


def route_mode(route_type: Column) -> Column:
    """The mode of a GTFS route type, given as text; ``other`` for what isn't a known number."""
    number = F.when(F.regexp_like(route_type, F.lit("^[0-9]{1,9}$")), route_type.try_cast("int"))
    out = F.lit("other")
    for low, high, mode in ROUTE_MODES:
        out = F.when(number.between(low, high), mode).otherwise(out)
    return out


def interpolate(a: list[Column], b: list[Column], fraction: Column) -> list[Column]:
    """The point at fraction of the way from a to b, coordinate by coordinate."""
    return [x + (y - x) * fraction for x, y in zip(a, b, strict=True)]


def offset_point(lon: Column, lat: Column, east_m: Column, north_m: Column) -> tuple[Column, Column]:
    return lon + F.degrees(east_m / (F.lit(RADIUS) * F.cos(F.radians(lat)))), lat + F.degrees(north_m / F.lit(RADIUS))


def trapezoid(elapsed: Column, duration: Column, length: Column, accel: float, decel: float) -> Column:
    """Distance after elapsed seconds of a run that speeds up, cruises and brakes over length in duration; even speed where no such run fits."""
    a, d = max(accel, 0.05), max(decel, 0.05)
    k = 0.5 * (1 / a + 1 / d)
    t = F.greatest(F.lit(0.0), F.least(elapsed, duration))
    even = length * t / duration
    rest = duration * duration - 4 * k * length
    top = (duration - F.sqrt(F.greatest(rest, F.lit(0.0)))) / (2 * k)
    up, down = top / a, top / d
    cruise = F.greatest(duration - up - down, F.lit(0.0))
    braking = F.least(t - up - cruise, down)
    run = F.when(t <= up, 0.5 * a * t * t).when(t <= up + cruise, 0.5 * a * up * up + top * (t - up)).otherwise(0.5 * a * up * up + top * cruise + top * braking - 0.5 * d * braking * braking)
    return F.when((duration <= 0) | (length <= 0), 0.0).when((rest <= 0) | (top <= 0), even).otherwise(run)


def canonical(value: Column, kind: str) -> Column:
    """The text of a value that domains and drift checks compare: whole floats without a fraction, no exponents."""
    if kind != "float":
        return value.cast("string")
    whole = F.when(F.abs(value) < 1e18, value.cast("decimal(38,0)").cast("string"))
    plain = F.abs(value).between(1e-3, 1e7)
    long = F.regexp_replace(value.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(value == F.floor(value), whole).when(plain, value.cast("string")).otherwise(long)


def promoted(left: Column, right: Column) -> Column:
    """The type that holds values of both: of boolean, integer, float, string and json."""
    both = F.array_sort(F.array(left, right))
    return F.when(left == right, left).when(both == F.array(F.lit("float"), F.lit("integer")), "float").when(both == F.array(F.lit("json"), F.lit("string")), "json").otherwise("string")


def inferred(text: Column) -> Column:
    """The narrowest type of a value's text."""
    return (
        F.when(text.isin("true", "false"), "boolean")
        .when(F.regexp_like(text, F.lit(r"^[+-]?[0-9]{1,18}$")), "integer")
        .when(F.regexp_like(text, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")), "float")
        .when(F.regexp_like(text, F.lit(r"^\s*[\[{]")) & F.get_json_object(text, "$").isNotNull(), "json")
        .otherwise("string")
    )


def component_map(names: list[str], values: Column) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, names)), values)


def _rounded(value: Column, step: float) -> Column:
    return F.floor(value / step + 0.5) * step


def spoken_distance(metres: Column, imperial: bool = False) -> tuple[Column, Column]:
    """(value, unit) as it is spoken: coarser the longer; decimals below ten only."""
    m = F.greatest(metres, F.lit(0.0))
    small = lambda v: F.when(v < 9.5, F.greatest(F.floor(v + 0.5), F.lit(1)).cast("double")).when(v < 95, _rounded(v, 10.0)).otherwise(_rounded(v, 50.0))
    large = lambda v: F.when(v < 9.95, F.round(F.floor(v * 10 + 0.5) / 10, 1)).otherwise(F.floor(v + 0.5).cast("double"))
    if imperial:
        miles = m / MILE_M
        near = miles < 0.095
        return F.when(near, small(m * FEET_PER_M)).otherwise(large(miles)), F.when(near, "feet").otherwise("miles")
    near = small(m) < 1000
    return F.when(near, small(m)).otherwise(large(m / 1000)), F.when(near, "meters").otherwise("kilometers")


def instant(text: Column, zone: str) -> Column:
    """Timestamp of an ISO date and time: by its own offset, or as wall time of the zone."""
    own = F.regexp_like(text, F.lit(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"))
    return F.when(own, F.try_to_timestamp(text)).otherwise(F.to_utc_timestamp(F.try_to_timestamp(F.concat(F.regexp_replace(text, "T", " "), F.lit("+00:00"))), zone))


def service_zero(day: Column, zone: str) -> Column:
    """Unix seconds that a service day's times count from: twelve hours before its local noon."""
    return F.unix_seconds(F.to_utc_timestamp(F.to_timestamp(F.concat(day.cast("string"), F.lit(" 12:00:00+00:00"))), zone)) - 12 * 3600
