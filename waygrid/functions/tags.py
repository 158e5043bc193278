"""Street tags (a map<string,string> column) to typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import maxspeed_kph

#: Highway tag to road class.
ROAD_CLASS = {
    "motorway": "motorway", "motorway_link": "motorway", "trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary",
    "secondary": "secondary", "secondary_link": "secondary", "tertiary": "tertiary", "tertiary_link": "tertiary", "residential": "residential",
    "unclassified": "residential", "living_street": "residential", "service": "service", "busway": "service", "track": "track", "path": "path",
    "cycleway": "path", "footway": "path", "pedestrian": "path", "steps": "path", "bridleway": "path",
}
#: Surface tag to surface class.
SURFACE = {
    "asphalt": "asphalt", "paved": "paved", "concrete": "paved", "concrete:lanes": "paved", "concrete:plates": "paved",
    "gravel": "gravel", "fine_gravel": "gravel", "pebblestone": "gravel", "cobblestone": "cobblestone", "sett": "cobblestone", "unhewn_cobblestone": "cobblestone",
    "ground": "ground", "earth": "ground", "grass": "ground", "mud": "ground", "dirt": "dirt", "compacted": "dirt", "sand": "sand",
}
SMOOTHNESS = ("excellent", "good", "intermediate", "bad", "very_bad", "horrible", "very_horrible", "impassable")


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def road_class(tags: Column) -> Column:
    """Null for what is no way: a highway tag that is unknown isn't looked at further."""
    ferry = (tags["route"] == "ferry") | tags["ferry"].isNotNull()
    return F.when(tags["highway"].isNotNull(), lookup(ROAD_CLASS, tags["highway"])).when(F.coalesce(ferry, F.lit(False)), "ferry")


def surface(tags: Column) -> Column:
    return F.coalesce(lookup(SURFACE, tags["surface"]), F.lit("unknown"))


def smoothness(tags: Column) -> Column:
    return F.when(tags["smoothness"].isin(*SMOOTHNESS), tags["smoothness"]).otherwise("unknown")


def toll(tags: Column) -> Column:
    return F.coalesce(tags["toll"].isin("yes", "true", "1"), F.lit(False))


def direction(tags: Column) -> Column:
    """1 along the way only, -1 against it only, 0 both."""
    one = tags["oneway"]
    return F.when(one.isin("yes", "true", "1"), 1).when(one.isin("-1", "reverse"), -1).when(one.isin("no", "false", "0"), 0).when((tags["junction"] == "roundabout") | (tags["highway"] == "motorway"), 1).otherwise(0)


def speed_limits(tags: Column) -> tuple[Column, Column]:
    both = maxspeed_kph(tags["maxspeed"])
    return F.coalesce(maxspeed_kph(tags["maxspeed:forward"]), both), F.coalesce(maxspeed_kph(tags["maxspeed:backward"]), both)


def lanes(tags: Column) -> tuple[Column, Column]:
    """Lanes along and against the way: explicit ones first, then what a total leaves, then its halves."""
    total, ahead, back = (tags[k].try_cast("int") for k in ("lanes", "lanes:forward", "lanes:backward"))
    way = direction(tags)
    no = ahead.isNull() & back.isNull()
    forward = F.when(no, F.when(way == 1, total).when(way == 0, F.ceil(total / 2).cast("int"))).otherwise(F.coalesce(ahead, F.greatest(total - F.coalesce(back, F.lit(0)), F.lit(1))))
    backward = F.when(no, F.when(way == -1, total).when(way == 0, F.greatest(F.floor(total / 2).cast("int"), F.when(total.isNotNull(), 1)))).otherwise(F.coalesce(back, F.greatest(total - F.coalesce(ahead, F.lit(0)), F.lit(1))))
    return forward, backward


def turn_lanes(value: Column) -> Column:
    """Of each lane, from the left, its indications."""
    return F.transform(F.split(value, r"\|"), lambda lane: F.filter(F.split(lane, ";"), lambda x: (x != "") & (x != "none")))


def tobler(gradient: Column, k: float = 3.5, best: float = 0.05, low: float = 0.1, high: float = 1.2) -> Column:
    """Speed factor of a slope, 1 on the flat."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.exp(-k * F.abs(gradient + best) + k * abs(best))))


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between points, constant beyond them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, u), (b, v) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, u + (x - a) / (b - a) * (v - u))
    return out.otherwise(points[-1][1])


def greenshields(ratio: Column, low: float = 0.05) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), 1 - ratio))


def bpr(ratio: Column, alpha: float = 0.15, beta: float = 4.0, low: float = 0.05) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(1.0), 1 / (1 + alpha * F.pow(ratio, F.lit(beta)))))


def cch_ticks(weight: Column) -> Column:
    """Fixed-point weight in 1/1024: at least one tick if positive; null is unreachable; what overflows saturates below it."""
    ticks = F.round(weight * 1024)
    return F.when(weight.isNull(), F.lit(4294967295)).when(ticks >= 4294967294, F.lit(4294967294)).when((weight > 0) & (ticks < 1), F.lit(1)).otherwise(ticks.cast("long"))
