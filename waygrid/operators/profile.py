"""Profiles: declarative rules compiled to per-edge time and cost columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default speeds in km/h by road class.
SPEEDS = {
    "motorway": 110.0, "trunk": 90.0, "primary": 70.0, "secondary": 60.0, "tertiary": 50.0, "residential": 30.0,
    "service": 20.0, "track": 15.0, "ferry": 20.0, "path": 5.0, "unknown": 25.0,
}
HIGHWAYS = ("motorway", "trunk", "primary")


@dataclass(frozen=True)
class Rule:
    """All conditions must hold; value is a speed or a factor."""

    when: dict[str, str]
    value: float = 0.0

    def holds(self) -> Column:
        return reduce(lambda a, b: a & b, [F.lower(F.col(k).cast("string")) == v.lower() for k, v in self.when.items()], F.lit(True))


@dataclass(frozen=True)
class Profile:
    mode_bit: int = 1
    motorised: bool = True
    posted: str = "cap"  # prefer, cap or ignore
    speeds: dict[str, float] = field(default_factory=lambda: dict(SPEEDS))
    speed_rules: tuple[Rule, ...] = ()
    factors: tuple[Rule, ...] = ()
    exclude: tuple[Rule, ...] = ()
    time_weight: float = 1.0
    distance_weight: float = 0.0
    service_penalty: float = 0.0
    prefer_highways: float = 0.5
    prefer_tracks: float = 0.5
    prefer_tolls: float = 0.5
    prefer_ferries: float = 0.5
    allow_ferries: bool = True
    max_grade_permille: float | None = None


def speed(p: Profile) -> Column:
    """The first matching speed rule, else the class default, under the posted-limit policy."""
    default = F.create_map(*[F.lit(x) for kv in p.speeds.items() for x in kv])[F.col("road_class")]
    chosen = reduce(lambda acc, r: F.when(r.holds(), F.lit(r.value)).otherwise(acc), reversed(p.speed_rules), default)
    if p.motorised and p.posted != "ignore":
        limit = F.col("max_speed_kph")
        chosen = F.coalesce(limit if p.posted == "prefer" else F.least(limit, chosen), chosen)
    return chosen


def factor(p: Profile) -> Column:
    """The product of all matching factors."""
    return reduce(lambda acc, r: acc * F.when(r.holds(), F.lit(r.value)).otherwise(1.0), p.factors, F.lit(1.0))


def preference(p: float) -> float:
    return min(1.5, max(0.5, 1.5 - p))


def compile_profile(edges: DataFrame, p: Profile) -> DataFrame:
    """edges with time_s and cost; both null where the profile can't use the edge."""
    metres = F.greatest(speed(p) * factor(p), F.lit(0.1)) / 3.6
    time = F.col("length_m") / metres
    cost = time * p.time_weight + F.col("length_m") * p.distance_weight + F.when(F.col("road_class") == "service", p.service_penalty).otherwise(0.0)
    for holds, weight in (
        (F.col("road_class") == "ferry", p.prefer_ferries),
        (F.col("road_class").isin(*HIGHWAYS), p.prefer_highways),
        (F.col("road_class") == "track", p.prefer_tracks),
        (F.col("is_toll"), p.prefer_tolls),
    ):
        cost = cost * F.when(holds, preference(weight)).otherwise(1.0)
    usable = F.col("access_mask").bitwiseAND(p.mode_bit) != 0
    if not p.allow_ferries:
        usable = usable & (F.col("road_class") != "ferry")
    for r in p.exclude:
        usable = usable & ~r.holds()
    if p.max_grade_permille is not None:
        usable = usable & (F.round(F.col("ascent_m") * 1000 / F.col("length_m")) <= p.max_grade_permille)
    return edges.withColumn("time_s", F.when(usable, time)).withColumn("cost", F.when(usable, cost))


CAR = Profile(
    speed_rules=(Rule({"road_class": "residential", "is_toll": "true"}, 15.0), Rule({"surface": "dirt"}, 20.0)),
    factors=(Rule({"surface": "gravel"}, 0.6), Rule({"surface": "cobble"}, 0.8), Rule({"road_class": "track"}, 0.5)),
    exclude=(Rule({"road_class": "path"}),),
    distance_weight=0.01,
    service_penalty=5.0,
    prefer_highways=0.8,
    prefer_tolls=0.2,
)

#: CAR in SQL, over the rows of the synthetic network.
CAR_SQL = """, car AS (
  SELECT e.*, CASE WHEN ok THEN length_m / (greatest(sp * fa, 0.1) / 3.6) END AS time_s,
         CASE WHEN ok THEN (length_m / (greatest(sp * fa, 0.1) / 3.6) + length_m * 0.01 + CASE WHEN road_class = 'service' THEN 5.0 ELSE 0.0 END)
           * CASE WHEN road_class IN ('motorway', 'trunk', 'primary') THEN 0.7 ELSE 1.0 END * CASE WHEN is_toll THEN 1.3 ELSE 1.0 END END AS cost
  FROM (
    SELECT e0.*, CAST(least(coalesce(max_speed_kph, 1e9), CASE WHEN road_class = 'residential' AND is_toll THEN 15.0 WHEN surface = 'dirt' THEN 20.0 ELSE
        CASE road_class WHEN 'motorway' THEN 110.0 WHEN 'trunk' THEN 90.0 WHEN 'primary' THEN 70.0 WHEN 'secondary' THEN 60.0 WHEN 'tertiary' THEN 50.0
          WHEN 'residential' THEN 30.0 WHEN 'service' THEN 20.0 WHEN 'track' THEN 15.0 WHEN 'ferry' THEN 20.0 WHEN 'path' THEN 5.0 ELSE 25.0 END END) AS DOUBLE) AS sp,
      CAST(CASE surface WHEN 'gravel' THEN 0.6 WHEN 'cobble' THEN 0.8 ELSE 1.0 END AS DOUBLE) * CAST(CASE WHEN road_class = 'track' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS fa,
      access_mask & 1 <> 0 AND road_class <> 'path' AS ok
    FROM edges e0) e
)
"""
