"""Changing between stops: candidates, rules, tables of walking times, bindings of stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins


def candidates(stops: DataFrame, most_m: float, size: float) -> DataFrame:
    """(from_stop, to_stop, distance_m) of different stops (stop, lon, lat) at most most_m apart."""
    a = stops.select(F.col("stop").alias("from_stop"), "lon", "lat")
    b = stops.select(F.col("stop").alias("to_stop"), F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))
    return joins.within(a, b, most_m, size).where("from_stop <> to_stop").select("from_stop", "to_stop", "distance_m")


def walking_table(stops: DataFrame, most_m: float, size: float, speed_mps: float, most: int = 32) -> DataFrame:
    """(from_stop, to_stop, seconds): the most nearest stops of each, at walking speed, whole seconds up."""
    near = joins.nearest(candidates(stops, most_m, size), "from_stop", "to_stop", most)
    return near.select("from_stop", "to_stop", F.ceil(F.col("distance_m") / speed_mps).cast("long").alias("seconds"))


def changes(arrivals: DataFrame, departures: DataFrame, walks: DataFrame, window_s: int) -> DataFrame:
    """Changes that walking allows: arrivals (trip, stop, arrival_s), departures (trip, stop, departure_s) within window_s of the walk's end."""
    a = arrivals.select(F.col("trip").alias("from_trip"), F.col("stop").alias("from_stop"), "arrival_s")
    ready = a.join(walks, "from_stop").withColumn("ready_s", F.col("arrival_s") + F.col("seconds"))
    b = departures.select(F.col("trip").alias("to_trip"), F.col("stop").alias("to_stop"), "departure_s")
    # the time is in the key, so that a busy stop is many keys
    ready = ready.withColumn("slot", F.explode(F.sequence(F.floor(F.col("ready_s") / window_s), F.floor((F.col("ready_s") + window_s) / window_s))))
    rows = ready.join(b.withColumn("slot", F.floor(F.col("departure_s") / window_s)), ["to_stop", "slot"])
    return rows.where("from_trip <> to_trip and departure_s between ready_s and ready_s + " + str(window_s)).select("from_trip", "from_stop", "to_trip", "to_stop", "arrival_s", "departure_s")


def judged(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """pairs of connections with verdict: allowed, refused, or ambiguous where equally specific rules meet.

    pairs: pair, from_stop, from_trip, from_route, arrival_s, to_stop, to_trip, to_route, departure_s. rules: rule,
    from_stop, to_stop, from_trip, to_trip, from_route, to_route (null: any), forbidden, least_s. A trip is more
    specific than a route, a route than a stop alone; without a rule a change is allowed.
    """
    named = rules.select(*[F.col(c).alias(f"rule_{c}") for c in rules.columns])
    rows = pairs.join(named, (F.col("from_stop") == F.col("rule_from_stop")) & (F.col("to_stop") == F.col("rule_to_stop")), "left")
    side = lambda s: F.when(F.col(f"rule_{s}_trip").isNotNull(), F.col(f"rule_{s}_trip") == F.col(f"{s}_trip")).otherwise(F.col(f"rule_{s}_route").isNull() | (F.col(f"rule_{s}_route") == F.col(f"{s}_route")))
    rank = lambda s: F.when(F.col(f"rule_{s}_trip").isNotNull(), 2).when(F.col(f"rule_{s}_route").isNotNull(), 1).otherwise(0)
    low, high = F.least(rank("from"), rank("to")), F.greatest(rank("from"), rank("to"))
    # one to six: two sides of stops, one route, two routes, one trip, a trip and a route, two trips
    specific = F.when(high == 2, 4 + low).when(high == 1, 2 + low).otherwise(1)
    held = rows.withColumn("specific", F.when(F.col("rule_rule").isNotNull() & side("from") & side("to"), specific))
    best = held.groupBy(*pairs.columns).agg(F.max("specific").alias("top"), F.collect_list(F.when(F.col("specific").isNotNull(), F.struct("specific", F.col("rule_forbidden").alias("forbidden"), F.col("rule_least_s").alias("least_s")))).alias("found"))
    first = F.filter("found", lambda x: x["specific"] == F.col("top"))
    gap = F.col("departure_s") - F.col("arrival_s")
    ok = F.col("top").isNull() | (~first[0]["forbidden"] & (gap >= first[0]["least_s"]))
    verdict = F.when(F.size(first) > 1, "ambiguous").when(ok, "allowed").otherwise("refused")
    return best.select("pair", verdict.alias("verdict"))


def bound(stops: DataFrame, bindings: DataFrame) -> DataFrame:
    """stops with what bindings (stop, and more columns) say of them; bound tells whether there was one."""
    return stops.join(bindings.withColumn("bound", F.lit(True)), "stop", "left").withColumn("bound", F.coalesce("bound", F.lit(False)))
