"""Summaries of routes, legs, imports, dispatch and simulations, guards on sizes, and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def route_summary(steps: DataFrame, key: str) -> DataFrame:
    """Of paths of edges (seq, length_m, time_s, cost; from_fraction and to_fraction say what of an edge is used): totals and edges."""
    used = F.col("to_fraction") - F.col("from_fraction")
    return steps.groupBy(key).agg(*[F.sum(F.col(c) * used).alias(c) for c in ("length_m", "time_s", "cost")], F.count(F.lit(1)).alias("n_edges"))


def leg_summary(legs: DataFrame, key: str, order: str, departure: str) -> DataFrame:
    """Waiting, access and egress, transfer, indoor and riding seconds of journeys and their boardings.

    legs: leg_type, departure_s, arrival_s by order; departure is the column of the journey's own start.
    """
    before = F.coalesce(F.lag("arrival_s").over(Window.partitionBy(key).orderBy(order)), F.col(departure))
    rows = legs.withColumn("wait", F.greatest(F.col("departure_s") - before, F.lit(0))).withColumn("took", F.greatest(F.col("arrival_s") - F.col("departure_s"), F.lit(0)))
    of = lambda *kinds: F.sum(F.when(F.col("leg_type").isin(*kinds), F.col("took")).otherwise(0))
    return rows.groupBy(key).agg(
        F.greatest(F.max_by("arrival_s", order) - F.min(departure), F.lit(0)).alias("total_s"),
        F.sum("wait").alias("wait_s"),
        of("access", "egress").alias("access_egress_s"),
        of("indoor").alias("indoor_s"),
        of("transfer").alias("transfer_s"),
        of("transit").alias("transit_s"),
        F.sum((F.col("leg_type") == "transit").cast("long")).alias("boardings"),
    )


def meet_minimums(legs: DataFrame, key: str, least_s: float, least_m: float) -> DataFrame:
    """The legs of journeys of which every ride is long enough, in time and distance."""
    short = (F.col("leg_type") == "transit") & ((F.col("arrival_s") - F.col("departure_s") < least_s) | (F.col("distance_m") < least_m))
    return legs.join(legs.where(short).select(key).distinct(), key, "left_anti")


def import_summary(stop_times: DataFrame) -> DataFrame:
    """One row: stops, routes, trips, stop times and connections of a timetable (trip, route, stop)."""
    return stop_times.agg(
        F.countDistinct("stop").alias("stops"), F.countDistinct("route").alias("routes"), F.countDistinct("trip").alias("trips"), F.count(F.lit(1)).alias("stop_times"), (F.count(F.lit(1)) - F.countDistinct("trip")).alias("connections")
    )


def dispatch_summary(assigned: DataFrame, key: str) -> DataFrame:
    """By key: requests, how many were assigned (vehicle not null), mean and greatest pickup time, fares."""
    has = F.col("vehicle").isNotNull()
    return assigned.groupBy(key).agg(
        F.count(F.lit(1)).alias("requests"), F.sum(has.cast("long")).alias("assigned"), F.avg(F.when(has, F.col("pickup_s"))).alias("mean_pickup_s"), F.max(F.when(has, F.col("pickup_s"))).alias("max_pickup_s"), F.sum(F.when(has, F.col("fare")).otherwise(0.0)).alias("fares")
    )


def simulation_summary(agents: DataFrame, keys: list[str]) -> DataFrame:
    """By fleet or vehicle type: agents, arrivals, mean travel time, distance, and delay against free flow."""
    there = F.col("arrive_s").isNotNull()
    took = F.when(there, F.col("arrive_s") - F.col("depart_s"))
    return agents.groupBy(*keys).agg(F.count(F.lit(1)).alias("agents"), F.sum(there.cast("long")).alias("arrived"), F.avg(took).alias("mean_travel_s"), F.sum("distance_m").alias("distance_m"), F.avg(took - F.col("free_s")).alias("mean_delay_s"))


def weighted(layer: DataFrame, column: str) -> DataFrame:
    """(cell, weight) of the cells that have a value in column."""
    return layer.where(F.col(column).isNotNull()).select("cell", F.col(column).cast("double").alias("weight"))


def capped(rows: DataFrame, most: int, what: str) -> DataFrame:
    """rows, or an error where there are more than most: results are refused, never shortened."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return rows


def guarded_matrix(origins: DataFrame, destinations: DataFrame, most: int = 4_000_000) -> int:
    """The cells of a matrix, or an error where they are more than most."""
    n = origins.count() * destinations.count()
    if n > most:
        raise ValueError(f"{n} cells, more than {most}")
    return n


def in_time(frames: DataFrame, at: str, start: float, end: float) -> DataFrame:
    return frames.where(F.col(at).between(start, end))


def settled_in_order(reached: DataFrame, key: str, cost: str, edge: str, most: int | None = None) -> DataFrame:
    """Reached edges numbered as a search settles them: by cost, ties by edge; with a flag where most cuts the list."""
    rows = reached.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(cost, edge)))
    if most is None:
        return rows.withColumn("truncated", F.lit(False))
    whole = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("truncated", whole > most).where(F.col("step") <= most)
