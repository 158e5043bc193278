"""Joins of network tables: transitions, restrictions, snapping, intervals, vehicles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def transitions(edges: DataFrame, u_turns: bool = True) -> DataFrame:
    """(prev_edge, next_edge, via_node) of all pairs of edges that meet."""
    a = edges.select(F.col("edge_id").alias("prev_edge"), F.col("from_node").alias("prev_from"), F.col("to_node").alias("via_node"))
    b = edges.select(F.col("edge_id").alias("next_edge"), F.col("from_node").alias("via_node"), F.col("to_node").alias("next_to"))
    rows = a.join(b, "via_node")
    return (rows if u_turns else rows.where("prev_from <> next_to")).select("prev_edge", "next_edge", "via_node")


def allowed(pairs: DataFrame, banned: DataFrame) -> DataFrame:
    """Transitions without those that two-edge restrictions (prev_edge, next_edge) forbid."""
    return pairs.join(banned.select("prev_edge", "next_edge"), ["prev_edge", "next_edge"], "left_anti")


def resolve_restrictions(restrictions: DataFrame, pairs: DataFrame) -> DataFrame:
    """Forbidden transitions: 'no' ones as they are; 'only' ones forbid every other continuation."""
    no = restrictions.where("kind = 'no'").select("prev_edge", "next_edge")
    only = restrictions.where("kind = 'only'").select("prev_edge", F.col("next_edge").alias("kept"))
    other = pairs.join(only, "prev_edge").where("next_edge <> kept").select("prev_edge", "next_edge")
    return no.unionByName(other).distinct()


def with_cells(rows: DataFrame, lon: str, lat: str, size: float) -> DataFrame:
    return rows.withColumn("cell_x", F.floor(F.col(lon) / size)).withColumn("cell_y", F.floor(F.col(lat) / size))


def within(points: DataFrame, targets: DataFrame, radius_m: float, size: float) -> DataFrame:
    """Range join of points (lon, lat) and targets (t_lon, t_lat): pairs at most radius_m apart, with distance_m.

    Targets are put into the grid cells that their radius can reach, so each pair meets in
    the point's cell only and once. size (degrees) must be at least the radius in latitude.
    """
    a = with_cells(points, "lon", "lat", size)
    # a degree of longitude shrinks with the cosine of the latitude
    reach_x = F.ceil(F.lit(radius_m) / (F.cos(F.radians("t_lat")) * (geo.RADIUS * 3.141592653589793 / 180) * size))
    reach_y = F.lit(int(-(-radius_m // (geo.RADIUS * 3.141592653589793 / 180 * size))))
    b = targets.withColumn("dx", F.explode(F.sequence(-reach_x, reach_x))).withColumn("dy", F.explode(F.sequence(-reach_y, reach_y)))
    b = b.withColumn("cell_x", F.floor(F.col("t_lon") / size) + F.col("dx")).withColumn("cell_y", F.floor(F.col("t_lat") / size) + F.col("dy")).drop("dx", "dy")
    rows = a.join(b, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
    rows = rows.withColumn("distance_m", geo.haversine(F.col("lon"), F.col("lat"), F.col("t_lon"), F.col("t_lat")))
    return rows.where(F.col("distance_m") <= radius_m)


def near_segments(points: DataFrame, segments: DataFrame, radius_m: float, size: float) -> DataFrame:
    """Pairs of points (lon, lat) and straight segments (from_lon, from_lat, to_lon, to_lat) at most radius_m apart, with distance_m.

    A segment, however long, goes to the cells along its course: to each column of the grid that its radius
    reaches, and there to the rows between the heights that the segment has within the radius of the column.
    """
    c = F.col
    pad_y = F.lit(radius_m / (geo.RADIUS * 3.141592653589793 / 180) + 1e-9)
    highest = F.greatest(F.abs(c("from_lat")), F.abs(c("to_lat"))) + pad_y
    b = segments.withColumn("pad_x", pad_y / F.greatest(F.cos(F.radians(F.least(highest, F.lit(90.0)))), F.lit(1e-3)))
    west, east = F.least("from_lon", "to_lon"), F.greatest("from_lon", "to_lon")
    b = b.withColumn("cell_x", F.explode(F.sequence(F.floor((west - c("pad_x")) / size), F.floor((east + c("pad_x")) / size))))
    # the part of the segment between two meridians; a segment along one is whole
    along = lambda lon: (lon - c("from_lon")) / F.nullif(c("to_lon") - c("from_lon"), F.lit(0.0))
    low, high = F.greatest(c("cell_x") * size - c("pad_x"), west), F.least((c("cell_x") + 1) * size + c("pad_x"), east)
    lat = lambda lon, other: F.coalesce(c("from_lat") + (c("to_lat") - c("from_lat")) * along(lon), c(other))
    one, two = lat(low, "from_lat"), lat(high, "to_lat")
    south, north = F.floor((F.least(one, two) - pad_y) / size), F.floor((F.greatest(one, two) + pad_y) / size)
    b = b.withColumn("cell_y", F.explode(F.sequence(south, north))).drop("pad_x")
    rows = with_cells(points, "lon", "lat", size).join(b, ["cell_x", "cell_y"]).drop("cell_x", "cell_y")
    _, metres = geo.along_segment(F.lit(0.0), F.lit(0.0), *geo.planar(c("lon"), c("lat"), c("from_lon"), c("from_lat")), *geo.planar(c("lon"), c("lat"), c("to_lon"), c("to_lat")))
    return rows.withColumn("distance_m", metres).where(F.col("distance_m") <= radius_m)


def thinned(targets: DataFrame, by: list[str], ties: str, k: int) -> DataFrame:
    """targets (t_lon, t_lat) without those that k others of their place (and of equal columns by) precede in ties: none of them is among the k nearest of any point."""
    place = Window.partitionBy("t_lon", "t_lat", *by).orderBy(ties)
    return targets.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= k).drop("__n")


def nearest(pairs: DataFrame, key: str, ties: str, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("distance_m", ties))).where(F.col("rank") <= k)


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before it, by key: one union and one window, no pairs."""
    a = left.withColumn("__side", F.lit(1)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, ts, value).withColumn("__side", F.lit(0))
    by = Window.partitionBy(key).orderBy(ts, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = a.unionByName(b, allowMissingColumns=True)
    return rows.withColumn(value, F.last(F.when(F.col("__side") == 0, F.col(value)), ignorenulls=True).over(by)).where("__side = 1").drop("__side")


def next_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """left with the value of the first row of right at or after it."""
    a = left.withColumn("__side", F.lit(0)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    b = right.select(key, ts, value).withColumn("__side", F.lit(1))
    by = Window.partitionBy(key).orderBy(ts, "__side").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = a.unionByName(b, allowMissingColumns=True)
    return rows.withColumn(value, F.first(F.when(F.col("__side") == 1, F.col(value)), ignorenulls=True).over(by)).where("__side = 0").drop("__side")


def in_interval(left: DataFrame, right: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Interval join on key with start <= at < end, by buckets of width that intervals are put into."""
    b = right.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    a = left.withColumn("__bucket", F.floor(F.col(at) / width))
    return a.join(b, [key, "__bucket"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__bucket")


def vehicle_excluded(restrictions: DataFrame, vehicle: dict[str, float]) -> DataFrame:
    """Edges that a vehicle can't use: (edge_id) with a limit (kind, maximum) below the vehicle's value."""
    sizes = F.create_map(*[x for k, v in vehicle.items() for x in (F.lit(k), F.lit(float(v)))])
    return restrictions.where(sizes[F.col("kind")] > F.col("maximum")).select("edge_id").distinct()


def avoid(edges: DataFrame, avoided: DataFrame, cost: str) -> DataFrame:
    """Edges without those avoided with no penalty_factor; others of avoided cost penalty_factor times as much."""
    worst = avoided.groupBy("edge_id").agg(F.max(F.when(F.col("penalty_factor").isNull(), 1).otherwise(0)).alias("out"), F.max("penalty_factor").alias("penalty"))
    rows = edges.join(worst, "edge_id", "left").where("out is null or out = 0")
    return rows.withColumn(cost, F.col(cost) * F.coalesce("penalty", F.lit(1.0))).drop("out", "penalty")


def turn_cost(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, left_s: float, right_s: float, u_turn_s: float, signal_s: float) -> DataFrame:
    """pairs with turn class and seconds: signal of the previous edge, U-turn, then left and right by angle; none within one way."""
    shape = edges.select("edge_id", "from_node", "to_node", "way_id", "signal").join(nodes.select(F.col("node_id").alias("from_node"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1")), "from_node")
    shape = shape.join(nodes.select(F.col("node_id").alias("to_node"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2")), "to_node")
    shape = shape.select("edge_id", "from_node", "to_node", "way_id", "signal", geo.heading(F.col("lon1"), F.col("lat1"), F.col("lon2"), F.col("lat2")).alias("heading"))
    a, b = (shape.select(*[F.col(c).alias(f"{side}_{c}") for c in shape.columns]) for side in ("prev", "next"))
    rows = pairs.join(a, F.col("prev_edge") == F.col("prev_edge_id")).join(b, F.col("next_edge") == F.col("next_edge_id"))
    back = F.col("prev_from_node") == F.col("next_to_node")
    turn = geo.turn_class(geo.turn_angle(F.col("prev_heading"), F.col("next_heading")))
    turn = F.when(back, "u_turn").when(F.col("prev_way_id") == F.col("next_way_id"), "straight").otherwise(turn)
    seconds: Column = F.when(turn == "left", left_s).when(turn == "right", right_s).when(turn == "u_turn", u_turn_s).otherwise(0.0) + F.when(F.col("prev_signal"), signal_s).otherwise(0.0)
    return rows.select("prev_edge", "next_edge", "via_node", turn.alias("turn"), seconds.alias("turn_s"))
