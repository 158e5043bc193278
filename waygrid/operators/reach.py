"""What can be reached: areas from seeds, by departure time and over sequences of departures, routes over waypoints, and outlines of areas."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, search

#: Metres of a degree of latitude (fixed value).
METRES_A_DEGREE = 111_320.0


def seeded_area(arcs: DataFrame, seeds: DataFrame, limit: float, inbound: bool = False) -> DataFrame:
    """Edge parts within limit of seeds (origin, node, cost), each with a cost of its own; towards the seeds if inbound.

    Inbound parts run from the edge's far end, so their fractions count from there.
    """
    if inbound:
        arcs = arcs.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "edge_id")
    near = seeds.where(F.col("cost") <= limit)
    return graph.seeded_spans(arcs, near, limit)


def timed_area(arcs: DataFrame, closures: DataFrame, requests: DataFrame, budget_s: float) -> DataFrame:
    """(request, node, arrival_s) within budget_s of the request's departure, closures waited out."""
    return search.earliest_arrivals(arcs, closures, requests, budget_s)


def timed_matrix(arcs: DataFrame, closures: DataFrame, requests: DataFrame, destinations: DataFrame) -> DataFrame:
    """(request, destination, duration_s): a row per pair, null where unreachable. destinations (destination, node)."""
    found = search.earliest_arrivals(arcs, closures, requests, labels=destinations.select(F.col("destination").alias("label"), "node"))
    start = requests.select("request", "departure_s")
    return found.join(F.broadcast(start), "request").select("request", F.col("label").alias("destination"), (F.col("arrival_s") - F.col("departure_s")).alias("duration_s"))


def area_sequence(arcs: DataFrame, closures: DataFrame, origins: DataFrame, start_s: int, end_s: int, step_s: int, budget_s: float) -> DataFrame:
    """(origin, departure_s, node, arrival_s): the area of each origin (origin, node) at every departure from start_s to end_s."""
    asked = origins.withColumn("at", F.explode(F.sequence(F.lit(start_s), F.lit(end_s), F.lit(step_s))))
    turns = (end_s - start_s) // step_s + 1
    asked = asked.withColumn("request", F.col("origin") * turns + ((F.col("at") - start_s) / step_s).cast("long"))
    requests = asked.select("request", "node", F.col("at").cast("double").alias("departure_s"))
    found = timed_area(arcs, closures, requests, budget_s)
    return found.join(F.broadcast(asked.select("request", "origin", F.col("at").cast("long").alias("departure_s"))), "request").select("origin", "departure_s", "node", "arrival_s")


def waypoint_legs(arcs: DataFrame, points: DataFrame) -> DataFrame:
    """(trip, leg, source, target, cost, total): least costs between consecutive waypoints (trip, seq, node), and the sum so far.

    A leg without a path has no cost, and neither has the total from there on. Equal consecutive waypoints cost nothing.
    """
    by = Window.partitionBy("trip").orderBy("seq")
    legs = points.select("trip", (F.row_number().over(by) - 1).alias("leg"), F.col("node").alias("source"), F.lead("node").over(by).alias("target")).where("target is not null")
    asked = graph.cut(legs.select("source", "target").distinct().withColumn("pair_id", F.monotonically_increasing_id()))
    rows = legs.join(asked.join(graph.pair_costs(arcs, asked), "pair_id").drop("pair_id"), ["source", "target"], "left")
    sofar = Window.partitionBy("trip").orderBy("leg")
    whole = F.max(F.col("cost").isNull()).over(sofar)
    return rows.select("trip", "leg", "source", "target", "cost", F.when(~whole, F.sum("cost").over(sofar)).alias("total"))


# --- outlines ---


def cell_degrees(size_m: float, lat: float) -> tuple[float, float]:
    """Width and height in degrees of a cell of size_m at a latitude."""
    return size_m / (METRES_A_DEGREE * max(abs(math.cos(math.radians(lat))), 0.01)), size_m / METRES_A_DEGREE


def touched_cells(lines: DataFrame, key: str, width: float, height: float) -> DataFrame:
    """(key, col, row): grid cells that lines (key, lon1, lat1, lon2, lat2) pass, by points half a cell apart or less, and the cells around those."""
    dx, dy = F.col("lon2") - F.col("lon1"), F.col("lat2") - F.col("lat1")
    n = F.ceil(F.greatest(F.abs(dx) / width, F.abs(dy) / height) * 2) + 1
    dots = lines.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    col = F.floor((F.col("lon1") + dx * F.col("i") / F.col("n")) / width)
    row = F.floor((F.col("lat1") + dy * F.col("i") / F.col("n")) / height)
    inside = dots.select(key, col.alias("col"), row.alias("row")).distinct()
    step = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])
    wide = inside.select(key, F.explode(F.transform(step, lambda d: F.col("col") + d)).alias("col"), "row").distinct()
    return wide.select(key, "col", F.explode(F.transform(step, lambda d: F.col("row") + d)).alias("row")).distinct()


def boundary(cells: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2): sides of cells (key, col, row) without a neighbour there, directed with the cell on their left."""
    sides = [(0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)]
    lits = [F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("c", "r", "x1", "y1", "x2", "y2"), s, strict=True)]) for s in sides]
    asked = cells.withColumn("s", F.explode(F.array(*lits)))
    asked = asked.select(key, (F.col("col") + F.col("s.c")).alias("col"), (F.col("row") + F.col("s.r")).alias("row"), *[(F.col(b) + F.col(f"s.{n}")).alias(n) for n, b in (("x1", "col"), ("y1", "row"), ("x2", "col"), ("y2", "row"))])
    return asked.join(cells, [key, "col", "row"], "left_anti").select(key, "x1", "y1", "x2", "y2")


def chain(sides) -> list[list[tuple[int, int]]]:
    """Closed rings of directed sides (x1, y1, x2, y2): where two meet in a corner, one turns left, so a ring keeps to its own region."""
    leaving: dict[tuple[int, int], list] = {}
    for x1, y1, x2, y2 in sorted(sides):
        leaving.setdefault((x1, y1), []).append((x2 - x1, y2 - y1))
    rings = []
    for start in sorted(leaving, key=lambda c: (len(leaving[c]) > 1, c)):
        while leaving[start]:
            at, way, ring = start, None, []
            while not ring or at != start:
                ring.append(at)
                left = way and (-way[1], way[0])
                way = left if left in leaving[at] else leaving[at][0]
                leaving[at].remove(way)
                at = at[0] + way[0], at[1] + way[1]
            rings.append(ring)
    return rings


def rings(sides: DataFrame, key: str) -> DataFrame:
    """(key, ring, area, xs, ys): each outline's rings by corner, holes with a negative area (in cells).

    One area's outline is one task: its length grows with the area's edge, not with the network.
    """
    kind = sides.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for i, ring in enumerate(chain(frame[["x1", "y1", "x2", "y2"]].itertuples(index=False, name=None))):
            after = ring[1:] + ring[:1]
            area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, after, strict=True)) / 2
            out.append((frame[key].iloc[0], i, area, [c[0] for c in ring], [c[1] for c in ring]))
        return pd.DataFrame(out, columns=[key, "ring", "area", "xs", "ys"])

    return sides.groupBy(key).applyInPandas(run, f"`{key}` {kind}, ring long, area double, xs array<long>, ys array<long>")
