"""Queries on searches with turn costs, restrictions and points on edges, and on timetables by rounds, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, rounds, transit, turns
from ..sources.synth import edges, nodes, table
from .network import NET, car
from .registry import query
from .tables import CONNS, STOPS, stop_times

#: Turns cost by the two edges' numbers, and some are forbidden.
STATES = """, pr AS (SELECT a.edge_id AS p, b.edge_id AS n, b.cost + 1.5 * CAST((a.edge_id + b.edge_id) % 3 * 4 AS DOUBLE) AS w FROM car a JOIN car b ON a.to_node = b.from_node WHERE a.cost IS NOT NULL AND b.cost IS NOT NULL AND (a.edge_id * 7 + b.edge_id) % 11 <> 0),
tree(o, n, c) USING KEY (o, n) AS (
  SELECT o, e, min(w) FROM ({starts}) GROUP BY 1, 2
  UNION
  (SELECT t.o, pr.n, min(t.c + pr.w) FROM tree t JOIN pr ON pr.p = t.n LEFT JOIN recurring.tree r ON r.o = t.o AND r.n = pr.n GROUP BY t.o, pr.n, r.c HAVING r.c IS NULL OR min(t.c + pr.w) < r.c)
)
"""


def turning(spark, sf_dir):
    a, b = F.col("prev_edge"), F.col("next_edge")
    pairs = joins.transitions(edges(spark, sf_dir)).select("prev_edge", "next_edge")
    banned = pairs.where((a * 7 + b) % 11 == 0)
    return joins.allowed(pairs, banned).withColumn("turn_s", ((a + b) % 3 * 4).cast("double"))


@query(
    NET + STATES.format(starts="SELECT from_node AS o, edge_id AS e, cost AS w FROM car WHERE cost IS NOT NULL AND from_node % 200 = 0")
    + "SELECT a.node_id AS origin, b.node_id AS destination, round(CASE WHEN a.node_id = b.node_id THEN 0 ELSE min(c) END, 5) AS cost FROM nodes a JOIN nodes b ON a.node_id % 200 = 0 AND b.node_id % 50 = 0 LEFT JOIN (SELECT o, to_node, c FROM tree JOIN car ON edge_id = n) ON o = a.node_id AND to_node = b.node_id GROUP BY 1, 2"
)
def net188_turn_matrix(spark, sf_dir):
    n = nodes(spark, sf_dir)
    pick = lambda every, name: n.where(F.col("node_id") % every == 0).select(F.col("node_id").alias(name), F.col("node_id").alias("node"))
    out = turns.node_matrix(car(spark, sf_dir), turning(spark, sf_dir), pick(200, "origin"), pick(50, "destination"), 1.5)
    return out.withColumn("cost", F.round("cost", 5))


@query(
    NET + STATES.format(starts="SELECT edge_id AS o, edge_id AS e, cost * (1 - edge_id % 7 / 7.0) AS w FROM car WHERE cost IS NOT NULL AND edge_id % 500 = 0")
    + """, d AS (SELECT edge_id AS d, edge_id AS e, cost, edge_id % 6 / 6.0 AS f FROM car WHERE cost IS NOT NULL AND edge_id % 250 = 0),
    x AS (SELECT o, d, min(c + w) - min(d.cost * (1 - f)) AS c FROM tree JOIN pr ON pr.p = tree.n JOIN d ON d.e = pr.n GROUP BY 1, 2 UNION ALL SELECT d, d, cost * (f - d % 7 / 7.0) FROM d WHERE d % 500 = 0 AND f >= d % 7 / 7.0)
    SELECT o AS origin, d AS destination, round(min(c), 5) AS cost FROM x GROUP BY 1, 2"""
)
def net190_point_costs(spark, sf_dir):
    k = F.col("edge_id")
    e = car(spark, sf_dir)
    origins = e.where("edge_id % 500 = 0").select(k.alias("origin"), "edge_id", (k % 7 / 7.0).alias("fraction"))
    destinations = e.where("edge_id % 250 = 0").select(k.alias("destination"), "edge_id", (k % 6 / 6.0).alias("fraction"))
    return turns.point_costs(e, turning(spark, sf_dir), origins, destinations, 1.5).withColumn("cost", F.round("cost", 5))


# --- timetables by rounds ---

WALKS = "SELECT s_suppkey AS from_stop, (s_suppkey * 3 + 1) % (SELECT count(*) FROM supplier) AS to_stop, 60 + s_suppkey % 240 AS seconds FROM supplier"


def rounds_sql(conns: str, walks: str, requests: str, boardings: int, slack: int, wait: int) -> str:
    """The rounds one after another."""
    parts = [f"c AS ({conns})", f"w AS ({walks})", f"q AS ({requests})"]
    walked = "SELECT request, stop, min(arrival) AS arrival FROM (SELECT request, stop, arrival FROM {0} UNION ALL SELECT request, to_stop, arrival + seconds FROM {0} JOIN w ON stop = from_stop) GROUP BY 1, 2"
    parts.append("r0 AS (" + walked.format("q") + ")")
    for i in range(boardings):
        parts.append(f"b{i} AS (SELECT request, trip, min(seq) AS first FROM r{i} JOIN c ON stop = from_stop AND departure BETWEEN r{i}.arrival + {slack} AND r{i}.arrival + {slack + wait} GROUP BY 1, 2)")
        parts.append(f"d{i} AS (SELECT request, to_stop AS stop, min(arrival) AS arrival FROM b{i} JOIN c ON c.trip = b{i}.trip AND seq >= first GROUP BY 1, 2)")
        parts.append(f"k{i} AS ({walked.format(f'd{i}')})")
        parts.append(f"r{i + 1} AS (SELECT request, stop, min(arrival) AS arrival FROM (SELECT * FROM r{i} UNION ALL SELECT * FROM k{i}) GROUP BY 1, 2)")
    return ", ".join(parts)


def timetable(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    k = F.col("s_suppkey")
    walks = s.join(n).select(k.alias("from_stop"), ((k * 3 + 1) % F.col("n")).alias("to_stop"), (60 + k % 240).alias("seconds"))
    asked = s.select(k.alias("request"), k.alias("stop"), (9000 + k * 31 % 3000).alias("departure"), (14000 + k * 31 % 3000).alias("arrive"))
    return transit.connections(stop_times(spark, sf_dir)).where("to_stop is not null"), walks, asked


@query(
    f"WITH {STOPS}, {CONNS}, "
    + rounds_sql("SELECT trip, seq, from_stop, to_stop, departure, arrival FROM cn WHERE to_stop IS NOT NULL", WALKS, "SELECT s_suppkey AS request, s_suppkey AS stop, 9000 + s_suppkey * 31 % 3000 AS arrival FROM supplier", 2, 30, 900)
    + " SELECT request, stop, arrival FROM r2"
)
def net230_rounds(spark, sf_dir):
    conns, walks, asked = timetable(spark, sf_dir)
    return rounds.earliest(conns, walks, asked, 2, 30, 900)


@query(
    f"WITH {STOPS}, {CONNS}, "
    + rounds_sql("SELECT trip, -seq AS seq, to_stop AS from_stop, from_stop AS to_stop, -arrival AS departure, -departure AS arrival FROM cn WHERE to_stop IS NOT NULL", f"SELECT to_stop AS from_stop, from_stop AS to_stop, seconds FROM ({WALKS})", "SELECT s_suppkey AS request, s_suppkey AS stop, -(14000 + s_suppkey * 31 % 3000) AS arrival FROM supplier", 2, 30, 900)
    + " SELECT request, stop, -arrival AS departure FROM r2"
)
def net231_arrive_by(spark, sf_dir):
    conns, walks, asked = timetable(spark, sf_dir)
    return rounds.latest(conns, walks, asked, 2, 30, 900)
