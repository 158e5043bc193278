"""Queries on the synthetic street network: profiles, joins, searches, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import graph, intervals, joins, profile, relate
from ..operators.profile import CAR, CAR_SQL, compile_profile
from ..sources.synth import PRELUDE, edges, nodes
from .registry import query

NET = PRELUDE + CAR_SQL
HAVERSINE = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
r6 = lambda c, name: F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def car(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_profile(edges(spark, sf_dir), CAR)


def arcs(spark: SparkSession, sf_dir: str, weight: str = "cost") -> DataFrame:
    return car(spark, sf_dir).select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.col(weight).alias("w"), "edge_id")


def starts(spark: SparkSession, sf_dir: str, every: int, name: str = "origin") -> DataFrame:
    return nodes(spark, sf_dir).where(F.col("node_id") % every == 0).select(F.col("node_id").alias(name), F.col("node_id").alias("node"))


#: Label correction that keeps one row a node: (o, n, c) from every node divisible by {every}.
TREE = """, arc AS (SELECT from_node AS u, to_node AS v, min({w}) AS w FROM car WHERE cost IS NOT NULL GROUP BY 1, 2),
tree(o, n, c) USING KEY (o, n) AS (
  SELECT node_id, node_id, CAST(0 AS DOUBLE) FROM nodes WHERE node_id % {every} = 0
  UNION
  (SELECT t.o, arc.v, min(t.c + arc.w) FROM tree t JOIN arc ON arc.u = t.n LEFT JOIN recurring.tree r ON r.o = t.o AND r.n = arc.v
   GROUP BY t.o, arc.v, r.c HAVING (r.c IS NULL OR min(t.c + arc.w) < r.c) AND min(t.c + arc.w) <= {limit})
)
"""


def tree_sql(every: int, limit: float = 1e18, w: str = "cost") -> str:
    return NET + TREE.format(every=every, limit=limit, w=w)


@query(NET + "SELECT edge_id, round(time_s, 6) AS time_s, round(cost, 6) AS cost FROM car")
def net076_profile_compile(spark, sf_dir):
    return car(spark, sf_dir).select("edge_id", r6("time_s", "time_s"), r6("cost", "cost"))


@query(NET + "SELECT road_class, count(*) AS n_edges, CAST(sum(length_m) AS BIGINT) AS length_m, round(sum(time_s), 4) AS time_s, count(cost) AS n_usable FROM car GROUP BY road_class")
def net088_breakdown_by_class(spark, sf_dir):
    return car(spark, sf_dir).groupBy("road_class").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length_m").alias("length_m"), F.round(F.sum("time_s"), 4).alias("time_s"), F.count("cost").alias("n_usable"))


@query(NET + "SELECT edge_id FROM edges WHERE access_mask & 2 <> 0 AND ascent_m * 1000 / length_m <= 100.4999")
def net074_max_grade_filter(spark, sf_dir):
    p = profile.Profile(mode_bit=2, motorised=False, max_grade_permille=100)
    return compile_profile(edges(spark, sf_dir), p).where("cost is not null").select("edge_id")


@query(PRELUDE + "SELECT a.edge_id AS prev_edge, b.edge_id AS next_edge, a.to_node AS via_node FROM edges a JOIN edges b ON a.to_node = b.from_node")
def net089_transitions(spark, sf_dir):
    return joins.transitions(edges(spark, sf_dir))


RESTRICTIONS = "SELECT edge_id AS prev_edge, (edge_id // 3 + 1) % n * 3 AS next_edge, CASE WHEN edge_id % 2 = 0 THEN 'no' ELSE 'only' END AS kind FROM edges, pn WHERE edge_id % 3 = 0 AND edge_id % 5 = 0"


def restrictions(spark, sf_dir):
    e = edges(spark, sf_dir)
    n = nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    rows = e.where("edge_id % 3 = 0 and edge_id % 5 = 0").join(F.broadcast(n))
    return rows.select(F.col("edge_id").alias("prev_edge"), (F.expr("(edge_id div 3 + 1) % n * 3")).alias("next_edge"), F.when(F.col("edge_id") % 2 == 0, "no").otherwise("only").alias("kind"))


@query(
    PRELUDE
    + f""", r AS ({RESTRICTIONS}), tr AS (SELECT a.edge_id AS prev_edge, b.edge_id AS next_edge, a.to_node AS via_node FROM edges a JOIN edges b ON a.to_node = b.from_node),
    bad AS (SELECT prev_edge, next_edge FROM r WHERE kind = 'no' UNION SELECT t.prev_edge, t.next_edge FROM tr t JOIN r ON r.kind = 'only' AND r.prev_edge = t.prev_edge AND r.next_edge <> t.next_edge)
    SELECT prev_edge, next_edge FROM bad"""
)
def net092_resolve_restrictions(spark, sf_dir):
    return joins.resolve_restrictions(restrictions(spark, sf_dir), joins.transitions(edges(spark, sf_dir)))


@query(
    PRELUDE
    + f""", r AS ({RESTRICTIONS}), tr AS (SELECT a.edge_id AS prev_edge, b.edge_id AS next_edge, a.to_node AS via_node FROM edges a JOIN edges b ON a.to_node = b.from_node)
    SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM r WHERE kind = 'no' AND r.prev_edge = tr.prev_edge AND r.next_edge = tr.next_edge)
      AND NOT EXISTS (SELECT 1 FROM r WHERE kind = 'only' AND r.prev_edge = tr.prev_edge AND r.next_edge <> tr.next_edge)"""
)
def net093_restriction_anti_join(spark, sf_dir):
    pairs = joins.transitions(edges(spark, sf_dir))
    return joins.allowed(pairs, joins.resolve_restrictions(restrictions(spark, sf_dir), pairs))


HEADING = "((degrees(atan2(radians({b}.lon - {a}.lon) * cos(radians({a}.lat)) * 6371000.0, radians({b}.lat - {a}.lat) * 6371000.0)) % 360.0) + 360.0) % 360.0"


@query(
    PRELUDE
    + f""", sh AS (SELECT e.*, {HEADING.format(a="p", b="q")} AS h FROM edges e JOIN nodes p ON p.node_id = e.from_node JOIN nodes q ON q.node_id = e.to_node),
    t AS (SELECT a.edge_id AS prev_edge, b.edge_id AS next_edge, a.from_node = b.to_node AS back, a.way_id = b.way_id AS same, a.signal AS sig,
           180.0 - ((b.h - a.h + 180.0) % 360.0 + 360.0) % 360.0 AS ang FROM sh a JOIN sh b ON a.to_node = b.from_node),
    c AS (SELECT *, CASE WHEN back THEN 'u_turn' WHEN same THEN 'straight' WHEN abs(ang) <= 30 THEN 'straight' WHEN abs(ang) >= 150 THEN 'u_turn' WHEN ang > 0 THEN 'left' ELSE 'right' END AS turn FROM t)
    SELECT turn, count(*) AS n, round(sum(CASE turn WHEN 'left' THEN 8e0 WHEN 'right' THEN 3e0 WHEN 'u_turn' THEN 20e0 ELSE 0e0 END + CASE WHEN sig THEN 6e0 ELSE 0e0 END), 3) AS turn_s FROM c GROUP BY turn"""
)
def net090_turn_cost(spark, sf_dir):
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir)
    return joins.turn_cost(joins.transitions(e), e, n, 8.0, 3.0, 20.0, 6.0).groupBy("turn").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("turn_s"), 3).alias("turn_s"))


POINTS = "SELECT s_suppkey AS point_id, CAST(6.0 AS DOUBLE) + CAST(s_suppkey * 377 % 10000 AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS lon, CAST(53.0 AS DOUBLE) + CAST(s_suppkey * 911 % 10000 AS DOUBLE) / CAST(10000.0 AS DOUBLE) AS lat FROM supplier"


def points(spark, sf_dir):
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("point_id"), (F.lit(6.0) + (k * 377 % 10000) / F.lit(10000.0)).alias("lon"), (F.lit(53.0) + (k * 911 % 10000) / F.lit(10000.0)).alias("lat"))


def targets(spark, sf_dir):
    return nodes(spark, sf_dir).select("node_id", F.col("lon").alias("t_lon"), F.col("lat").alias("t_lat"))


NEAR = PRELUDE + f""", p AS ({POINTS}), d AS (SELECT point_id, node_id, {HAVERSINE.format(lat1="p.lat", lat2="nodes.lat", lon1="p.lon", lon2="nodes.lon")} AS m FROM p, nodes)
"""


@query(NEAR + "SELECT point_id, node_id, round(m, 4) AS distance_m FROM d WHERE m <= 5000")
def net114_nearby_stops(spark, sf_dir):
    return joins.within(points(spark, sf_dir), targets(spark, sf_dir), 5000.0, 0.05).select("point_id", "node_id", F.round("distance_m", 4).alias("distance_m"))


@query(NEAR + "SELECT point_id, node_id, CAST(rk AS INTEGER) AS \"rank\", round(m, 4) AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, node_id) AS rk FROM d WHERE m <= 8000) WHERE rk <= 8")
def net098_node_snap(spark, sf_dir):
    few = joins.thinned(targets(spark, sf_dir), [], "node_id", 8)
    snap = lambda x: joins.nearest(joins.within(x, few, 8000.0, 0.08), "point_id", "node_id", 8).select("point_id", "node_id", "rank", F.round("distance_m", 4).alias("distance_m"))
    return relate.once_per_place(points(spark, sf_dir), snap, "point_id")


@query(
    PRELUDE
    + f""", p AS ({POINTS}), seg AS (SELECT e.edge_id, a.lon AS alon, a.lat AS alat, b.lon AS blon, b.lat AS blat FROM edges e JOIN nodes a ON a.node_id = e.from_node JOIN nodes b ON b.node_id = e.to_node),
    x AS (SELECT point_id, edge_id, radians(alon - lon) * cos(radians(lat)) * 6371000.0 AS ax, radians(alat - lat) * 6371000.0 AS ay, radians(blon - lon) * cos(radians(lat)) * 6371000.0 AS bx, radians(blat - lat) * 6371000.0 AS byy FROM p, seg),
    f AS (SELECT *, greatest(0.0, least(1.0, coalesce((-ax * (bx - ax) - ay * (byy - ay)) / nullif((bx - ax) * (bx - ax) + (byy - ay) * (byy - ay), 0), 0))) AS t FROM x),
    g AS (SELECT *, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (byy - ay), 2)) AS m FROM f)
    SELECT point_id, round(min(m), 3) AS distance_m, count(*) AS n_near FROM g WHERE m <= 2000 GROUP BY point_id"""
)
def net099_edge_snap(spark, sf_dir):
    """Edges of one course meet each place of points once, as one segment with their number."""
    n = nodes(spark, sf_dir)
    end = lambda s: n.select(F.col("node_id").alias(f"{s}_node"), F.col("lon").alias(f"{s}_lon"), F.col("lat").alias(f"{s}_lat"))
    course = ["from_lon", "from_lat", "to_lon", "to_lat"]
    seg = edges(spark, sf_dir).join(end("from"), "from_node").join(end("to"), "to_node").groupBy(*course).agg(F.count(F.lit(1)).alias("n"))
    near = lambda x: joins.near_segments(x, seg, 2000.0, 0.05).groupBy("point_id").agg(F.round(F.min("distance_m"), 3).alias("distance_m"), F.sum("n").alias("n_near"))
    return relate.once_per_place(points(spark, sf_dir), near, "point_id")


@query(tree_sql(500) + "SELECT o AS origin, n AS node, round(c, 5) AS cost FROM tree")
def net186_single_source_trees(spark, sf_dir):
    return graph.trees(arcs(spark, sf_dir), starts(spark, sf_dir, 500)).select("origin", "node", F.round("cost", 5).alias("cost"))


@query(tree_sql(1000, 400.0) + "SELECT o AS origin, n AS node, round(c, 5) AS cost FROM tree")
def net180_frontier_relaxation(spark, sf_dir):
    seeds = starts(spark, sf_dir, 1000).withColumn("cost", F.lit(0.0))
    return graph.relax(arcs(spark, sf_dir), seeds, 400.0).select("origin", "node", F.round("cost", 5).alias("cost"))


@query(tree_sql(100) + "SELECT a.node_id AS origin, b.node_id AS destination, round(c, 5) AS cost FROM nodes a JOIN nodes b ON a.node_id % 100 = 0 AND b.node_id % 50 = 7 LEFT JOIN tree ON o = a.node_id AND n = b.node_id")
def net188_matrix(spark, sf_dir):
    to = nodes(spark, sf_dir).where("node_id % 50 = 7").select(F.col("node_id").alias("destination"), F.col("node_id").alias("node"))
    return graph.matrix(arcs(spark, sf_dir), starts(spark, sf_dir, 100), to).withColumn("cost", F.round("cost", 5))


SPANS = """, sp AS (SELECT o AS origin, edge_id, c AS start_cost, least(c + car.cost, 300.0) AS end_cost, CASE WHEN c + car.cost > 300 THEN (300 - c) / car.cost ELSE 1.0 END AS end_fraction, length_m
  FROM tree JOIN car ON car.from_node = n WHERE car.cost IS NOT NULL AND c < 300)
"""


@query(tree_sql(500, 300.0) + SPANS + "SELECT origin, edge_id, round(end_fraction, 6) AS end_fraction, round(start_cost, 5) AS start_cost, round(end_cost, 5) AS end_cost FROM sp")
def net193_service_area(spark, sf_dir):
    a = arcs(spark, sf_dir)
    found = graph.spans(a, graph.trees(a, starts(spark, sf_dir, 500), 300.0), 300.0)
    return found.select("origin", "edge_id", F.round("end_fraction", 6).alias("end_fraction"), F.round("start_cost", 5).alias("start_cost"), F.round("end_cost", 5).alias("end_cost"))


@query(tree_sql(500, 300.0) + SPANS + "SELECT origin, count(DISTINCT edge_id) AS n_edges, round(sum(length_m * end_fraction), 3) AS reachable_m FROM sp GROUP BY origin")
def net131_service_area_summary(spark, sf_dir):
    a = arcs(spark, sf_dir)
    found = graph.spans(a, graph.trees(a, starts(spark, sf_dir, 500), 300.0), 300.0).join(edges(spark, sf_dir).select("edge_id", "length_m"), "edge_id")
    return found.groupBy("origin").agg(F.countDistinct("edge_id").alias("n_edges"), F.round(F.sum(F.col("length_m") * F.col("end_fraction")), 3).alias("reachable_m"))


@query(
    tree_sql(500, 300.0)
    + SPANS
    + """, mid AS (SELECT *, (start_cost + end_cost) / 2 AS m, min((start_cost + end_cost) / 2) OVER (PARTITION BY edge_id) AS least FROM sp),
    win AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY origin) AS rk FROM mid WHERE m <= least + 1e-9)
    SELECT edge_id, origin, round(end_fraction, 6) AS end_fraction FROM win WHERE rk = 1"""
)
def net150_cut_by_best_origin(spark, sf_dir):
    a = arcs(spark, sf_dir)
    found = graph.spans(a, graph.trees(a, starts(spark, sf_dir, 500), 300.0), 300.0).withColumn("midpoint", (F.col("start_cost") + F.col("end_cost")) / 2)
    return intervals.best_origin(found, ["edge_id"], "midpoint", "origin").select("edge_id", "origin", F.round("end_fraction", 6).alias("end_fraction"))


@query(
    tree_sql(500, 300.0)
    + """, th AS (SELECT unnest([100.0, 200.0, 300.0]) AS threshold),
    b AS (SELECT o AS origin, edge_id, threshold, CASE WHEN c + car.cost > threshold THEN (threshold - c) / car.cost ELSE 1.0 END AS e FROM tree JOIN car ON car.from_node = n JOIN th ON c < threshold WHERE car.cost IS NOT NULL),
    r AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY origin, edge_id ORDER BY threshold), 0.0) AS s FROM b)
    SELECT origin, edge_id, CAST(threshold AS DOUBLE) AS threshold, round(s, 6) AS start_fraction, round(e, 6) AS end_fraction FROM r WHERE s < e"""
)
def net168_ring_bands(spark, sf_dir):
    a = arcs(spark, sf_dir)
    reached = graph.trees(a, starts(spark, sf_dir, 500), 300.0)
    bands = None
    for t in (100.0, 200.0, 300.0):
        one = graph.spans(a, reached, t).withColumn("threshold", F.lit(t))
        bands = one if bands is None else bands.unionByName(one)
    rings = intervals.difference(bands, ["origin", "edge_id"], "threshold", "start_fraction", "end_fraction")
    return rings.select("origin", "edge_id", "threshold", F.round("start_fraction", 6).alias("start_fraction"), F.round("end_fraction", 6).alias("end_fraction"))


@query(
    tree_sql(250)
    + """SELECT o AS origin, node_id % 5 AS category, count(CASE WHEN c <= 200 THEN 1 END) AS within_200, count(CASE WHEN c <= 400 THEN 1 END) AS within_400, round(min(c), 5) AS nearest
    FROM tree JOIN nodes ON node_id = n AND node_id % 10 = 3 GROUP BY 1, 2"""
)
def net129_accessibility(spark, sf_dir):
    reached = graph.trees(arcs(spark, sf_dir), starts(spark, sf_dir, 250)).where("node % 10 = 3")
    count = lambda t: F.count(F.when(F.col("cost") <= t, 1)).alias(f"within_{t}")
    return reached.groupBy("origin", (F.col("node") % 5).alias("category")).agg(count(200), count(400), F.round(F.min("cost"), 5).alias("nearest"))


@query()
def net130_betweenness(spark, sf_dir):
    a, b = starts(spark, sf_dir, 200).select(F.col("node").alias("source")), starts(spark, sf_dir, 300).select(F.col("node").alias("target"))
    pairs = a.crossJoin(b).where("source <> target")  # the demand table itself
    pairs = pairs.select((F.col("source") * 1_000_000 + F.col("target")).alias("pair_id"), "source", "target", ((F.col("source") + F.col("target")) % 7).cast("double").alias("demand"))
    return graph.betweenness(arcs(spark, sf_dir), pairs)


@query()
def net179_routes(spark, sf_dir):
    """Path, distance, time and cost of routes from every 100th node to a node elsewhere."""
    n = nodes(spark, sf_dir).where("node_id % 100 = 0").select(F.col("node_id").alias("pair_id"), F.col("node_id").alias("source"), F.floor(F.col("node_id") / 2 + 3).cast("long").alias("target"))
    steps = graph.paths(arcs(spark, sf_dir), n).join(car(spark, sf_dir), "edge_id")
    return steps.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length_m").alias("length_m"), F.round(F.sum("time_s"), 5).alias("time_s"), F.round(F.sum("cost"), 5).alias("cost"))


@query(
    PRELUDE
    + """, un AS (SELECT from_node AS u, to_node AS v FROM edges WHERE road_class IN ('motorway', 'trunk', 'primary') UNION SELECT to_node, from_node FROM edges WHERE road_class IN ('motorway', 'trunk', 'primary')),
    cc(n, c) USING KEY (n) AS (SELECT DISTINCT u, u FROM un UNION (SELECT un.v, min(cc.c) FROM cc JOIN un ON un.u = cc.n LEFT JOIN recurring.cc r ON r.n = un.v GROUP BY un.v, r.c HAVING min(cc.c) < r.c))
    SELECT n AS node, c AS component FROM cc"""
)
def net134_weak_components(spark, sf_dir):
    e = edges(spark, sf_dir).where(F.col("road_class").isin("motorway", "trunk", "primary"))
    return graph.weak_components(e.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"))).select("node", "component")


@query(
    NET
    + """, li AS (SELECT edge_id, 'height' AS kind, CAST(200 + edge_id * 7 % 300 AS DOUBLE) AS maximum FROM edges WHERE edge_id % 9 = 1 UNION ALL SELECT edge_id, 'weight', CAST(3 + edge_id % 40 AS DOUBLE) FROM edges WHERE edge_id % 11 = 2)
    SELECT edge_id, round(cost, 6) AS cost FROM car WHERE cost IS NOT NULL AND NOT EXISTS (SELECT 1 FROM li WHERE li.edge_id = car.edge_id AND ((kind = 'height' AND 380 > maximum) OR (kind = 'weight' AND 18 > maximum)))"""
)
def net107_vehicle_theta_join(spark, sf_dir):
    e = edges(spark, sf_dir)
    limits = e.where("edge_id % 9 = 1").select("edge_id", F.lit("height").alias("kind"), (200 + F.col("edge_id") * 7 % 300).cast("double").alias("maximum"))
    limits = limits.unionByName(e.where("edge_id % 11 = 2").select("edge_id", F.lit("weight").alias("kind"), (3 + F.col("edge_id") % 40).cast("double").alias("maximum")))
    banned = joins.vehicle_excluded(limits, {"height": 380, "weight": 18})
    return car(spark, sf_dir).where("cost is not null").join(banned, "edge_id", "left_anti").select("edge_id", r6("cost", "cost"))


@query(
    NET
    + """, av AS (SELECT edge_id, CASE WHEN edge_id % 21 <> 0 THEN CAST(1.5 + edge_id % 3 AS DOUBLE) END AS penalty_factor FROM edges WHERE edge_id % 7 = 0)
    SELECT car.edge_id, round(cost * coalesce(penalty_factor, 1.0), 6) AS cost FROM car LEFT JOIN av USING (edge_id) WHERE cost IS NOT NULL AND (av.edge_id IS NULL OR penalty_factor IS NOT NULL)"""
)
def net109_avoid_set(spark, sf_dir):
    avoided = edges(spark, sf_dir).where("edge_id % 7 = 0").select("edge_id", F.when(F.col("edge_id") % 21 != 0, (1.5 + F.col("edge_id") % 3).cast("double")).alias("penalty_factor"))
    return joins.avoid(car(spark, sf_dir).where("cost is not null"), avoided, "cost").select("edge_id", r6("cost", "cost"))


@query(PRELUDE + "SELECT e.edge_id, e.road_class, e.length_m FROM edges e JOIN nodes n ON n.node_id = e.from_node WHERE n.lon BETWEEN 6.2 AND 6.4 AND n.lat BETWEEN 53.1 AND 53.6 ORDER BY e.edge_id LIMIT 25000")
def net081_bounding_box_scan(spark, sf_dir):
    inside = nodes(spark, sf_dir).where(F.col("lon").between(6.2, 6.4) & F.col("lat").between(53.1, 53.6)).select(F.col("node_id").alias("from_node"))
    return edges(spark, sf_dir).join(inside, "from_node").select("edge_id", "road_class", "length_m").orderBy("edge_id").limit(25_000)


@query(
    NET
    + """, q AS (SELECT from_node AS node, round(cost, 6) AS cost, length_m FROM car WHERE cost IS NOT NULL)
    SELECT node, cost, length_m FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.node = q.node AND o.cost <= q.cost AND o.length_m <= q.length_m AND (o.cost < q.cost OR o.length_m < q.length_m))"""
)
def net162_pareto_frontier(spark, sf_dir):
    rows = car(spark, sf_dir).where("cost is not null").select(F.col("from_node").alias("node"), r6("cost", "cost"), "length_m")
    return intervals.skyline(rows, ["node"], "cost", "length_m")
