"""Queries on heights, travel through changing speeds, cost components and transfers, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells, components, elevation, transfers
from ..sources.synth import PRELUDE, edges, nodes, table
from .network import HAVERSINE, NET, car
from .registry import query
from .tables import cell_sql
from .wide import BOXES, Rows, boxes

r6 = lambda c, name: F.round(c, 6).alias(name)


def shaped(spark, sf_dir):
    """Edges with the places and heights of their ends."""
    end = lambda s: nodes(spark, sf_dir).select(F.col("node_id").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in ("lon", "lat", "z")])
    return edges(spark, sf_dir).join(end("from"), "from_node").join(end("to"), "to_node")


RUN_M = HAVERSINE.format(lat1="a.lat", lat2="b.lat", lon1="a.lon", lon2="b.lon")


@query(
    PRELUDE
    + f""", s AS (SELECT edge_id, a.lon AS alon, a.lat AS alat, a.z AS az, b.lon AS blon, b.lat AS blat, b.z AS bz, {RUN_M} AS run, edge_id % 4 = 0 AS st FROM edges JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node),
    p AS (SELECT *, CAST(CASE WHEN st OR run <= 5000 THEN 1 ELSE ceil(run / 5000) END AS INTEGER) AS pieces FROM s), i AS (SELECT *, unnest(generate_series(0, pieces)) AS i FROM p),
    t AS (SELECT *, i / CAST(pieces AS DOUBLE) AS t FROM i), x AS (SELECT edge_id, i, pieces, run, az + (bz - az) * t AS plain, floor((alon + (blon - alon) * t) / 0.05) AS cx, floor((alat + (blat - alat) * t) / 0.05) AS cy FROM t),
    r AS (SELECT floor(lon / 0.05) AS cx, floor(lat / 0.05) AS cy, avg(z) AS height FROM nodes GROUP BY 1, 2), h AS (SELECT edge_id, i, pieces, run, CASE WHEN i > 0 AND i < pieces THEN coalesce(height, plain) ELSE plain END AS h FROM x LEFT JOIN r USING (cx, cy)),
    d AS (SELECT *, h - lag(h) OVER (PARTITION BY edge_id ORDER BY i) AS rise FROM h)
    SELECT edge_id, round(sum(greatest(rise, 0)), 6) AS ascent_m, round(sum(greatest(rise, 0) - rise), 6) AS descent_m, round(greatest(max(rise / (run / pieces)), 0.0) + 0.0, 6) AS max_up, round(greatest(max(-rise / (run / pieces)), 0.0) + 0.0, 6) AS max_down FROM d WHERE rise IS NOT NULL GROUP BY 1"""
)
def net106_edge_elevation(spark, sf_dir):
    raster = nodes(spark, sf_dir).groupBy(F.floor(F.col("lon") / 0.05).alias("cell_x"), F.floor(F.col("lat") / 0.05).alias("cell_y")).agg(F.avg("z").alias("height"))
    rows = shaped(spark, sf_dir).withColumn("structure", F.col("edge_id") % 4 == 0)
    out = elevation.edge_elevation(rows, raster, 0.05, 5000.0)
    return out.select("edge_id", *[r6(c, c) for c in ("ascent_m", "descent_m", "max_up", "max_down")])


LINES = PRELUDE + f""", l AS (SELECT node_id // 10 AS line, node_id % 10 AS seq, lon, lat FROM nodes), g AS (SELECT *, lead(lon) OVER w AS blon, lead(lat) OVER w AS blat FROM l WINDOW w AS (PARTITION BY line ORDER BY seq)),
    m AS (SELECT *, CASE WHEN blon IS NULL THEN 0 ELSE {HAVERSINE.format(lat1="lat", lat2="blat", lon1="lon", lon2="blon")} END AS m FROM g), c AS (SELECT *, sum(m) OVER (PARTITION BY line ORDER BY seq) AS e FROM m)"""


@query(
    LINES + """, n AS (SELECT line, max(e) AS whole FROM c GROUP BY 1), k AS (SELECT line, unnest(generate_series(1, CAST(floor(whole / 30000) AS BIGINT))) AS step FROM n),
    i AS (SELECT line, step, lon + (blon - lon) * (step * 30000 - (e - m)) / m AS lon, lat + (blat - lat) * (step * 30000 - (e - m)) / m AS lat FROM k JOIN c USING (line) WHERE step * 30000 > e - m AND step * 30000 <= e AND blon IS NOT NULL)
    SELECT line, step, round(lon, 6) AS lon, round(lat, 6) AS lat FROM i UNION ALL SELECT line, 0, round(arg_min(lon, seq), 6), round(arg_min(lat, seq), 6) FROM l GROUP BY 1
    UNION ALL SELECT line, CAST(floor(e / 30000) + 1 AS BIGINT), round(lon, 6), round(lat, 6) FROM c WHERE blon IS NULL AND e - floor(e / 30000) * 30000 > 1e-6"""
)
def net154_resample(spark, sf_dir):
    lines = nodes(spark, sf_dir).select(F.floor(F.col("node_id") / 10).alias("line"), (F.col("node_id") % 10).alias("seq"), "lon", "lat")
    return elevation.resample(lines, "line", 30_000.0).select("line", "step", r6("lon", "lon"), r6("lat", "lat"))


SPEEDS = Rows("part", "p_partkey AS edge", "p_partkey % 6 + 2 AS n")
ENTRIES = Rows("lineitem", "l_partkey AS edge", "l_orderkey AS trip", "l_linenumber AS seq", "CAST(l_orderkey * 37 % 5000 AS DOUBLE) AS entry_s", "CAST(l_quantity * 40 AS DOUBLE) AS base_s")


@query(
    f"""WITH s AS ({SPEEDS.sql}), b AS (SELECT edge, CAST(i * 700 AS DOUBLE) AS start_s, (1 + (edge + i * 3) % 5) / 4.0 AS ratio, CASE WHEN i + 1 < n THEN CAST((i + 1) * 700 AS DOUBLE) ELSE 1e15 END AS end_s FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM s)),
    w AS (SELECT *, sum((end_s - start_s) * ratio) OVER (PARTITION BY edge ORDER BY start_s) - (end_s - start_s) * ratio AS before FROM b), e AS (SELECT DISTINCT * FROM ({ENTRIES.sql})),
    g AS (SELECT e.*, before + (entry_s - start_s) * ratio + base_s AS goal FROM e JOIN w USING (edge) WHERE entry_s >= start_s AND entry_s < end_s)
    SELECT edge, trip, seq, round(start_s + (goal - before) / ratio, 4) AS exit_s, entry_s, base_s FROM g JOIN w USING (edge) WHERE goal >= before AND goal < before + (end_s - start_s) * ratio"""
)
def net156_traversal(spark, sf_dir):
    i = F.col("i")
    buckets = SPEEDS(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("edge", (i * 700).cast("double").alias("start_s"), ((1 + (F.col("edge") + i * 3) % 5) / 4.0).alias("ratio"))
    out = elevation.traversal(ENTRIES(spark, sf_dir).distinct(), buckets, "edge")
    return out.withColumn("exit_s", F.round("exit_s", 4))


@query(NET + "SELECT edge_id, round(CASE WHEN surface = 'gravel' AND NOT road_class = 'track' THEN time_s * 0.75 ELSE 0 END, 6) AS gravel_time, round(CAST(CASE WHEN is_toll THEN length_m ELSE 0 END AS DOUBLE), 6) AS toll_distance FROM car WHERE cost IS NOT NULL")
def net306_components(spark, sf_dir):
    rows = car(spark, sf_dir).where("cost is not null")
    amounts = {"time": F.col("time_s"), "distance": F.col("length_m").cast("double"), "ascent": F.col("ascent_m"), "descent": F.lit(0.0)}
    of = lambda text: components.component(text, amounts, lambda name: F.col(name).cast("string"), lambda name: F.lit(0.25))
    return rows.select("edge_id", r6(of('travel_time × (surface == "gravel") * (road_class != track) * (1 - overlay:rain)'), "gravel_time"), r6(of("is_toll == 'true' * length"), "toll_distance"))


@query(PRELUDE + f", s AS (SELECT node_id AS stop, lon, lat FROM nodes WHERE node_id % 7 = 0) SELECT from_stop, to_stop, CAST(ceil(m / 1.25) AS BIGINT) AS seconds FROM (SELECT *, row_number() OVER (PARTITION BY from_stop ORDER BY m, to_stop) AS rk FROM (SELECT a.stop AS from_stop, b.stop AS to_stop, {RUN_M} AS m FROM s a JOIN s b ON a.stop <> b.stop) WHERE m <= 6000) WHERE rk <= 4")
def net119_walking_table(spark, sf_dir):
    stops = nodes(spark, sf_dir).where("node_id % 7 = 0").select(F.col("node_id").alias("stop"), "lon", "lat")
    return transfers.walking_table(stops, 6000.0, 0.06, 1.25, 4)


@query(PRELUDE + f", s AS (SELECT node_id AS stop, lon, lat FROM nodes WHERE node_id % 7 = 0) SELECT a.stop AS from_stop, b.stop AS to_stop, round({RUN_M}, 4) AS distance_m FROM s a JOIN s b ON a.stop <> b.stop WHERE {RUN_M} <= 6000")
def net115_transfer_candidates(spark, sf_dir):
    stops = nodes(spark, sf_dir).where("node_id % 7 = 0").select(F.col("node_id").alias("stop"), "lon", "lat")
    return transfers.candidates(stops, 6000.0, 0.06).withColumn("distance_m", F.round("distance_m", 4))


PAIRS = Rows(
    "orders", "o_orderkey AS pair", "o_custkey % 12 AS from_stop", "o_orderkey % 90 AS from_trip", "o_orderkey % 9 AS from_route", "o_orderkey % 3600 AS arrival_s", "o_custkey % 7 AS to_stop", "o_custkey % 80 AS to_trip", "o_custkey % 8 AS to_route",
    "o_orderkey % 3600 + o_custkey % 400 AS departure_s",
)
RULES = Rows(
    "part", "p_partkey AS rule", "p_partkey % 12 AS from_stop", "p_partkey % 7 AS to_stop", "CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 90 END AS from_trip", "CASE WHEN p_partkey % 6 = 0 THEN p_partkey % 80 END AS to_trip",
    "CASE WHEN p_partkey % 5 IN (1, 2) THEN p_partkey % 9 END AS from_route", "CASE WHEN p_partkey % 6 IN (1, 2) THEN p_partkey % 8 END AS to_route", "p_partkey % 8 = 3 AS forbidden", "p_partkey % 300 AS least_s",
)


@query(
    f"""WITH p AS ({PAIRS.sql}), r AS (SELECT * FROM ({RULES.sql}) WHERE rule < 300),
    m AS (SELECT pair, forbidden, least_s, departure_s - arrival_s AS gap, CASE WHEN r.from_trip IS NOT NULL THEN 2 WHEN r.from_route IS NOT NULL THEN 1 ELSE 0 END AS a, CASE WHEN r.to_trip IS NOT NULL THEN 2 WHEN r.to_route IS NOT NULL THEN 1 ELSE 0 END AS b
      FROM p JOIN r USING (from_stop, to_stop) WHERE CASE WHEN r.from_trip IS NOT NULL THEN r.from_trip = p.from_trip ELSE r.from_route IS NULL OR r.from_route = p.from_route END AND CASE WHEN r.to_trip IS NOT NULL THEN r.to_trip = p.to_trip ELSE r.to_route IS NULL OR r.to_route = p.to_route END),
    k AS (SELECT *, CASE WHEN a + b = 4 THEN 6 WHEN a + b = 3 THEN 5 WHEN greatest(a, b) = 2 THEN 4 ELSE a + b + 1 END AS sp FROM m), t AS (SELECT pair, sp, count(*) AS n, bool_or(forbidden) AS f, max(least_s) AS l, max(gap) AS gap FROM k GROUP BY 1, 2 QUALIFY sp = max(sp) OVER (PARTITION BY pair))
    SELECT p.pair, CASE WHEN n > 1 THEN 'ambiguous' WHEN n IS NULL OR (NOT f AND t.gap >= l) THEN 'allowed' ELSE 'refused' END AS verdict FROM p LEFT JOIN t USING (pair)"""
)
def net118_transfer_rules(spark, sf_dir):
    return transfers.judged(PAIRS(spark, sf_dir), RULES(spark, sf_dir).where("rule < 300"))


@query("SELECT s_suppkey AS stop, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS street, s_suppkey % 3 = 0 AS bound FROM supplier")
def net116_stop_bindings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return transfers.bound(s.select(F.col("s_suppkey").alias("stop")), s.where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("stop"), F.col("s_nationkey").alias("street")))


@query(
    f"""WITH b AS (SELECT area_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w FROM ({BOXES.sql})), g AS (SELECT area_id, (i + 0.5) * 0.03125 AS cx, unnest(generate_series(1600, 1800)) AS j, x, y, w FROM (SELECT *, unnest(generate_series(150, 300)) AS i FROM b))
    SELECT area_id, {cell_sql(9, "cx", "(j + 0.5) * 0.03125")} AS cell FROM g WHERE cx BETWEEN x AND x + w AND (j + 0.5) * 0.03125 BETWEEN y AND y + w"""
)
def net173_cell_cover(spark, sf_dir):
    x, y, w = (F.col(c) for c in "xyw")
    covered = boxes(spark, sf_dir).select("area_id", x.alias("min_lon"), y.alias("min_lat"), (x + w).alias("max_lon"), (y + w).alias("max_lat"))
    return cells.cover(covered, 9, 100_000).select("area_id", "cell")


@query(f"WITH p AS (SELECT p_partkey AS k, CAST(6.0 AS DOUBLE) + p_partkey % 100 / 100.0 AS lon, CAST(53.0 AS DOUBLE) + p_partkey % 90 / 90.0 AS lat FROM part), o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS d) SELECT k, {cell_sql(7, '(lon + a.d * 0.125)', '(lat + b.d * 0.125)')} AS cell FROM p, o a, o b WHERE greatest(abs(a.d), abs(b.d)) = 2")
def net246_cell_ring(spark, sf_dir):
    k = F.col("p_partkey")
    cell = cells.cell_at(F.lit(6.0) + k % 100 / 100.0, F.lit(53.0) + k % 90 / 90.0, 7)
    return table(spark, sf_dir, "part").select(k.alias("k"), F.explode(cells.ring(cell, 2)).alias("cell"))


@query(
    PRELUDE + """, h AS (SELECT edge_id % 500 AS path, edge_id AS seq, CASE WHEN from_node % 3 = 0 THEN 'A' WHEN from_node % 3 = 1 THEN 'B' END AS name, (edge_id * 47 % 360) * 1.0 AS heading FROM edges), l AS (SELECT *, lag(heading) OVER w AS ph, lag(name) OVER w AS pn FROM h WINDOW w AS (PARTITION BY path ORDER BY seq)),
    a AS (SELECT *, ((heading - ph + 540) % 360) - 180 AS t FROM l) , c AS (SELECT *, CASE WHEN ph IS NULL THEN 'depart' WHEN abs(t) <= 40 THEN 'straight' WHEN t > 0 THEN 'right' ELSE 'left' END AS turn FROM a) SELECT path, seq, turn, name FROM c WHERE turn <> 'straight' OR name IS DISTINCT FROM pn"""
)
def net155_maneuvers(spark, sf_dir):
    k = F.col("edge_id")
    path = edges(spark, sf_dir).select((k % 500).alias("path"), k.alias("seq"), F.when(F.col("from_node") % 3 == 0, "A").when(F.col("from_node") % 3 == 1, "B").alias("name"), (k * 47 % 360).cast("double").alias("heading"))
    turned = F.pmod(F.col("heading") - F.col("prev_heading") + 540.0, F.lit(360.0)) - 180
    turn = F.when(F.abs(turned) <= 40, "straight").when(turned > 0, "right").otherwise("left")
    return elevation.maneuvers(path, "path", turn).select("path", "seq", "turn", "name")


@query(PRELUDE + "SELECT edge_id FROM edges JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node WHERE access_mask & 1 <> 0 AND least(a.lon, b.lon) <= 6.4 AND greatest(a.lon, b.lon) >= 6.2 AND least(a.lat, b.lat) <= 53.5 AND greatest(a.lat, b.lat) >= 53.3")
def net082_routable_in_box(spark, sf_dir):
    meets = (F.least("from_lon", "to_lon") <= 6.4) & (F.greatest("from_lon", "to_lon") >= 6.2) & (F.least("from_lat", "to_lat") <= 53.5) & (F.greatest("from_lat", "to_lat") >= 53.3)
    return shaped(spark, sf_dir).where(F.col("access_mask").bitwiseAND(F.lit(1)) != 0).where(meets).select("edge_id")


@query(NET + "SELECT edge_id, road_class, surface, length_m, cost IS NOT NULL AS allowed, round(time_s, 4) AS time_s, round(length_m / time_s * 3.6, 4) AS speed_kph, round(cost, 4) AS cost FROM car")
def net083_explorer(spark, sf_dir):
    rows = car(spark, sf_dir)
    return rows.select("edge_id", "road_class", "surface", "length_m", F.col("cost").isNotNull().alias("allowed"), F.round("time_s", 4).alias("time_s"), F.round(F.col("length_m") / F.col("time_s") * 3.6, 4).alias("speed_kph"), F.round("cost", 4).alias("cost"))
