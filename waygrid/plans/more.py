"""Queries on tags, slopes, elevation, areas, restrictions, alternatives and time-dependent search, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, parse, tags
from ..operators import graph, search
from ..sources.synth import PRELUDE, edges, nodes, table
from .network import NET, arcs, car, tree_sql
from .registry import query

HIGHWAYS = [*tags.ROAD_CLASS, "proposed", "elevator"]
SURFACES = [*tags.SURFACE, "wood"]


def sql_map(values: dict[str, str], key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


WAYS = f"""WITH w AS (SELECT p_partkey AS way_id, CASE WHEN p_partkey % 9 <> 4 THEN {sql_list(HIGHWAYS)}[p_partkey % {len(HIGHWAYS)} + 1] END AS highway, CASE WHEN p_partkey % 18 = 4 THEN 'ferry' END AS route,
  {sql_list(SURFACES)}[p_partkey % {len(SURFACES)} + 1] AS surface, CASE p_partkey % 5 WHEN 0 THEN 'yes' WHEN 1 THEN '-1' WHEN 2 THEN 'no' END AS oneway,
  CASE WHEN p_partkey % 3 = 0 THEN 30 + p_size END AS ms, CASE WHEN p_partkey % 4 = 0 THEN 10 + p_size END AS msf, CASE WHEN p_partkey % 2 = 0 THEN 1 + p_size % 6 END AS ln, CASE WHEN p_partkey % 6 = 0 THEN 1 + p_size % 3 END AS lf, p_partkey % 7 = 0 AS toll FROM part)
"""


def ways(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    pairs = {
        "highway": F.when(k % 9 != 4, pick(HIGHWAYS)),
        "route": F.when(k % 18 == 4, "ferry"),
        "surface": pick(SURFACES),
        "oneway": F.when(k % 5 == 0, "yes").when(k % 5 == 1, "-1").when(k % 5 == 2, "no"),
        "maxspeed": F.when(k % 3 == 0, (30 + size).cast("string")),
        "maxspeed:forward": F.when(k % 4 == 0, F.concat((10 + size).cast("string"), F.lit(" mph"))),
        "lanes": F.when(k % 2 == 0, (1 + size % 6).cast("string")),
        "lanes:forward": F.when(k % 6 == 0, (1 + size % 3).cast("string")),
        "toll": F.when(k % 7 == 0, "yes"),
    }
    entries = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in pairs.items()]), lambda e: e["value"].isNotNull())
    return table(spark, sf_dir, "part").select(k.alias("way_id"), F.map_from_entries(entries).alias("tags"))


CLASS_SQL = f"CASE WHEN highway IS NOT NULL THEN {sql_map(tags.ROAD_CLASS, 'highway')} WHEN route = 'ferry' THEN 'ferry' END"


@query(WAYS + f"SELECT way_id, {CLASS_SQL} AS road_class FROM w WHERE {CLASS_SQL} IS NOT NULL")
def net056_way_classification(spark, sf_dir):
    return ways(spark, sf_dir).select("way_id", tags.road_class(F.col("tags")).alias("road_class")).where("road_class is not null")


@query(WAYS + f"SELECT way_id, coalesce({sql_map(tags.SURFACE, 'surface')}, 'unknown') AS surface, toll FROM w")
def net057_surface_and_toll(spark, sf_dir):
    t = F.col("tags")
    return ways(spark, sf_dir).select("way_id", tags.surface(t).alias("surface"), tags.toll(t).alias("toll"))


DIRECTION = "CASE WHEN oneway = 'yes' THEN 1 WHEN oneway = '-1' THEN -1 WHEN oneway = 'no' THEN 0 WHEN highway = 'motorway' THEN 1 ELSE 0 END"


@query(WAYS + f"SELECT way_id, {DIRECTION} AS direction FROM w")
def net059_one_way(spark, sf_dir):
    return ways(spark, sf_dir).select("way_id", tags.direction(F.col("tags")).alias("direction"))


@query(
    WAYS
    + f""", d AS (SELECT *, {DIRECTION} AS dir FROM w)
    SELECT way_id, round(coalesce(msf * 1.609344e0, CAST(ms AS DOUBLE)), 6) AS forward_kph, CAST(ms AS DOUBLE) AS backward_kph,
      CAST(CASE WHEN lf IS NULL THEN CASE dir WHEN 1 THEN ln WHEN 0 THEN ceil(ln / 2) END ELSE lf END AS INTEGER) AS forward_lanes,
      CAST(CASE WHEN lf IS NULL THEN CASE dir WHEN -1 THEN ln WHEN 0 THEN CASE WHEN ln IS NOT NULL THEN greatest(floor(ln / 2), 1) END END ELSE CASE WHEN ln IS NULL THEN 1 ELSE greatest(ln - lf, 1) END END AS INTEGER) AS backward_lanes FROM d"""
)
def net060_speed_and_lanes(spark, sf_dir):
    t = F.col("tags")
    (fs, bs), (fl, bl) = tags.speed_limits(t), tags.lanes(t)
    return ways(spark, sf_dir).select("way_id", F.round(fs, 6).alias("forward_kph"), bs.alias("backward_kph"), fl.alias("forward_lanes"), bl.alias("backward_lanes"))


@query(PRELUDE + "SELECT edge_id, round(greatest(0.1, least(1.2, exp(-3.5 * abs(ascent_m / length_m + 0.05) + 3.5 * 0.05))), 6) AS tobler, round(CASE WHEN ascent_m / length_m <= 0 THEN 1.0 WHEN ascent_m / length_m <= 0.1 THEN 1.0 - ascent_m / length_m * 4 WHEN ascent_m / length_m <= 0.3 THEN 0.6 - (ascent_m / length_m - 0.1) * 2 ELSE 0.2 END, 6) AS piecewise FROM edges")
def net070_slope_factor(spark, sf_dir):
    g = F.col("ascent_m") / F.col("length_m")
    return edges(spark, sf_dir).select("edge_id", F.round(tags.tobler(g), 6).alias("tobler"), F.round(tags.piecewise(g, [(0.0, 1.0), (0.1, 0.6), (0.3, 0.2)]), 6).alias("piecewise"))


@query(PRELUDE + "SELECT edge_id, CASE WHEN p.node_id % 6 < q.node_id % 6 THEN 'up' WHEN p.node_id % 6 > q.node_id % 6 THEN 'down' END AS crossing FROM edges JOIN nodes p ON p.node_id = from_node JOIN nodes q ON q.node_id = to_node WHERE p.node_id % 6 <> q.node_id % 6")
def net075_border_crossings(spark, sf_dir):
    """Areas are residues of node numbers."""
    a, b = F.col("from_node") % 6, F.col("to_node") % 6
    return edges(spark, sf_dir).where(a != b).select("edge_id", F.when(a < b, "up").otherwise("down").alias("crossing"))


@query(NET + "SELECT edge_id, CASE WHEN cost IS NULL THEN 4294967295 WHEN cost > 0 AND round(cost * 1024) < 1 THEN 1 ELSE CAST(round(cost * 1024) AS BIGINT) END AS ticks FROM car")
def net290_weight_ticks(spark, sf_dir):
    return car(spark, sf_dir).select("edge_id", tags.cch_ticks(F.col("cost")).alias("ticks"))


#: Two areas as rings: the first that holds a point is its area.
RINGS = {"north": [(6.1, 53.5), (6.8, 53.4), (6.9, 53.9), (6.4, 53.7), (6.1, 53.95)], "south": [(6.0, 53.0), (7.0, 53.1), (6.7, 53.55), (6.2, 53.3)]}


def inside_sql(ring: list[tuple[float, float]]) -> str:
    terms = []
    for (ax, ay), (bx, by) in zip([ring[-1], *ring[:-1]], ring, strict=True):
        terms.append(f"CASE WHEN (CAST({by} AS DOUBLE) > lat) <> (CAST({ay} AS DOUBLE) > lat) AND lon < (CAST({ax} AS DOUBLE) - CAST({bx} AS DOUBLE)) * (lat - CAST({by} AS DOUBLE)) / (CAST({ay} AS DOUBLE) - CAST({by} AS DOUBLE)) + CAST({bx} AS DOUBLE) THEN 1 ELSE 0 END")
    return "(" + " + ".join(terms) + ") % 2 = 1"


@query(PRELUDE + f"SELECT node_id, CASE WHEN {inside_sql(RINGS['north'])} THEN 'north' WHEN {inside_sql(RINGS['south'])} THEN 'south' END AS area FROM nodes")
def net103_point_in_polygon(spark, sf_dir):
    ring = lambda name: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RINGS[name]])
    inside = lambda name: geo.point_in_ring(F.col("lon"), F.col("lat"), ring(name))
    return nodes(spark, sf_dir).select("node_id", F.when(inside("north"), "north").when(inside("south"), "south").alias("area"))


GRID = 0.05


@query(
    PRELUDE
    + f""", g AS (SELECT x, y, CAST((x * 13 + y * 7) % 50 AS DOUBLE) AS h FROM (SELECT unnest(generate_series(119, 141)) AS x), (SELECT unnest(generate_series(1059, 1081)) AS y)),
    n AS (SELECT node_id, lon / {GRID} AS gx, lat / {GRID} AS gy FROM nodes), f AS (SELECT node_id, CAST(floor(gx) AS BIGINT) AS x, CAST(floor(gy) AS BIGINT) AS y, gx - floor(gx) AS fx, gy - floor(gy) AS fy FROM n)
    SELECT node_id, round(sum(h * CASE WHEN g.x = f.x THEN 1 - fx ELSE fx END * CASE WHEN g.y = f.y THEN 1 - fy ELSE fy END), 5) AS height FROM f JOIN g ON g.x IN (f.x, f.x + 1) AND g.y IN (f.y, f.y + 1) GROUP BY node_id"""
)
def net105_elevation_sample(spark, sf_dir):
    """Bilinear: each point meets its four cells by an equi-join."""
    grid = spark.range(119, 142).select(F.col("id").alias("x")).join(spark.range(1059, 1082).select(F.col("id").alias("y")))  # the raster itself
    grid = grid.select("x", "y", ((F.col("x") * 13 + F.col("y") * 7) % 50).cast("double").alias("h"))
    gx, gy = F.col("lon") / GRID, F.col("lat") / GRID
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    at = nodes(spark, sf_dir).select("node_id", F.floor(gx).alias("bx"), F.floor(gy).alias("by"), (gx - F.floor(gx)).alias("fx"), (gy - F.floor(gy)).alias("fy"), corner.alias("c"))
    at = at.withColumn("x", F.col("bx") + F.col("c.i")).withColumn("y", F.col("by") + F.col("c.j"))
    part = F.col("h") * F.when(F.col("c.i") == 0, 1 - F.col("fx")).otherwise(F.col("fx")) * F.when(F.col("c.j") == 0, 1 - F.col("fy")).otherwise(F.col("fy"))
    return at.join(grid, ["x", "y"]).groupBy("node_id").agg(F.round(F.sum(part), 5).alias("height"))


@query(tree_sql(500, 300.0).replace("SELECT from_node AS u, to_node AS v", "SELECT to_node AS u, from_node AS v") + "SELECT o AS origin, n AS node, round(c, 5) AS cost FROM tree")
def net194_inbound_area(spark, sf_dir):
    start = nodes(spark, sf_dir).where("node_id % 500 = 0").select(F.col("node_id").alias("origin"), F.col("node_id").alias("node"))
    return graph.trees(search.inbound(arcs(spark, sf_dir)), start, 300.0).withColumn("cost", F.round("cost", 5))


OD = "SELECT a.node_id AS pair_id, a.node_id AS source, CAST(floor(a.node_id / 2 + 3) AS BIGINT) AS target FROM nodes a WHERE a.node_id % 100 = 0"


def pairs(spark, sf_dir, every=100):
    k = F.col("node_id")
    return nodes(spark, sf_dir).where(k % every == 0).select(k.alias("pair_id"), k.alias("source"), F.floor(k / 2 + 3).cast("long").alias("target"))


@query(tree_sql(100) + f", od AS ({OD}) SELECT pair_id, round(c, 5) AS cost, CASE WHEN c IS NULL THEN 'failed' ELSE 'succeeded' END AS status FROM od LEFT JOIN tree ON o = source AND n = target")
def net187_od_batch(spark, sf_dir):
    asked = pairs(spark, sf_dir)
    rows = asked.join(graph.pair_costs(arcs(spark, sf_dir), asked), "pair_id", "left")
    return rows.select("pair_id", F.round("cost", 5).alias("cost"), F.when(F.col("cost").isNull(), "failed").otherwise("succeeded").alias("status"))


@query(tree_sql(100) + f", od AS ({OD}) SELECT CASE WHEN c IS NULL THEN 'failed' ELSE 'succeeded' END AS status, count(*) AS n FROM od LEFT JOIN tree ON o = source AND n = target GROUP BY 1")
def net133_batch_tallies(spark, sf_dir):
    return net187_od_batch(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query()
def net192_alternatives(spark, sf_dir):
    return search.alternatives(arcs(spark, sf_dir), pairs(spark, sf_dir, 1)).withColumn("cost", F.round("cost", 5))


@query()
def net206_pareto_routes(spark, sf_dir):
    climb = edges(spark, sf_dir).select("edge_id", F.col("ascent_m").alias("r"))
    return search.pareto_routes(arcs(spark, sf_dir), climb, pairs(spark, sf_dir, 500)).withColumn("cost", F.round("cost", 5))


@query()
def net094_restricted_search(spark, sf_dir):
    """Forbidden sequences: three ring edges in a row, from every 15th node."""
    k = F.col("node_id")
    banned = nodes(spark, sf_dir).where(k % 15 == 2).select(F.array(k * 3, k * 3 + 3, k * 3 + 6).alias("edge_path"))
    start = nodes(spark, sf_dir).where(k % 700 == 0).select(k.alias("origin"), k.alias("node"))
    return search.restricted_costs(arcs(spark, sf_dir), banned, start).withColumn("cost", F.round("cost", 5))


@query()
def net216_earliest_arrival(spark, sf_dir):
    shut = edges(spark, sf_dir).where("edge_id % 10 = 0").select("edge_id", (F.col("edge_id") % 300).alias("start_s"), (F.col("edge_id") % 300 + 120).alias("end_s"))
    asked = nodes(spark, sf_dir).where("node_id % 900 = 0").select(F.col("node_id").alias("request"), F.col("node_id").alias("node"), F.lit(60.0).alias("departure_s"))
    return search.earliest_arrivals(arcs(spark, sf_dir, "time_s"), shut, asked).withColumn("arrival_s", F.round("arrival_s", 4))


@query("SELECT l_orderkey AS run, l_linenumber AS seq, round(greatest(0.05, least(1.0, 1 - min(l_quantity) / 50)), 6) AS greenshields, round(greatest(0.05, least(1.0, 1 / (1 + 0.15 * pow(min(l_quantity) / 25, 4)))), 6) AS bpr FROM lineitem GROUP BY 1, 2")
def net251_congestion(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq")).agg(F.min("l_quantity").alias("q"))
    return rows.select("run", "seq", F.round(tags.greenshields(F.col("q") / 50), 6).alias("greenshields"), F.round(tags.bpr(F.col("q") / 25), 6).alias("bpr"))


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size * 60 WHEN 1 THEN p_size * 3600 + 90 WHEN 2 THEN 3600 + p_size * 60 END AS BIGINT) AS s FROM part")
def net276_parse_duration(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 4 == 0, size).when(k % 4 == 1, F.concat(size, F.lit(":01:30"))).when(k % 4 == 2, F.concat(F.lit("PT1H"), size, F.lit("M"))).otherwise("soon")
    return table(spark, sf_dir, "part").select(k.alias("id"), parse.duration_s(text).cast("long").alias("s"))


@query("SELECT p_partkey AS id, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 1e0 WHEN 1 THEN p_size * 0.3048e0 + 5 * 0.0254e0 END, 6) AS metres, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 1e0 WHEN 1 THEN p_size * 0.001e0 ELSE p_size * 0.00045359237e0 END, 9) AS tonnes FROM part")
def net277_parse_size_and_weight(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    length = F.when(k % 3 == 0, F.concat(size, F.lit(" m"))).when(k % 3 == 1, F.concat(size, F.lit("'5\""))).otherwise("tall")
    weight = F.concat(size, F.element_at(F.array(*map(F.lit, (" t", " kg", "lbs"))), (k % 3 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(parse.length_m(length), 6).alias("metres"), F.round(parse.weight_t(weight), 9).alias("tonnes"))


@query("WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN [0, p_size % 3] ELSE generate_series(-2, p_size % 4 - 1) END AS l FROM part) SELECT id, array_to_string(l, ' ') AS levels FROM x")
def net289_parse_levels(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    text = F.when(k % 2 == 0, F.concat(F.lit("0;"), (size % 3).cast("string"))).otherwise(F.concat(F.lit("-2-"), (size % 4 - 1).cast("string")))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(F.transform(parse.levels(text), lambda x: x.cast("string")), " ").alias("levels"))


@query(
    PRELUDE
    + """, w AS (SELECT node_id // 40 AS route, node_id % 40 AS seq, node_id // 7 % 3 AS area FROM nodes), g AS (SELECT *, CASE WHEN area = lag(area) OVER (PARTITION BY route ORDER BY seq) THEN 0 ELSE 1 END AS nw FROM w),
    i AS (SELECT *, sum(nw) OVER (PARTITION BY route ORDER BY seq) AS span FROM g) SELECT route, CAST(span AS BIGINT) AS span, area, min(seq) AS first_seq, max(seq) AS last_seq FROM i GROUP BY route, span, area"""
)
def net153_area_spans(spark, sf_dir):
    by = Window.partitionBy("route").orderBy("seq")
    rows = nodes(spark, sf_dir).select(F.expr("node_id div 40").alias("route"), (F.col("node_id") % 40).alias("seq"), F.expr("node_id div 7 % 3").alias("area"))
    new = F.when(F.lag("area").over(by).eqNullSafe(F.col("area")), 0).otherwise(1)
    return rows.withColumn("span", F.sum(new).over(by)).groupBy("route", "span", "area").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
