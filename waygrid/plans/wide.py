"""Queries on access, facilities, relations of tables, summaries and values, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import access, geo, values
from ..operators import cells, facility, joins, relate, summaries
from ..sources.synth import PRELUDE, edges, nodes, table
from .network import HAVERSINE, NEAR, points, targets
from .registry import query
from .tables import CUSTOMERS, cell_sql, customer_points

r6 = lambda c, name: F.round(c, 6).alias(name)


class Rows:
    """Rows made from a table by expressions that both engines read alike."""

    def __init__(self, source: str, *expressions: str):
        self.source, self.expressions = source, expressions
        self.sql = f"SELECT {', '.join(expressions)} FROM {source}"

    def __call__(self, spark, sf_dir):
        return table(spark, sf_dir, self.source).selectExpr(*self.expressions)


# --- values ---

ROUTES = Rows("part", "p_partkey AS route", "CASE WHEN p_partkey % 50 = 7 THEN 'x' || CAST(p_partkey AS STRING) ELSE CAST(p_partkey * 7 % 1300 AS STRING) END AS route_type")


@query(
    f"""WITH r AS ({ROUTES.sql}), n AS (SELECT route, try_cast(route_type AS INTEGER) AS t FROM r)
    SELECT route, CASE WHEN t = 0 THEN 'tram' WHEN t = 1 THEN 'subway' WHEN t = 2 OR t BETWEEN 100 AND 199 THEN 'rail' WHEN t = 3 OR t BETWEEN 700 AND 799 THEN 'bus' WHEN t = 4 OR t BETWEEN 1000 AND 1099 THEN 'ferry'
      WHEN t = 5 THEN 'cable_car' WHEN t = 6 THEN 'gondola' WHEN t = 7 THEN 'funicular' WHEN t BETWEEN 200 AND 299 THEN 'coach' WHEN t BETWEEN 1100 AND 1199 THEN 'air' ELSE 'other' END AS mode FROM n"""
)
def net292_route_modes(spark, sf_dir):
    return ROUTES(spark, sf_dir).select("route", values.route_mode(F.col("route_type")).alias("mode"))


COUNTRIES = Rows("customer", "c_custkey AS place", "chr(CAST(65 + c_custkey % 26 AS INTEGER)) || lower(chr(CAST(65 + c_custkey * 7 % 25 AS INTEGER))) || ' ' AS code")


@query(f"WITH c AS ({COUNTRIES.sql}) SELECT place, CASE WHEN upper(trim(code)) IN ({', '.join(repr(x) for x in values.LEFT_HAND)}) THEN 'left' ELSE 'right' END AS side FROM c")
def net291_driving_side(spark, sf_dir):
    return COUNTRIES(spark, sf_dir).select("place", values.driving_side(F.col("code")).alias("side"))


@query(PRELUDE + "SELECT edge_id, round(a.lon + (b.lon - a.lon) * (edge_id % 11) / 10.0, 6) AS lon, round(a.lat + (b.lat - a.lat) * (edge_id % 11) / 10.0, 6) AS lat, round(a.z + (b.z - a.z) * (edge_id % 11) / 10.0, 6) AS z FROM edges JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node")
def net270_edge_points(spark, sf_dir):
    end = lambda s: nodes(spark, sf_dir).select(F.col("node_id").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in ("lon", "lat", "z")])
    rows = edges(spark, sf_dir).join(end("from"), "from_node").join(end("to"), "to_node")
    at = values.interpolate([F.col(f"from_{c}") for c in ("lon", "lat", "z")], [F.col(f"to_{c}") for c in ("lon", "lat", "z")], F.col("edge_id") % 11 / 10.0)
    return rows.select("edge_id", *[r6(x, c) for x, c in zip(at, ("lon", "lat", "z"), strict=True)])


@query(f"WITH p AS ({CUSTOMERS}) SELECT point_id, round(lon + degrees((point_id % 900) / (6371000.0 * cos(radians(lat)))), 6) AS lon, round(lat + degrees((point_id % 700 - 300) / 6371000.0), 6) AS lat FROM p")
def net269_offset_points(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    lon, lat = values.offset_point(F.col("lon"), F.col("lat"), F.col("point_id") % 900, F.col("point_id") % 700 - 300)
    return p.select("point_id", r6(lon, "lon"), r6(lat, "lat"))


RUNS = Rows("lineitem", "l_orderkey AS agent", "l_linenumber AS seq", "CAST(5 + l_quantity AS DOUBLE) AS took", "CAST(20 + l_partkey % 700 AS DOUBLE) AS length_m")


@query(
    f"""WITH r AS (SELECT agent, seq, min(took) AS took, min(length_m) AS length_m FROM ({RUNS.sql}) GROUP BY 1, 2), e AS (SELECT *, sum(took) OVER (PARTITION BY agent ORDER BY seq) - took AS enter FROM r),
    x AS (SELECT *, 40 - enter AS t FROM e WHERE enter <= 40 AND 40 < enter + took), y AS (SELECT *, took * took - 4 * 0.5 * (1 / 1.5 + 1 / 2.0) * length_m AS rest FROM x),
    z AS (SELECT *, (took - sqrt(greatest(rest, 0))) / (2 * 0.5 * (1 / 1.5 + 1 / 2.0)) AS top FROM y), q AS (SELECT *, top / 1.5 AS up, top / 2.0 AS down, greatest(took - top / 1.5 - top / 2.0, 0) AS cruise FROM z)
    SELECT agent, seq, round(CASE WHEN rest <= 0 THEN length_m * t / took WHEN t <= up THEN 0.5 * 1.5 * t * t WHEN t <= up + cruise THEN 0.5 * 1.5 * up * up + top * (t - up)
      ELSE 0.5 * 1.5 * up * up + top * cruise + top * least(t - up - cruise, down) - 0.5 * 2.0 * pow(least(t - up - cruise, down), 2) END, 4) AS along_m FROM q"""
)
def net254_trajectory_position(spark, sf_dir):
    from pyspark.sql import Window

    rows = RUNS(spark, sf_dir).groupBy("agent", "seq").agg(F.min("took").alias("took"), F.min("length_m").alias("length_m"))
    rows = rows.withColumn("enter", F.sum("took").over(Window.partitionBy("agent").orderBy("seq")) - F.col("took"))
    now = rows.where("enter <= 40 and 40 < enter + took")
    return now.select("agent", "seq", F.round(values.trapezoid(40 - F.col("enter"), F.col("took"), F.col("length_m"), 1.5, 2.0), 4).alias("along_m"))


@query("WITH p AS (SELECT l_quantity AS a, l_discount AS b FROM lineitem), c AS (SELECT CAST(CAST(a AS BIGINT) AS VARCHAR) AS a, CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE CAST(b AS VARCHAR) END AS b FROM p) SELECT a, b, count(*) AS n FROM c GROUP BY 1, 2")
def net283_canonical_values(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(*[values.canonical(F.col(f"l_{c}"), "float").alias(n) for c, n in (("quantity", "a"), ("discount", "b"))])
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


TYPED = Rows("orders", "o_orderkey AS k", "CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN '-12' WHEN 2 THEN '1.5e3' WHEN 3 THEN '{\"a\": 1}' WHEN 4 THEN 'a1' WHEN 5 THEN '.5' ELSE '+7' END AS x", "CASE o_custkey % 5 WHEN 0 THEN 'false' WHEN 1 THEN '9' WHEN 2 THEN '2.' WHEN 3 THEN '[1]' ELSE 'text' END AS y")
KIND = "CASE WHEN {c} IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match({c}, '[+-]?[0-9]+') THEN 'integer' WHEN try_cast({c} AS DOUBLE) IS NOT NULL THEN 'float' WHEN left({c}, 1) IN ('{{', '[') AND json_valid({c}) THEN 'json' ELSE 'string' END"


@query(
    f"WITH t AS ({TYPED.sql}), i AS (SELECT k, {KIND.format(c='x')} AS a, {KIND.format(c='y')} AS b FROM t) SELECT k, CASE WHEN a = b THEN a WHEN a IN ('integer', 'float') AND b IN ('integer', 'float') THEN 'float' WHEN a IN ('json', 'string') AND b IN ('json', 'string') THEN 'json' ELSE 'string' END AS kind FROM i"
)
def net284_type_promotion(spark, sf_dir):
    return TYPED(spark, sf_dir).select("k", values.promoted(values.inferred(F.col("x")), values.inferred(F.col("y"))).alias("kind"))


SMALL = "CASE WHEN {v} < 9.5 THEN greatest(floor({v} + 0.5), 1) WHEN {v} < 95 THEN floor({v} / 10.0 + 0.5) * 10.0 ELSE floor({v} / 50.0 + 0.5) * 50.0 END"
LARGE = "CASE WHEN {v} < 9.95 THEN round(floor({v} * 10 + 0.5) / 10, 1) ELSE floor({v} + 0.5) END"


@query(
    f"""WITH d AS (SELECT l_extendedprice * (l_linenumber % 3) / 20 AS m FROM lineitem), x AS (SELECT m, {SMALL.format(v="m")} AS s, m / 1609.344 AS mi, m * 3.280839895013123 AS ft FROM d),
    y AS (SELECT CASE WHEN s < 1000 THEN s ELSE {LARGE.format(v="(m / 1000)")} END AS value, CASE WHEN s < 1000 THEN 'meters' ELSE 'kilometers' END AS unit FROM x
      UNION ALL SELECT CASE WHEN mi < 0.095 THEN {SMALL.format(v="ft")} ELSE {LARGE.format(v="mi")} END, CASE WHEN mi < 0.095 THEN 'feet' ELSE 'miles' END FROM x)
    SELECT value, unit, count(*) AS n FROM y GROUP BY 1, 2"""
)
def net295_spoken_distance(spark, sf_dir):
    m = F.col("l_extendedprice") * (F.col("l_linenumber") % 3) / 20
    both = [table(spark, sf_dir, "lineitem").select(*[c.alias(n) for c, n in zip(values.spoken_distance(m, way), ("value", "unit"), strict=True)]) for way in (False, True)]
    return both[0].unionByName(both[1]).groupBy("value", "unit").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS edge_id, CAST(p_size AS DOUBLE) AS time_s, p_retailprice AS cost FROM part")
def net286_component_map(spark, sf_dir):
    named = values.component_map(["time", "cost"], F.array(F.col("p_size").cast("double"), F.col("p_retailprice")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("edge_id"), named["time"].alias("time_s"), named["cost"].alias("cost"))


# --- access and facilities ---

TAGS = Rows(
    "part",
    "p_partkey AS way_id",
    "CASE p_partkey % 9 WHEN 0 THEN 'motorway' WHEN 1 THEN 'footway' WHEN 2 THEN 'cycleway' WHEN 3 THEN 'busway' ELSE 'residential' END AS highway",
    "CASE WHEN p_partkey % 5 = 1 THEN 'yes' END AS motorroad",
    "CASE p_partkey % 11 WHEN 0 THEN 'no' WHEN 1 THEN 'destination' WHEN 2 THEN ' private ' WHEN 3 THEN 'unknown' END AS access",
    "CASE p_partkey % 13 WHEN 0 THEN 'yes' WHEN 1 THEN 'delivery' WHEN 2 THEN 'dismount' WHEN 3 THEN 'forestry' END AS vehicle",
    "CASE p_partkey % 17 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS psv",
    "CASE p_partkey % 19 WHEN 0 THEN 'designated' WHEN 1 THEN 'use_sidepath' END AS bicycle",
    "CASE p_partkey % 23 WHEN 0 THEN 'customers' WHEN 1 THEN 'no' END AS motorcar",
    "CASE p_partkey % 6 WHEN 0 THEN '3.5' WHEN 1 THEN '12''6\"' WHEN 2 THEN 'none' END AS maxheight",
    "CASE p_partkey % 8 WHEN 0 THEN '7.5 t' WHEN 1 THEN '3500 kg' WHEN 2 THEN 'default' END AS maxweight",
    "CASE WHEN p_partkey % 10 = 3 THEN 'no' WHEN p_partkey % 10 = 4 THEN 'yes' END AS hazmat",
)
TAG_NAMES = ["highway", "motorroad", "access", "vehicle", "psv", "bicycle", "motorcar", "maxheight", "maxweight", "hazmat"]


def tagged(spark, sf_dir):
    return TAGS(spark, sf_dir).select("way_id", F.map_filter(F.create_map(*[x for n in TAG_NAMES for x in (F.lit(n), F.col(n))]), lambda _, v: v.isNotNull()).alias("tags"))


VERDICT = "CASE WHEN trim({c}) IN ('yes', 'designated', 'official', 'permissive', 'discouraged') THEN 'allowed' WHEN trim({c}) IN ('destination', 'delivery', 'customers') THEN 'destination' WHEN trim({c}) IN ('no', 'private', 'agricultural', 'forestry', 'use_sidepath', 'permit', 'emergency', 'military') THEN 'denied' END"


def access_sql(mode: str, bit: int, keys: list[str], default: str) -> str:
    found = ", ".join(VERDICT.format(c=k) for k in keys)
    return f"coalesce({found + ', ' if keys else ''}CASE WHEN {default} THEN 'allowed' ELSE 'denied' END) AS {mode}"


SLOW = "NOT (motorroad IS NOT DISTINCT FROM 'yes')"


@query(
    f"""WITH t AS ({TAGS.sql}), a AS (SELECT way_id, {", ".join([
        access_sql("car", 1, ["motorcar", "vehicle", "access"], "highway IN ('motorway', 'residential')"),
        access_sql("bicycle_", 2, ["bicycle", "vehicle", "access"], f"highway IN ('cycleway', 'residential') AND {SLOW}"),
        access_sql("foot", 4, ["access"], f"highway IN ('footway', 'cycleway', 'residential') AND {SLOW}"),
        access_sql("hgv", 8, ["vehicle", "access"], "highway IN ('motorway', 'residential')"),
        access_sql("bus", 16, ["psv", "vehicle", "access"], "highway IN ('motorway', 'residential', 'busway')"),
        access_sql("taxi", 32, ["psv", "vehicle", "access"], "highway IN ('motorway', 'residential')"),
        access_sql("motorcycle", 64, ["vehicle", "access"], "highway IN ('motorway', 'residential')"),
        access_sql("moped", 128, ["vehicle", "access"], f"highway = 'residential' AND {SLOW}"),
    ])} FROM t)
    SELECT way_id, {" + ".join(f"CASE WHEN {m} <> 'denied' THEN {b} ELSE 0 END" for m, b in (("car", 1), ("bicycle_", 2), ("foot", 4), ("hgv", 8), ("bus", 16), ("taxi", 32), ("motorcycle", 64), ("moped", 128)))} AS access_mask,
      {" + ".join(f"CASE WHEN {m} = 'destination' THEN {b} ELSE 0 END" for m, b in (("car", 1), ("bicycle_", 2), ("foot", 4), ("hgv", 8), ("bus", 16), ("taxi", 32), ("motorcycle", 64), ("moped", 128)))} AS destination_mask FROM a"""
)
def net058_access(spark, sf_dir):
    passing, only = access.masks(F.col("tags"))
    return tagged(spark, sf_dir).select("way_id", passing.alias("access_mask"), only.alias("destination_mask"))


@query(
    f"""WITH t AS ({TAGS.sql}) SELECT way_id, 'height' AS kind, CASE maxheight WHEN '3.5' THEN 350 ELSE 381 END AS maximum FROM t WHERE maxheight IN ('3.5', '12''6"')
    UNION ALL SELECT way_id, 'weight', CASE maxweight WHEN '7.5 t' THEN 7500 ELSE 3500 END FROM t WHERE maxweight IN ('7.5 t', '3500 kg') UNION ALL SELECT way_id, 'hazmat', 0 FROM t WHERE hazmat = 'no'"""
)
def net062_vehicle_limits(spark, sf_dir):
    return tagged(spark, sf_dir).select("way_id", F.explode(access.vehicle_limits(F.col("tags"))).alias("x")).select("way_id", "x.kind", "x.maximum")


@query(PRELUDE + "SELECT edge_id FROM edges WHERE NOT (edge_id % 7 = 2) AND NOT (edge_id % 5 = 1)")
def net068_refused_directions(spark, sf_dir):
    out = edges(spark, sf_dir)
    foot, bicycle = F.col("edge_id") % 7 == 2, F.col("edge_id") % 5 == 1
    for mode in ("foot", "bicycle"):
        out = out.where(~access.refused_direction(mode, foot, bicycle, False, False))
    # a profile that accepts them refuses nothing
    return out.where(~access.refused_direction("foot", foot, bicycle, True, False)).select("edge_id")


@query(
    PRELUDE
    + """, f AS (SELECT edge_id, CAST(length_m AS DOUBLE) AS l, CASE WHEN edge_id % 4 = 0 THEN 0.1 ELSE ascent_m END AS h, CASE edge_id % 7 WHEN 0 THEN 'stairs' WHEN 1 THEN 'escalator' WHEN 2 THEN 'lift' WHEN 3 THEN 'travelator' WHEN 4 THEN 'ramp' END AS k FROM edges)
    SELECT edge_id, round(CASE k WHEN 'stairs' THEN greatest(l / 1.4, h / 0.25) + CASE WHEN h >= 0.25 THEN 6.0 ELSE 0 END WHEN 'escalator' THEN CASE WHEN h >= 0.25 THEN l / (0.5 + 0.3) + 6.0 ELSE l / 1.4 END
      WHEN 'lift' THEN greatest(h / 1.0, sqrt(greatest(l * l - h * h, 0)) / 1.4) + CASE WHEN h >= 0.25 THEN 30.0 ELSE 0 END WHEN 'travelator' THEN l / (0.7 + 0.3) + 6.0 WHEN 'ramp' THEN l / (1.4 * 0.9) / 0.8 + 6.0 ELSE l / (1.4 * 0.9) END, 6) AS time_s FROM f"""
)
def net071_facilities(spark, sf_dir):
    k = F.col("edge_id") % 7
    kind = F.when(k == 0, "stairs").when(k == 1, "escalator").when(k == 2, "lift").when(k == 3, "travelator").when(k == 4, "ramp")
    height = F.when(F.col("edge_id") % 4 == 0, 0.1).otherwise(F.col("ascent_m"))
    time = facility.traversal_s(kind, F.col("length_m").cast("double"), height, F.lit(0.0), 1.4, F.lit(0.9), walking_mps=0.3, boarding_s=6.0)
    return edges(spark, sf_dir).select("edge_id", r6(time, "time_s"))


# --- relations ---

WAYS = Rows("part", "p_partkey AS way_id", "p_partkey * 3 % 100 AS a", "p_partkey * 7 % 90 AS b", "p_partkey % 150 AS c", "p_partkey % 400000 + 150000 * (p_partkey % 2) AS d")


@query(PRELUDE + f""", w AS ({WAYS.sql}), s AS (SELECT way_id, 0 AS seq, a AS from_node, b AS to_node FROM w UNION ALL SELECT way_id, 1, b, c FROM w UNION ALL SELECT way_id, 2, c, d FROM w)
    SELECT way_id, seq, from_node, to_node, round(x.lon, 6) AS from_lon, round(y.lat, 6) AS to_lat FROM s JOIN nodes x ON x.node_id = from_node JOIN nodes y ON y.node_id = to_node""")
def net095_way_segments(spark, sf_dir):
    ways = WAYS(spark, sf_dir).select("way_id", F.array("a", "b", "c", "d").alias("node_ids"))
    return relate.way_segments(ways, nodes(spark, sf_dir)).select("way_id", "seq", "from_node", "to_node", r6("from_lon", "from_lon"), r6("to_lat", "to_lat"))


@query(PRELUDE + "SELECT edge_id, p_name AS name FROM edges LEFT JOIN part ON p_partkey = way_id AND way_id % 3 <> 0")
def net096_edge_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name_id"), F.col("p_name").alias("name"))
    return relate.with_names(edges(spark, sf_dir).withColumnRenamed("way_id", "name_id"), names).select("edge_id", "name")


def attributed(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    features = part.select(F.col("p_partkey").alias("feature_row"), F.col("p_size").alias("size_class"))
    domains = part.select(F.lit("size_class").alias("column_name"), (F.col("p_size") % 10).cast("string").alias("code"), F.concat(F.lit("class "), F.col("p_size") % 10).alias("label")).distinct()
    return relate.with_attributes(edges(spark, sf_dir).select("edge_id", F.col("from_node").alias("feature_row")), features, domains, "size_class")


ATTRIBUTES = PRELUDE + ", f AS (SELECT edge_id, CAST(p_size AS VARCHAR) AS raw, CASE WHEN p_size < 10 AND p_size IN (SELECT p_size % 10 FROM part) THEN 'class ' || p_size END AS label FROM edges LEFT JOIN part ON p_partkey = from_node)"


@query(ATTRIBUTES + " SELECT edge_id, raw, label FROM f")
def net097_feature_attributes(spark, sf_dir):
    return attributed(spark, sf_dir).select("edge_id", "raw", "label")


@query(ATTRIBUTES + " SELECT edge_id FROM f WHERE raw = '12' UNION ALL SELECT edge_id FROM f WHERE label = 'class 7'")
def net080_attribute_equality(spark, sf_dir):
    rows = attributed(spark, sf_dir)
    return relate.attribute_is(rows, "12").unionByName(relate.attribute_is(rows, "class 7")).select("edge_id")


@query(PRELUDE + "SELECT a.edge_id AS prev_edge, b.edge_id AS next_edge, CASE WHEN b.edge_id % 6 = 1 AND NOT a.edge_id % 6 = 1 THEN CAST(135 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS entry_cost FROM edges a JOIN edges b ON a.to_node = b.from_node")
def net091_destination_entry(spark, sf_dir):
    e = edges(spark, sf_dir)
    only = e.where("edge_id % 3 = 1").select("edge_id", F.when(F.col("edge_id") % 2 == 1, 5).otherwise(2).alias("mask"))
    return relate.entry_cost(joins.transitions(e).select("prev_edge", "next_edge"), only, 1, 90.0, 1.5).select("prev_edge", "next_edge", "entry_cost")


BOXES = Rows("supplier", "s_suppkey AS area_id", "'zone ' || CAST(s_suppkey % 7 AS STRING) AS name", "6.0 + s_suppkey * 17 % 90 / 100.0 AS x", "53.0 + s_suppkey * 29 % 90 / 100.0 AS y", "0.03 + s_suppkey % 5 / 50.0 AS w")


def boxes(spark, sf_dir):
    """BOXES in doubles throughout, as the SQL's engine has them: decimals would round some sides otherwise."""
    k, double = F.col("s_suppkey"), lambda x: x.cast("double")
    x, y, w = F.lit(6.0) + double(k * 17 % 90) / 100.0, F.lit(53.0) + double(k * 29 % 90) / 100.0, F.lit(0.03) + double(k % 5) / 50.0
    return table(spark, sf_dir, "supplier").select(k.alias("area_id"), F.concat(F.lit("zone "), (k % 7).cast("string")).alias("name"), x.alias("x"), y.alias("y"), w.alias("w"))


def areas(spark, sf_dir):
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    corner = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return boxes(spark, sf_dir).select("area_id", "name", F.array(corner(x, y), corner(x + w, y), corner(x + w, y + w), corner(x, y + w)).alias("ring"))


BOX = f"b AS (SELECT area_id, name, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w FROM ({BOXES.sql}))"


@query(f"WITH p AS ({CUSTOMERS}), {BOX} SELECT point_id, area_id FROM p JOIN b ON lon >= x AND lon < x + w AND lat >= y AND lat < y + w")
def net103_areas(spark, sf_dir):
    return relate.in_areas(customer_points(spark, sf_dir), areas(spark, sf_dir), 0.05).select("point_id", "area_id")


@query(f"WITH p AS ({CUSTOMERS}), {BOX}, h AS (SELECT point_id, arg_min(name, area_id) AS zone FROM p JOIN b ON lon >= x AND lon < x + w AND lat >= y AND lat < y + w GROUP BY 1) SELECT point_id, coalesce(zone, 'UTC') AS zone FROM p LEFT JOIN h USING (point_id)")
def net104_timezones(spark, sf_dir):
    return relate.zone_of(customer_points(spark, sf_dir), areas(spark, sf_dir), 0.05, "point_id", "UTC").select("point_id", "zone")


LEVELS = (4, 6, 8)
MEMBERS = " UNION ALL ".join(f"SELECT {r} AS resolution, {cell_sql(r)} AS cell, max(point_id) % 50 AS value FROM p WHERE point_id % {r + 1} = 0 GROUP BY 2" for r in LEVELS)


def members(spark, sf_dir):
    p, out = customer_points(spark, sf_dir), None
    for r in LEVELS:
        part = p.where(F.col("point_id") % (r + 1) == 0).groupBy(cells.cell_at(F.col("lon"), F.col("lat"), r).alias("cell")).agg((F.max("point_id") % 50).alias("value")).select(F.lit(r).alias("resolution"), "cell", "value")
        out = part if out is None else out.unionByName(part)
    return out


HELD = f"WITH p AS ({CUSTOMERS}), m AS ({MEMBERS}), o AS (" + " UNION ALL ".join(f"SELECT point_id, {r} AS resolution, {cell_sql(r)} AS cell FROM p" for r in LEVELS) + ")"


@query(HELD + " SELECT point_id, max(resolution) AS resolution, arg_max(cell, resolution) AS cell, arg_max(value, resolution) AS value FROM o JOIN m USING (resolution, cell) GROUP BY 1")
def net174_finest_cell(spark, sf_dir):
    return relate.finest_cell(customer_points(spark, sf_dir).select("point_id", "lon", "lat"), members(spark, sf_dir), list(LEVELS)).select("point_id", "resolution", "cell", "value")


@query(HELD + " SELECT point_id, round(product(coalesce(0.5 + value / 40.0, 1.0)), 6) AS factor, bit_or(coalesce(value % 8, 0)) AS closed FROM o LEFT JOIN m USING (resolution, cell) GROUP BY 1")
def net175_zone_effects(spark, sf_dir):
    zones = members(spark, sf_dir).select("resolution", "cell", (0.5 + F.col("value") / 40.0).alias("factor"), (F.col("value") % 8).alias("closed"))
    out = relate.zone_effects(customer_points(spark, sf_dir), zones, list(LEVELS), "point_id")
    return out.select("point_id", r6("factor", "factor"), "closed")


WINDOWS = Rows("lineitem", "l_suppkey AS edge_id", "l_orderkey * 613 % 100000 AS s", "l_orderkey * 613 % 100000 + l_partkey % 90 AS e", "l_linenumber % 2 AS side")
MERGED = """{n} AS (SELECT edge_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY edge_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM
    (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY edge_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM w WHERE side IN ({side}))) GROUP BY edge_id, part)"""


@query(f"WITH w AS (SELECT DISTINCT * FROM ({WINDOWS.sql})), " + MERGED.format(n="m", side="0, 1") + " SELECT edge_id, s, e FROM m")
def net176_merged_windows(spark, sf_dir):
    return relate.merge_windows(WINDOWS(spark, sf_dir), ["edge_id"], "s", "e")


@query(f"WITH w AS (SELECT DISTINCT * FROM ({WINDOWS.sql})), {MERGED.format(n='a', side='0')}, {MERGED.format(n='b', side='1')} SELECT edge_id, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM a JOIN b USING (edge_id) WHERE a.s <= b.e AND b.s <= a.e")
def net176_common_windows(spark, sf_dir):
    rows = WINDOWS(spark, sf_dir)
    a, b = (relate.merge_windows(rows.where(F.col("side") == k).drop("side"), ["edge_id"], "s", "e") for k in (0, 1))
    return relate.intersect_windows(a, b, ["edge_id"], "s", "e")


@query(PRELUDE + "SELECT edge_id, CAST(NULL AS DOUBLE) AS penalty_factor FROM edges WHERE edge_id % 5 = 0 OR edge_id % 7 = 0 UNION ALL SELECT edge_id, 2.0 FROM edges WHERE edge_id % 11 = 0")
def net171_avoid_union(spark, sf_dir):
    e = edges(spark, sf_dir).select("edge_id")
    no = F.lit(None).cast("double").alias("penalty_factor")
    return relate.avoid_union([e.where("edge_id % 5 = 0").select("edge_id", no), e.where("edge_id % 7 = 0").select("edge_id", no), e.where("edge_id % 11 = 0").select("edge_id", F.lit(2.0).alias("penalty_factor"))])


TRIPS = Rows("orders", "o_orderkey AS trip", "o_custkey % 40 AS route")


@query(f"WITH t AS ({TRIPS.sql}) SELECT route, trip FROM t WHERE route NOT IN (3, 8, 21) UNION ALL SELECT 1000 + route, trip FROM t WHERE route = 8")
def net177_timetable_overlay(spark, sf_dir):
    base = TRIPS(spark, sf_dir).select("route", "trip")
    lines = base.where("route = 8").select((F.col("route") + 1000).alias("route"), "trip")
    return relate.timetable_overlay(base, base.where("route in (3, 8, 21)"), lines)


PLACES = "SELECT c_custkey AS point_id, CAST(6.0 AS DOUBLE) + CAST(c_custkey % 60 AS DOUBLE) / CAST(60.0 AS DOUBLE) AS lon, CAST(53.0 AS DOUBLE) + CAST(c_custkey % 60 * 7 % 60 AS DOUBLE) / CAST(60.0 AS DOUBLE) AS lat FROM customer"


@query(
    PRELUDE
    + f""", p AS ({PLACES}), q AS (SELECT lon, lat, min(point_id) AS first FROM p GROUP BY 1, 2), d AS (SELECT first, node_id, {HAVERSINE.format(lat1="q.lat", lat2="nodes.lat", lon1="q.lon", lon2="nodes.lon")} AS m FROM q, nodes),
    k AS (SELECT first, arg_min(node_id, m * 1e6 + node_id / 1e6) AS node_id, round(min(m), 4) AS distance_m FROM d WHERE m <= 8000 GROUP BY 1) SELECT point_id, node_id, distance_m FROM p JOIN q USING (lon, lat) JOIN k USING (first)"""
)
def net100_batch_snap(spark, sf_dir):
    k = F.col("c_custkey") % 60
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), (F.lit(6.0) + k / F.lit(60.0)).alias("lon"), (F.lit(53.0) + k * 7 % 60 / F.lit(60.0)).alias("lat"))
    few = joins.thinned(targets(spark, sf_dir), [], "node_id", 1)
    snap = lambda x: joins.nearest(joins.within(x, few, 8000.0, 0.08), "point_id", "node_id", 1).select("point_id", "node_id", F.round("distance_m", 4).alias("distance_m"))
    return relate.once_per_place(p, snap, "point_id")


@query(
    NEAR + """, c AS (SELECT point_id, edge_id, least(from_node, to_node) AS a, greatest(from_node, to_node) AS b, m FROM d JOIN edges ON from_node = node_id WHERE m <= 5000),
    g AS (SELECT point_id, a, b, min(m) AS m, min(edge_id) AS edge_id FROM c GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY m, edge_id) AS rk FROM g)
    SELECT point_id, edge_id, a, b, CAST(rk AS INTEGER) AS "rank", round(m, 4) AS distance_m FROM r WHERE rk <= 5"""
)
def net101_nearest_segments(spark, sf_dir):
    found = relate.nearest_segments_of_places(points(spark, sf_dir), targets(spark, sf_dir), edges(spark, sf_dir), "point_id", 5000.0, 0.05, 5)
    return found.select("point_id", "edge_id", "a", "b", "rank", F.round("distance_m", 4).alias("distance_m"))


SNAPPED = NEAR + ", s AS (SELECT point_id AS point, node_id AS node, node_id % 4 AS component, round(m, 4) AS m FROM d WHERE m <= 5000), pr AS (SELECT s_suppkey AS origin, (s_suppkey * 7 + 1) % (SELECT count(*) FROM supplier) AS destination FROM supplier)"


def snapped(spark, sf_dir):
    """Of each place and component the smallest node, for those who want the nearest."""
    few = joins.thinned(targets(spark, sf_dir).withColumn("component", F.col("node_id") % 4), ["component"], "node_id", 1)
    snap = lambda x: joins.within(x, few, 5000.0, 0.05).select("point_id", "node_id", "component", F.round("distance_m", 4).alias("distance_m"))
    rows = relate.once_per_place(points(spark, sf_dir), snap, "point_id")
    return rows.select(F.col("point_id").alias("point"), F.col("node_id").alias("node"), "component", "distance_m")


def asked_pairs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    return s.join(n).select(F.col("s_suppkey").alias("origin"), ((F.col("s_suppkey") * 7 + 1) % F.col("n")).alias("destination"))


@query(SNAPPED + " SELECT origin, destination, round(min(o.m + e.m), 4) AS hop_m FROM pr JOIN s o ON o.point = origin JOIN s e ON e.point = destination AND e.component = o.component GROUP BY 1, 2")
def net102_component_hop(spark, sf_dir):
    s = snapped(spark, sf_dir)
    return relate.best_hop(asked_pairs(spark, sf_dir), s, s, 5000.0).select("origin", "destination", F.round("hop_m", 4).alias("hop_m"))


@query(SNAPPED + """, c AS (SELECT point, arg_min(component, m * 1e6 + node / 1e6) AS component FROM s GROUP BY 1)
    SELECT origin, destination, CASE WHEN a.component IS NULL THEN 'origin_not_snapped' WHEN b.component IS NULL THEN 'destination_not_snapped' WHEN a.component <> b.component THEN 'disconnected' WHEN origin % 3 = 0 THEN 'no_legal_path' ELSE 'reachable' END AS verdict
    FROM pr LEFT JOIN c a ON a.point = origin LEFT JOIN c b ON b.point = destination""")
def net185_unreachable(spark, sf_dir):
    c = snapped(spark, sf_dir).groupBy("point").agg(F.min(F.struct("distance_m", "node", "component")).alias("x")).select("point", "x.component")
    pairs = asked_pairs(spark, sf_dir)
    return relate.diagnose(pairs, c, pairs.where("origin % 3 <> 0"))


@query(
    NEAR + f""", c AS (SELECT point_id, edge_id, p.lon AS px, p.lat AS py, a.lon AS ax, a.lat AS ay, b.lon AS bx, b.lat AS by_, p.point_id % 360.0 AS wanted, a.z FROM d JOIN edges ON from_node = d.node_id JOIN p USING (point_id) JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node WHERE m <= 5000),
    h AS (SELECT *, round((bx - ax) * (py - ay) - (by_ - ay) * (px - ax), 12) AS cross_, (degrees(atan2(radians(bx - ax) * cos(radians(ay)), radians(by_ - ay))) + 360) % 360 AS heading FROM c)
    SELECT point_id, edge_id FROM h WHERE abs(((heading - wanted + 180 + 720) % 360) - 180) <= 60 AND (point_id % 2 = 0 OR cross_ <= 0) AND (point_id % 3 = 0 OR abs(20 - z) <= 15)"""
)
def net084_snap_constraints(spark, sf_dir):
    n = nodes(spark, sf_dir)
    near = joins.within(points(spark, sf_dir), targets(spark, sf_dir), 5000.0, 0.05).select("point_id", "lon", "lat", F.col("node_id").alias("from_node"))
    rows = near.join(edges(spark, sf_dir).select("edge_id", "from_node", "to_node"), "from_node")
    rows = rows.join(n.select(F.col("node_id").alias("from_node"), F.col("lon").alias("ax"), F.col("lat").alias("ay"), "z"), "from_node").join(n.select(F.col("node_id").alias("to_node"), F.col("lon").alias("bx"), F.col("lat").alias("by")), "to_node")
    c = F.col
    side = relate.side_of_segment(c("lon"), c("lat"), c("ax"), c("ay"), c("bx"), c("by"))
    curb = F.when(c("point_id") % 2 == 1, "same")
    z = F.when(c("point_id") % 3 != 0, 20.0)
    ok = relate.snap_allowed(geo.heading(c("ax"), c("ay"), c("bx"), c("by")), (c("point_id") % 360).cast("double"), 60.0, side, curb, "right", z, c("z"), 15.0)
    return rows.where(ok).select("point_id", "edge_id")


# --- summaries ---

STEPS = Rows("lineitem", "l_orderkey AS route", "CAST(l_extendedprice * 4 AS DOUBLE) AS length_m", "CAST(l_quantity AS DOUBLE) AS time_s", "CAST(round(l_tax * 100) * 4 AS DOUBLE) AS cost", "CASE WHEN l_linenumber = 1 THEN 0.25 ELSE 0.0 END AS from_fraction", "CASE WHEN l_linenumber = 4 THEN 0.5 ELSE 1.0 END AS to_fraction")


@query(f"WITH s AS ({STEPS.sql}) SELECT route, round(sum(length_m * (to_fraction - from_fraction)), 2) AS length_m, round(sum(time_s * (to_fraction - from_fraction)), 2) AS time_s, round(sum(cost * (to_fraction - from_fraction)), 2) AS cost, count(*) AS n_edges FROM s GROUP BY 1")
def net132_route_summary(spark, sf_dir):
    rows = STEPS(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("from_fraction", "to_fraction")})
    out = summaries.route_summary(rows, "route")
    return out.select("route", *[F.round(c, 2).alias(c) for c in ("length_m", "time_s", "cost")], "n_edges")


LEGS = Rows(
    "lineitem",
    "l_orderkey AS journey",
    "l_linenumber AS seq",
    "l_partkey % 300 + l_linenumber * 600 AS departure_s",
    "l_partkey % 300 + l_linenumber * 600 + 100 + l_suppkey % 700 AS arrival_s",
    "l_quantity * 100 AS distance_m",
    "CASE l_linenumber % 5 WHEN 1 THEN 'access' WHEN 2 THEN 'transit' WHEN 3 THEN 'transfer' WHEN 4 THEN 'transit' ELSE 'indoor' END AS leg_type",
)
ONE_LEG = f"l AS (SELECT journey, seq, min(departure_s) AS departure_s, min(arrival_s) AS arrival_s, min(distance_m) AS distance_m, min(leg_type) AS leg_type FROM ({LEGS.sql}) GROUP BY 1, 2)"


def legs(spark, sf_dir):
    return LEGS(spark, sf_dir).groupBy("journey", "seq").agg(*[F.min(c).alias(c) for c in ("departure_s", "arrival_s", "distance_m", "leg_type")])


def took_sql(*kinds: str) -> str:
    return f"sum(CASE WHEN leg_type IN ({', '.join(repr(k) for k in kinds)}) THEN greatest(arrival_s - departure_s, 0) ELSE 0 END)"


@query(
    f"""WITH {ONE_LEG}, w AS (SELECT *, greatest(departure_s - coalesce(lag(arrival_s) OVER (PARTITION BY journey ORDER BY seq), 300), 0) AS wait FROM l)
    SELECT journey, greatest(arg_max(arrival_s, seq) - 300, 0) AS total_s, sum(wait) AS wait_s, {took_sql("access", "egress")} AS access_egress_s, {took_sql("indoor")} AS indoor_s, {took_sql("transfer")} AS transfer_s, {took_sql("transit")} AS transit_s,
      sum(CASE WHEN leg_type = 'transit' THEN 1 ELSE 0 END) AS boardings FROM w GROUP BY 1"""
)
def net143_leg_summary(spark, sf_dir):
    return summaries.leg_summary(legs(spark, sf_dir).withColumn("start_s", F.lit(300)), "journey", "seq", "start_s")


@query(f"WITH {ONE_LEG} SELECT journey, seq, leg_type FROM l WHERE journey NOT IN (SELECT journey FROM l WHERE leg_type = 'transit' AND (arrival_s - departure_s < 150 OR distance_m < 400))")
def net237_minimum_legs(spark, sf_dir):
    return summaries.meet_minimums(legs(spark, sf_dir), "journey", 150, 400).select("journey", "seq", "leg_type")


@query("SELECT count(DISTINCT l_suppkey) AS stops, count(DISTINCT l_orderkey % 10) AS routes, count(DISTINCT l_orderkey) AS trips, count(*) AS stop_times, count(*) - count(DISTINCT l_orderkey) AS connections FROM lineitem")
def net145_import_summary(spark, sf_dir):
    return summaries.import_summary(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS trip", "l_orderkey % 10 AS route", "l_suppkey AS stop"))


DISPATCHED = Rows("orders", "o_custkey % 25 AS zone", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS vehicle", "CAST(o_orderkey % 900 AS DOUBLE) AS pickup_s", "o_totalprice AS fare")


@query(f"WITH d AS ({DISPATCHED.sql}) SELECT zone, count(*) AS requests, count(vehicle) AS assigned, round(avg(pickup_s) FILTER (vehicle IS NOT NULL), 4) AS mean_pickup_s, max(pickup_s) FILTER (vehicle IS NOT NULL) AS max_pickup_s, round(coalesce(sum(fare) FILTER (vehicle IS NOT NULL), 0), 2) AS fares FROM d GROUP BY 1")
def net138_dispatch_summary(spark, sf_dir):
    out = summaries.dispatch_summary(DISPATCHED(spark, sf_dir), "zone")
    return out.withColumn("mean_pickup_s", F.round("mean_pickup_s", 4)).withColumn("fares", F.round("fares", 2))


AGENTS = Rows("lineitem", "l_returnflag AS fleet", "l_linenumber AS vehicle_type", "CAST(l_partkey % 600 AS DOUBLE) AS depart_s", "CASE WHEN l_suppkey % 9 <> 0 THEN CAST(l_partkey % 600 + 60 + l_quantity * 10 AS DOUBLE) END AS arrive_s", "l_quantity * 80 AS distance_m", "l_quantity * 8 AS free_s")


@query(f"WITH a AS ({AGENTS.sql}) SELECT fleet, vehicle_type, count(*) AS agents, count(arrive_s) AS arrived, round(avg(arrive_s - depart_s), 4) AS mean_travel_s, round(sum(distance_m), 2) AS distance_m, round(avg(arrive_s - depart_s - free_s), 4) AS mean_delay_s FROM a GROUP BY 1, 2")
def net140_simulation_summary(spark, sf_dir):
    out = summaries.simulation_summary(AGENTS(spark, sf_dir), ["fleet", "vehicle_type"])
    return out.withColumns({"mean_travel_s": F.round("mean_travel_s", 4), "mean_delay_s": F.round("mean_delay_s", 4), "distance_m": F.round("distance_m", 2)})


@query(f"WITH p AS ({CUSTOMERS}), l AS (SELECT {cell_sql(6)} AS cell, sum(value) FILTER (value > 9000) AS rich FROM p GROUP BY 1) SELECT cell, round(rich, 2) AS weight FROM l WHERE rich IS NOT NULL")
def net128_weighted_layer(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    layer = p.groupBy(cells.cell_at(F.col("lon"), F.col("lat"), 6).alias("cell")).agg(F.sum(F.when(F.col("value") > 9000, F.col("value"))).alias("rich"))
    return summaries.weighted(layer, "rich").select("cell", F.round("weight", 2).alias("weight"))


@query("SELECT site, entrance, CAST(rk AS INTEGER) AS \"rank\", cost FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cost, entrance) AS rk FROM (SELECT l_suppkey AS site, l_partkey AS entrance, min(l_extendedprice) AS cost FROM lineitem GROUP BY 1, 2)) WHERE rk <= 8")
def net165_cheapest_entrances(spark, sf_dir):
    from ..operators import intervals

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("entrance")).agg(F.min("l_extendedprice").alias("cost"))
    return intervals.top_per(rows, ["site"], ["cost", "entrance"], 8).select("site", "entrance", "rank", "cost")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 60")
def net255_frames_in_time(spark, sf_dir):
    return summaries.in_time(table(spark, sf_dir, "events"), "value", 10, 60).select("event_id", "value")


@query(PRELUDE + "SELECT edge_id % 40 AS origin, edge_id, CAST(row_number() OVER (PARTITION BY edge_id % 40 ORDER BY length_m, edge_id) AS INTEGER) AS step FROM edges WHERE edge_id % 40 < 20 QUALIFY step <= 50")
def net201_expansion_order(spark, sf_dir):
    rows = edges(spark, sf_dir).select((F.col("edge_id") % 40).alias("origin"), "edge_id", F.col("length_m").cast("double").alias("cost")).where("origin < 20")
    return summaries.settled_in_order(rows, "origin", "cost", "edge_id", 50).select("origin", "edge_id", "step")


@query(PRELUDE + "SELECT edge_id FROM edges WHERE length_m > 950")
def net163_output_caps(spark, sf_dir):
    found = edges(spark, sf_dir).where("length_m > 950").select("edge_id")
    summaries.guarded_matrix(found.limit(10), found.limit(10))
    return summaries.capped(found, 250_000, "features")
