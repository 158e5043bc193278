"""Queries on areas: from seeds, by departure, over timetables and streets, their outlines; and routes over waypoints; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schedules
from ..operators import graph, reach, rounds, traffic
from ..sources.synth import edges, nodes, table
from ..streaming import live
from .network import NET, SPANS, arcs, car, starts, tree_sql
from .registry import query
from .tables import CONNS, LIVE_AT, STOPS, events
from .turning import WALKS, rounds_sql, timetable

#: Label correction from the rows (o, n, c) of {starts}.
SEEDED = """, arc AS (SELECT from_node AS u, to_node AS v, min(cost) AS w FROM car WHERE cost IS NOT NULL GROUP BY 1, 2),
tree(o, n, c) USING KEY (o, n) AS (
  SELECT o, n, min(c) FROM ({starts}) GROUP BY 1, 2
  UNION
  (SELECT t.o, arc.{to}, min(t.c + arc.w) FROM tree t JOIN arc ON arc.{at} = t.n LEFT JOIN recurring.tree r ON r.o = t.o AND r.n = arc.{to}
   GROUP BY t.o, arc.{to}, r.c HAVING (r.c IS NULL OR min(t.c + arc.w) < r.c) AND min(t.c + arc.w) <= {limit})
)
"""
AREA = "SELECT o AS origin, edge_id, round(CASE WHEN c + cost > {limit} THEN ({limit} - c) / cost ELSE 1.0 END, 6) AS end_fraction, round(c, 5) AS start_cost FROM tree JOIN car ON {at} = n WHERE cost IS NOT NULL AND c < {limit}"
SEEDS = "SELECT node_id - node_id % 500 AS o, node_id AS n, CAST(20 + node_id % 500 * 3 AS DOUBLE) AS c FROM nodes WHERE node_id % 500 IN (0, 7)"


def rounded(rows):
    return rows.select("origin", "edge_id", F.round("end_fraction", 6).alias("end_fraction"), F.round("start_cost", 5).alias("start_cost"))


def seeds(spark, sf_dir):
    k = F.col("node_id")
    return nodes(spark, sf_dir).where((k % 500).isin(0, 7)).select((k - k % 500).alias("origin"), k.alias("node"), (20 + k % 500 * 3).cast("double").alias("cost"))


@query(NET + SEEDED.format(starts=SEEDS, at="u", to="v", limit=250.0) + AREA.format(limit=250.0, at="from_node"))
def net199_seeded_area(spark, sf_dir):
    return rounded(reach.seeded_area(arcs(spark, sf_dir), seeds(spark, sf_dir), 250.0))


@query(NET + SEEDED.format(starts=SEEDS, at="v", to="u", limit=250.0) + AREA.format(limit=250.0, at="to_node"))
def net199_seeded_inbound(spark, sf_dir):
    return rounded(reach.seeded_area(arcs(spark, sf_dir), seeds(spark, sf_dir), 250.0, inbound=True))


# --- by departure: every fifth edge is shut for five minutes ---

TIMED = """, arc AS (SELECT from_node AS u, to_node AS v, cost AS w, edge_id % 5 = 0 AS shut FROM car WHERE cost IS NOT NULL),
rq AS ({requests}),
tree(o, n, c) USING KEY (o, n) AS (
  SELECT o, n, c FROM rq
  UNION
  (SELECT t.o, arc.v, min(CASE WHEN shut AND t.c >= 9000 AND t.c < 9300 THEN 9300.0 ELSE t.c END + arc.w) AS x FROM tree t JOIN arc ON arc.u = t.n LEFT JOIN recurring.tree r ON r.o = t.o AND r.n = arc.v
   GROUP BY t.o, arc.v, r.c HAVING r.c IS NULL OR min(CASE WHEN shut AND t.c >= 9000 AND t.c < 9300 THEN 9300.0 ELSE t.c END + arc.w) < r.c)
)
"""
DEPARTURES = "SELECT node_id AS o, node_id AS n, CAST(8900 + node_id // 500 * 70 AS DOUBLE) AS c FROM nodes WHERE node_id % 500 = 0"
SEQUENCE = "SELECT node_id * 3 + j AS o, node_id AS n, CAST(8900 + 200 * j AS DOUBLE) AS c FROM nodes, (SELECT unnest([0, 1, 2]) AS j) WHERE node_id % 500 = 0"


def shut(spark, sf_dir):
    return car(spark, sf_dir).where("edge_id % 5 = 0").select("edge_id", F.lit(9000).alias("start_s"), F.lit(9300).alias("end_s"))


def departures(spark, sf_dir):
    return starts(spark, sf_dir, 500, "request").withColumn("departure_s", (8900 + F.floor(F.col("node") / 500) * 70).cast("double"))


@query(NET + TIMED.format(requests=DEPARTURES) + "SELECT t.o AS request, t.n AS node, round(t.c, 5) AS arrival_s FROM tree t JOIN rq ON rq.o = t.o WHERE t.c <= rq.c + 400")
def net219_timed_area(spark, sf_dir):
    return reach.timed_area(arcs(spark, sf_dir), shut(spark, sf_dir), departures(spark, sf_dir), 400.0).withColumn("arrival_s", F.round("arrival_s", 5))


@query(NET + TIMED.format(requests=DEPARTURES) + "SELECT rq.o AS request, node_id AS destination, round(t.c - rq.c, 5) AS duration_s FROM rq JOIN nodes ON node_id % 50 = 0 LEFT JOIN tree t ON t.o = rq.o AND t.n = node_id")
def net220_timed_matrix(spark, sf_dir):
    to = starts(spark, sf_dir, 50, "destination")
    return reach.timed_matrix(arcs(spark, sf_dir), shut(spark, sf_dir), departures(spark, sf_dir), to).withColumn("duration_s", F.round("duration_s", 5))


@query(NET + TIMED.format(requests=SEQUENCE) + "SELECT rq.n AS origin, CAST(rq.c AS BIGINT) AS departure_s, t.n AS node, round(t.c, 5) AS arrival_s FROM tree t JOIN rq ON rq.o = t.o WHERE t.c <= rq.c + 400")
def net200_area_sequence(spark, sf_dir):
    out = reach.area_sequence(arcs(spark, sf_dir), shut(spark, sf_dir), starts(spark, sf_dir, 500), 8900, 9300, 200, 400.0)
    return out.withColumn("arrival_s", F.round("arrival_s", 5))


# --- waypoints: every 50th node belongs to one of five trips, visited in the order of a mixed key ---


@query(
    tree_sql(50)
    + """, p AS (SELECT node_id // 50 % 5 AS trip, node_id * 7919 % 1009 * 100000 + node_id AS seq, node_id AS node FROM nodes WHERE node_id % 50 = 0),
    l AS (SELECT trip, row_number() OVER w - 1 AS leg, node AS source, lead(node) OVER w AS target FROM p WINDOW w AS (PARTITION BY trip ORDER BY seq)),
    d AS (SELECT l.*, c AS cost FROM l LEFT JOIN tree ON o = source AND n = target WHERE target IS NOT NULL)
    SELECT trip, leg, source, target, round(cost, 5) AS cost, round(CASE WHEN count(*) OVER v = count(cost) OVER v THEN sum(cost) OVER v END, 5) AS total FROM d WINDOW v AS (PARTITION BY trip ORDER BY leg)"""
)
def net204_waypoints(spark, sf_dir):
    k = F.col("node_id")
    points = nodes(spark, sf_dir).where(k % 50 == 0).select((F.floor(k / 50) % 5).alias("trip"), (k * 7919 % 1009 * 100000 + k).alias("seq"), k.alias("node"))
    return reach.waypoint_legs(arcs(spark, sf_dir), points).withColumns({"cost": F.round("cost", 5), "total": F.round("total", 5)})


# --- outlines ---

MARKED = """, ln AS (SELECT origin, a.lon AS lon1, a.lat AS lat1, a.lon + (b.lon - a.lon) * end_fraction AS lon2, a.lat + (b.lat - a.lat) * end_fraction AS lat2 FROM sp JOIN car USING (edge_id) JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node),
dt AS (SELECT *, CAST(ceil(greatest(abs(lon2 - lon1) / 0.02, abs(lat2 - lat1) / 0.02) * 2) + 1 AS BIGINT) AS k FROM ln),
pt AS (SELECT *, unnest(range(0, k + 1)) AS i FROM dt),
cl AS (SELECT DISTINCT origin, CAST(floor((lon1 + (lon2 - lon1) * i / k) / 0.02) AS BIGINT) AS x, CAST(floor((lat1 + (lat2 - lat1) * i / k) / 0.02) AS BIGINT) AS y FROM pt),
dd AS (SELECT unnest([-1, 0, 1]) AS d),
mk AS (SELECT DISTINCT origin, x + a.d AS x, y + b.d AS y FROM cl, dd a, dd b)
"""


def marked(spark, sf_dir):
    a = arcs(spark, sf_dir)
    parts = graph.spans(a, graph.trees(a, starts(spark, sf_dir, 500), 300.0), 300.0).select("origin", "edge_id", "end_fraction")
    n = nodes(spark, sf_dir)
    end = lambda node, i: n.select(F.col("node_id").alias(node), F.col("lon").alias(f"lon{i}"), F.col("lat").alias(f"lat{i}"))
    lines = parts.join(car(spark, sf_dir).select("edge_id", "from_node", "to_node"), "edge_id").join(end("from_node", 1), "from_node").join(end("to_node", 2), "to_node")
    lines = lines.withColumns({c: F.col(f"{c[:3]}1") + (F.col(c) - F.col(f"{c[:3]}1")) * F.col("end_fraction") for c in ("lon2", "lat2")})
    return reach.touched_cells(lines, "origin", 0.02, 0.02)


@query(
    tree_sql(500, 300.0)
    + SPANS
    + MARKED
    + """, sd AS (SELECT * FROM (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) v(c, r, x1, y1, x2, y2))
    SELECT origin, x + x1 AS x1, y + y1 AS y1, x + x2 AS x2, y + y2 AS y2 FROM mk, sd WHERE NOT EXISTS (SELECT 1 FROM mk m WHERE m.origin = mk.origin AND m.x = mk.x + c AND m.y = mk.y + r)"""
)
def net198_outline(spark, sf_dir):
    return reach.boundary(marked(spark, sf_dir), "origin")


@query(tree_sql(500, 300.0) + SPANS + MARKED + "SELECT origin, CAST(count(*) AS DOUBLE) AS area FROM mk GROUP BY origin")
def net198_polygons(spark, sf_dir):
    """The area within each origin's rings, holes taken off."""
    return reach.rings(reach.boundary(marked(spark, sf_dir), "origin"), "origin").groupBy("origin").agg(F.sum("area").alias("area"))


# --- timetables and streets ---

RIDES = f"{STOPS}, {CONNS}, " + rounds_sql("SELECT trip, seq, from_stop, to_stop, departure, arrival FROM cn WHERE to_stop IS NOT NULL", WALKS, "SELECT s_suppkey AS request, s_suppkey AS stop, 9000 + s_suppkey * 31 % 3000 AS arrival FROM supplier", 1, 30, 900)
WITHIN = ", rs AS (SELECT request, r1.stop, r1.arrival, r1.arrival - q.arrival AS elapsed FROM r1 JOIN q USING (request) WHERE r1.arrival - q.arrival <= 700)"


def stops_within(spark, sf_dir):
    conns, walks, asked = timetable(spark, sf_dir)
    return rounds.area(conns, walks, asked, 1, 700, 30, 900)


@query(f"WITH {RIDES}{WITHIN} SELECT * FROM rs")
def net238_transit_area(spark, sf_dir):
    return stops_within(spark, sf_dir)


@query(
    NET + f", {RIDES}{WITHIN}"
    + SEEDED.format(starts="SELECT request AS o, stop * 3 + 5 AS n, CAST(elapsed AS DOUBLE) AS c FROM rs", at="u", to="v", limit=700.0)
    + AREA.format(limit=700.0, at="from_node")
)
def net239_streets_from_stops(spark, sf_dir):
    """Streets that the time left at each stop reaches; a stop is at the node of three times its number and five."""
    at = stops_within(spark, sf_dir).select(F.col("request").alias("origin"), (F.col("stop") * 3 + 5).alias("node"), F.col("elapsed").cast("double").alias("cost"))
    return rounded(reach.seeded_area(arcs(spark, sf_dir), at, 700.0))


# --- live ---


@query(
    f"""WITH u AS (SELECT user_id AS feature_id, event_id % 3 - 1 AS direction, event_id AS seq, ts, 900 + event_id % 5 * 30000 AS ttl_s, event_type AS action FROM events WHERE epoch(ts) < {LIVE_AT} + 1),
    b AS (SELECT feature_id, unnest(CASE WHEN direction = 0 THEN [-1, 1] ELSE [direction] END) AS direction, seq, ts, ttl_s, action FROM u),
    l AS (SELECT feature_id, direction, arg_max(action, seq) AS action, CAST(ceil((floor(epoch(arg_max(ts, seq))) + arg_max(ttl_s, seq)) / 60) * 60 AS BIGINT) AS expires_at FROM b GROUP BY 1, 2)
    SELECT (SELECT max(seq) FROM u) AS version, count(*) AS entries, count(CASE WHEN expires_at > {LIVE_AT} THEN 1 END) AS active FROM l WHERE action <> 'error'"""
)
def net229_traffic_status(spark, sf_dir):
    e, k = events(spark, sf_dir), F.col("event_id")
    action = F.when(F.col("event_type") == "error", "clear").otherwise("speed").alias("action")
    return traffic.status(e.select(F.col("user_id").alias("feature_id"), (k % 3 - 1).alias("direction"), k.alias("seq"), "ts", (900 + k % 5 * 30000).alias("ttl_s"), action, F.col("value").alias("speed")), LIVE_AT)


@query(
    """WITH w AS (SELECT user_id, floor(epoch(ts) / 86400) * 86400 - unnest([0, 86400]) AS s FROM events)
    SELECT user_id, strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n FROM w GROUP BY user_id, s HAVING s + 172800 <= (SELECT max(epoch(ts)) FROM events) - 3600"""
)
def net305_sliding_windows(spark, sf_dir):
    """Closed windows of two days, one a day, of a finished stream with a watermark of an hour."""
    like = table(spark, sf_dir, "events").limit(0)
    stream = live.read_stream(spark, sf_dir, like, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = live.drain(live.sliding_counts(stream, "ts", "user_id", "2 days", "1 day", "1 hour"), "append")
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


# --- conditional tags: texts by edge number, and what they say ---

TAGS = ["no @ (Mo-Fr 07:00-19:00)", "30 @ (22:00-06:00); no @ (weight>7.5)", "no @ (Mo-Fr 07:00-19:00; We 10:00-12:00)", "yes @ (wet)", "broken", "no @ height>3.5 m; no @ (Sa,Su)", "no @ (24/7)"]
SAID = """(0, 0, 'no', 'time', NULL, 3600), (1, 0, '30', 'time', NULL, 3360), (1, 1, 'no', 'vehicle', 7.5, 0), (2, 0, 'no', 'time', NULL, 3000), (3, 0, 'yes', 'unsupported', NULL, 0), (5, 0, 'no', 'vehicle', 3.5, 0), (5, 1, 'no', 'time', NULL, 2880), (6, 0, 'no', 'time', NULL, 10080)"""


@query(f"{NET} SELECT edge_id, pos, value, kind, CAST(above AS DOUBLE) AS above, week_minutes FROM edges JOIN (VALUES {SAID}) v(tag, pos, value, kind, above, week_minutes) ON edge_id % 7 = tag")
def net061_conditional_tags(spark, sf_dir):
    """Each distinct text is read once and joined back."""
    tag = F.element_at(F.array(*map(F.lit, TAGS)), (F.col("edge_id") % 7 + 1).cast("int"))
    rows = edges(spark, sf_dir).select("edge_id", tag.alias("tag"))
    read = rows.select("tag").distinct().select("tag", F.posexplode(schedules.conditional("tag")).alias("pos", "e"))
    span = lambda r: F.bit_count(r["days"].bitwiseAND(F.lit(127))) * F.pmod(r["end_minute"] - r["start_minute"] - 1, F.lit(1440)) + F.bit_count(r["days"].bitwiseAND(F.lit(127)))
    week = F.aggregate("e.rules", F.lit(0).cast("long"), lambda s, r: s + span(r))
    return rows.join(read, "tag").select("edge_id", "pos", "e.value", "e.kind", "e.above", week.alias("week_minutes"))
