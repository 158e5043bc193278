"""Queries on cells, timetables, traffic, intervals, scalars and assignment, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, parse
from ..operators import cells, intervals, joins, traffic, transit
from ..sources.synth import PRELUDE, edges, nodes, table
from .network import HAVERSINE, NET, car
from .registry import query

r6 = lambda c, name: F.round(c, 6).alias(name)
S, O = cells.SHIFT, cells.OFFSET


def customer_points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), (F.lit(6.0) + (k * 37 % 1000) / F.lit(1000.0)).alias("lon"), (F.lit(53.0) + (k * 91 % 997) / F.lit(1000.0)).alias("lat"), F.col("c_acctbal").alias("value"))


CUSTOMERS = "SELECT c_custkey AS point_id, CAST(6.0 AS DOUBLE) + CAST(c_custkey * 37 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lon, CAST(53.0 AS DOUBLE) + CAST(c_custkey * 91 % 997 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lat, c_acctbal AS value FROM customer"


def cell_sql(res: int, lon: str = "lon", lat: str = "lat") -> str:
    size = cells.BASE / (1 << res)
    return f"(CAST(floor({lon} / {size!r}) AS BIGINT) + {O}) * {S} + CAST(floor({lat} / {size!r}) AS BIGINT) + {O}"


@query(f"WITH p AS ({CUSTOMERS}) " + " UNION ALL ".join(f"SELECT {r} AS resolution, {cell_sql(r)} AS cell, count(*) AS n, round(sum(value), 2) AS weight FROM p GROUP BY 2" for r in (4, 6, 8)))
def net121_cell_roll_up(spark, sf_dir):
    return cells.roll_up(customer_points(spark, sf_dir), [4, 6, 8], "value").withColumn("weight", F.round("weight", 2))


@query(f"WITH p AS ({CUSTOMERS}) SELECT {cell_sql(6)} AS cell, round(sum(value), 2) AS value_sum, round(avg(value), 4) AS mean, min(value) AS value_min, max(value) AS value_max, count(*) AS n FROM p GROUP BY 1")
def net123_layer_aggregation(spark, sf_dir):
    layer = cells.aggregate_layer(customer_points(spark, sf_dir), 6, ["value", "value:mean=mean", "value:min", "value:max", ":count=n"])
    return layer.withColumn("value_sum", F.round("value_sum", 2)).withColumn("mean", F.round("mean", 4))


def layer(spark, sf_dir, res=6):
    return cells.aggregate_layer(customer_points(spark, sf_dir), res, ["value:sum=value"])


LAYER = f"WITH p AS ({CUSTOMERS}), layer AS (SELECT {cell_sql(6)} AS cell, sum(value) AS value FROM p GROUP BY 1)"
UP = f"((cell // {S} - {O}) >> 1) + {O}"
PARENT = f"({UP}) * {S} + ((cell % {S} - {O}) >> 1) + {O}"


@query(LAYER + f" SELECT {PARENT} AS cell, round(sum(value), 2) AS value FROM layer GROUP BY 1")
def net122_resample_up(spark, sf_dir):
    return cells.resample_up(layer(spark, sf_dir), 1, "value").withColumn("value", F.round("value", 2))


@query(LAYER + f", k AS (SELECT unnest([0, 1]) AS d) SELECT ((cell // {S} - {O}) * 2 + a.d + {O}) * {S} + (cell % {S} - {O}) * 2 + b.d + {O} AS cell, round(value / 4, 4) AS value FROM layer, k a, k b")
def net122_resample_down(spark, sf_dir):
    return cells.resample_down(layer(spark, sf_dir), "value").withColumn("value", F.round("value", 4))


NODE_CELLS = f"nc AS (SELECT DISTINCT {cell_sql(6)} AS cell FROM nodes)"


@query(PRELUDE + ", " + NODE_CELLS + f", p AS ({CUSTOMERS}), layer AS (SELECT {cell_sql(6)} AS cell, sum(value) AS value FROM p GROUP BY 1) SELECT cell, round(CASE WHEN nc.cell IS NULL THEN value ELSE coalesce(value, 0) + 10 END, 2) AS value FROM layer FULL JOIN nc USING (cell)")
def net125_paint(spark, sf_dir):
    hit = nodes(spark, sf_dir).select(cells.cell_at(F.col("lon"), F.col("lat"), 6).alias("cell"))
    return cells.paint(layer(spark, sf_dir), hit, "add", 10.0, "value").withColumn("value", F.round("value", 2))


@query(LAYER + ", newer AS (SELECT cell, CAST(count(*) AS DOUBLE) AS value FROM (SELECT " + cell_sql(6) + " AS cell FROM p WHERE point_id % 3 = 0) GROUP BY 1) SELECT cell, round(coalesce(newer.value, layer.value), 2) AS value FROM layer FULL JOIN newer USING (cell)")
def net124_merge(spark, sf_dir):
    new = customer_points(spark, sf_dir).where("point_id % 3 = 0").groupBy(cells.cell_at(F.col("lon"), F.col("lat"), 6).alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return cells.merge(layer(spark, sf_dir), new, "value").withColumn("value", F.round("value", 2))


@query(LAYER + " SELECT count(*) AS n, round(sum(value), 2) AS total, round(min(value), 2) AS low, round(max(value), 2) AS high FROM layer")
def net126_layer_summary(spark, sf_dir):
    v = F.col("value")
    return layer(spark, sf_dir).agg(F.count(v).alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.min(v), 2).alias("low"), F.round(F.max(v), 2).alias("high"))


@query(
    PRELUDE
    + f""", nc AS (SELECT {cell_sql(6)} AS cell, count(*) AS n_nodes FROM nodes GROUP BY 1),
    ec AS (SELECT {cell_sql(6, "(a.lon + b.lon) / 2", "(a.lat + b.lat) / 2")} AS cell, count(*) AS n_edges, CAST(sum(length_m) AS BIGINT) AS length_m FROM edges JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node GROUP BY 1)
    SELECT cell, coalesce(n_nodes, 0) AS n_nodes, coalesce(n_edges, 0) AS n_edges, coalesce(length_m, 0) AS length_m FROM nc FULL JOIN ec USING (cell)"""
)
def net127_network_per_cell(spark, sf_dir):
    n = nodes(spark, sf_dir)
    end = lambda s: n.select(F.col("node_id").alias(f"{s}_node"), F.col("lon").alias(f"{s}_lon"), F.col("lat").alias(f"{s}_lat"))
    e = edges(spark, sf_dir).join(end("from"), "from_node").join(end("to"), "to_node")
    middle = cells.cell_at((F.col("from_lon") + F.col("to_lon")) / 2, (F.col("from_lat") + F.col("to_lat")) / 2, 6)
    by_edge = e.groupBy(middle.alias("cell")).agg(F.count(F.lit(1)).alias("n_edges"), F.sum("length_m").alias("length_m"))
    by_node = n.groupBy(cells.cell_at(F.col("lon"), F.col("lat"), 6).alias("cell")).agg(F.count(F.lit(1)).alias("n_nodes"))
    return by_node.join(by_edge, "cell", "full_outer").fillna(0, ["n_nodes", "n_edges", "length_m"])


@query(PRELUDE + f", c AS (SELECT DISTINCT {cell_sql(8)} AS cell FROM nodes), u AS (SELECT cell, {PARENT} AS up FROM c), f AS (SELECT up FROM u GROUP BY up HAVING count(*) = 4) SELECT up AS cell, true AS is_parent FROM f UNION ALL SELECT cell, false FROM u WHERE up NOT IN (SELECT up FROM f)")
def net172_compaction(spark, sf_dir):
    return cells.compact(nodes(spark, sf_dir).select(cells.cell_at(F.col("lon"), F.col("lat"), 8).alias("cell")))


@query(
    f"""WITH p AS ({CUSTOMERS}), d AS (SELECT {cell_sql(5)} AS cell, CAST(count(*) AS DOUBLE) AS value FROM p GROUP BY 1), s AS (SELECT {cell_sql(5)} AS cell, CAST(count(*) AS DOUBLE) AS value FROM p WHERE point_id % 3 = 1 GROUP BY 1),
    k AS (SELECT unnest([-1, 0, 1]) AS d), sd AS (SELECT cell + a.d * {S} + b.d AS cell, sum(value * CASE WHEN a.d = 0 AND b.d = 0 THEN 1.0 ELSE 0.5 END / 5.0) AS v FROM d, k a, k b GROUP BY 1),
    ss AS (SELECT cell + a.d * {S} + b.d AS cell, sum(value * CASE WHEN a.d = 0 AND b.d = 0 THEN 1.0 ELSE 0.5 END / 5.0) AS v FROM s, k a, k b GROUP BY 1),
    o AS (SELECT cell FROM d UNION SELECT cell FROM s), r AS (SELECT o.cell, coalesce(sd.v, 0) / greatest(coalesce(ss.v, 0), 0.5) AS ratio FROM o LEFT JOIN sd USING (cell) LEFT JOIN ss USING (cell))
    SELECT cell, round(ratio, 6) AS ratio, round(least(3.0, greatest(1.0, round((1 + 0.5 * (ratio / 2.0 - 1)) / 0.1) * 0.1)), 6) AS multiplier FROM r"""
)
def net137_surge(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    count = lambda rows: rows.groupBy(cells.cell_at(F.col("lon"), F.col("lat"), 5).alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    out = cells.surge(count(p), count(p.where("point_id % 3 = 1")), 1, 0.5, 2.0, 0.5, 0.1, 1.0, 3.0, 0.5)
    return out.select("cell", r6("ratio", "ratio"), r6("multiplier", "multiplier"))


# --- timetable: an order is a trip, a line number a stop of it ---

STOPS = "st AS (SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_suppkey) AS stop, min(l_linenumber) * 300 + l_orderkey * 37 % 40000 AS arrival FROM lineitem GROUP BY 1, 2), stp AS (SELECT trip, seq, stop, arrival, arrival + 30 AS departure FROM st)"
CONNS = "cn AS (SELECT trip, seq, stop AS from_stop, lead(stop) OVER w AS to_stop, departure, lead(arrival) OVER w AS arrival FROM stp WINDOW w AS (PARTITION BY trip ORDER BY seq))"


def stop_times(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(F.min("l_suppkey").alias("stop"))
    arrival = F.col("seq") * 300 + F.col("trip") * 37 % 40000
    return rows.select("trip", "seq", "stop", arrival.alias("arrival"), (arrival + 30).alias("departure"))


@query(f"WITH {STOPS}, {CONNS} SELECT * FROM cn WHERE to_stop IS NOT NULL")
def net014_connections(spark, sf_dir):
    return transit.connections(stop_times(spark, sf_dir))


@query(f"WITH {STOPS}, pt AS (SELECT trip, trip % 10 AS route, string_agg(CAST(stop AS VARCHAR), '>' ORDER BY seq) AS pattern FROM stp GROUP BY 1, 2) SELECT route, pattern, count(*) AS n_trips FROM pt GROUP BY 1, 2")
def net144_route_patterns(spark, sf_dir):
    return transit.patterns(stop_times(spark, sf_dir).withColumn("route", F.col("trip") % 10), "route")


@query(
    f"""WITH {STOPS}, x AS (SELECT trip, seq, stop, CASE WHEN seq % 3 <> 2 THEN arrival END AS arrival, CASE WHEN seq % 3 <> 2 THEN departure END AS departure, row_number() OVER (PARTITION BY trip ORDER BY seq) AS n FROM stp),
    y AS (SELECT a.trip, a.seq, a.stop, a.arrival, a.departure, a.n, arg_max(b.departure, b.n) FILTER (b.n <= a.n AND b.arrival IS NOT NULL) AS t0, max(b.n) FILTER (b.n <= a.n AND b.arrival IS NOT NULL) AS n0,
      arg_min(b.arrival, b.n) FILTER (b.n >= a.n AND b.arrival IS NOT NULL) AS t1, min(b.n) FILTER (b.n >= a.n AND b.arrival IS NOT NULL) AS n1 FROM x a JOIN x b ON a.trip = b.trip GROUP BY ALL)
    SELECT trip, seq, stop, coalesce(arrival, CAST(floor(t0 + (t1 - t0) * (n - n0) / nullif(n1 - n0, 0)) AS BIGINT)) AS arrival, coalesce(departure, CAST(floor(t0 + (t1 - t0) * (n - n0) / nullif(n1 - n0, 0)) AS BIGINT)) AS departure FROM y"""
)
def net016_missing_times(spark, sf_dir):
    rows = stop_times(spark, sf_dir)
    known = F.col("seq") % 3 != 2
    return transit.fill_times(rows.withColumn("arrival", F.when(known, F.col("arrival"))).withColumn("departure", F.when(known, F.col("departure"))))


@query(
    """WITH cal AS (SELECT n_nationkey AS service, DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS s, DATE '2024-02-15' AS e FROM nation),
    days AS (SELECT service, CAST(unnest(generate_series(greatest(s, DATE '2024-01-10'), least(e, DATE '2024-02-10'), INTERVAL 1 DAY)) AS DATE) AS day FROM cal),
    ok AS (SELECT service, day FROM days WHERE (isodow(day) - 1) IN (service % 7, (service + 2) % 7, (service + 4) % 7)),
    ad AS (SELECT service, DATE '2024-01-20' AS day FROM cal WHERE service % 4 = 0), re AS (SELECT service, DATE '2024-01-15' + CAST(service AS INTEGER) AS day FROM cal),
    fin AS (SELECT service, day FROM (SELECT * FROM ok UNION SELECT * FROM ad) EXCEPT SELECT service, day FROM re) SELECT service, CAST(day AS VARCHAR) AS day FROM fin"""
)
def net015_service_days(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("service"))
    k = F.col("service")
    cal = n.select("service", F.date_add(F.lit("2024-01-01").cast("date"), k).alias("start"), F.lit("2024-02-15").cast("date").alias("end"), F.array(k % 7, (k + 2) % 7, (k + 4) % 7).alias("weekdays"))
    extra = n.where("service % 4 = 0").select("service", F.lit("2024-01-20").cast("date").alias("day"), F.lit(1).alias("type")).unionByName(n.select("service", F.date_add(F.lit("2024-01-15").cast("date"), k).alias("day"), F.lit(2).alias("type")))
    return transit.service_days(cal, extra, "2024-01-10", "2024-02-10").withColumn("day", F.col("day").cast("string"))


@query("WITH t AS (SELECT p_partkey AS trip, p_partkey * 60 % 3600 AS s, p_partkey * 60 % 3600 + 1900 AS e, 300 + p_partkey % 5 * 60 AS h FROM part), x AS (SELECT trip, s, h, unnest(generate_series(s, e - 1, h)) AS a FROM t) SELECT trip, CAST((a - s) // h AS INTEGER) AS run, a - s AS shift FROM x")
def net014_frequency_runs(spark, sf_dir):
    k = F.col("p_partkey")
    trips = table(spark, sf_dir, "part").select(k.alias("trip"), (k * 60 % 3600).alias("start"), (k * 60 % 3600 + 1900).alias("end"), (300 + k % 5 * 60).alias("headway"))
    return transit.expand_frequencies(trips)


@query(f"WITH {STOPS}, {CONNS}, q AS (SELECT s_suppkey AS from_stop, 8000 + s_suppkey * 97 % 20000 AS t FROM supplier) SELECT q.from_stop, t AS departure, min(cn.departure) AS next_departure FROM q LEFT JOIN cn ON cn.from_stop = q.from_stop AND cn.departure >= t AND to_stop IS NOT NULL GROUP BY 1, 2")
def net117_next_departure(spark, sf_dir):
    k = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(k.alias("from_stop"), (8000 + k * 97 % 20000).alias("departure"))
    conns = transit.connections(stop_times(spark, sf_dir)).select("from_stop", "departure", F.col("departure").alias("next_departure"))
    return joins.next_of(asked, conns, "from_stop", "departure", "next_departure")


@query(f"WITH {STOPS}, {CONNS}, l AS (SELECT *, trip % 50 AS journey FROM cn WHERE to_stop IS NOT NULL), o AS (SELECT journey, trip, row_number() OVER (PARTITION BY journey ORDER BY trip, seq) AS seq, from_stop, to_stop FROM l) SELECT journey, trip, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(from_stop, seq) AS from_stop, arg_max(to_stop, seq) AS to_stop FROM o GROUP BY 1, 2")
def net148_leg_coalescing(spark, sf_dir):
    from pyspark.sql import Window

    rows = transit.connections(stop_times(spark, sf_dir)).withColumn("journey", F.col("trip") % 50)
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("journey").orderBy("trip", "seq")))
    return transit.legs(rows, "journey").select("journey", "trip", F.col("first_seq").cast("long"), F.col("last_seq").cast("long"), "from_stop", "to_stop")


@query()
def net230_earliest_arrivals(spark, sf_dir):
    k = F.col("s_suppkey")
    asked = table(spark, sf_dir, "supplier").select(k.alias("request"), k.alias("stop"), (9000 + k * 31 % 3000).alias("departure"))
    return transit.earliest_arrivals(transit.connections(stop_times(spark, sf_dir)), asked, 30)


# --- traffic: events are probe speeds ---


def events(spark, sf_dir):
    """The table's times have no zone; here they are UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def probes(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", "ts", (F.col("user_id") * 3).alias("edge_id"), F.col("event_type"), F.col("value"))


@query("SELECT event_id, CAST(((isodow(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts)) // 30 AS INTEGER) AS bucket, strftime(ts, '%a ') || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':' || CASE WHEN minute(ts) < 30 THEN '00' ELSE '30' END AS label FROM events")
def net281_time_of_week(spark, sf_dir):
    b = parse.bucket_of_week(F.col("ts"), 30)
    return probes(spark, sf_dir).select("event_id", b.alias("bucket"), parse.bucket_label(b, 30).alias("label"))


@query(NET + ", sp AS (SELECT user_id * 3 AS edge_id, avg(value) AS kph FROM events WHERE value > 0 GROUP BY 1), x AS (SELECT car.*, CASE WHEN kph > 0 AND length_m > 0 AND road_class <> 'ferry' THEN kph / 3.6 * time_s / length_m ELSE 1.0 END AS phi FROM car LEFT JOIN sp USING (edge_id) WHERE cost IS NOT NULL) SELECT edge_id, round(time_s / phi, 4) AS time_s, round(greatest(0.0, cost + 0.5 * (time_s / phi - time_s)), 4) AS cost FROM x")
def net223_bucket_metric(spark, sf_dir):
    speeds = probes(spark, sf_dir).where("value > 0").groupBy("edge_id").agg(F.avg("value").alias("speed_kph"))
    out = traffic.bucket_metric(car(spark, sf_dir).where("cost is not null"), speeds, time_weight=0.5)
    return out.select("edge_id", F.round("time_s", 4).alias("time_s"), F.round("cost", 4).alias("cost"))


@query("WITH b AS (SELECT hour(ts) AS bucket, user_id % 3 AS key, count(*) % 2 AS speed FROM events GROUP BY 1, 2), c AS (SELECT bucket, string_agg(key || ':' || speed, ',' ORDER BY key) AS col FROM b GROUP BY 1) SELECT bucket, min(bucket) OVER (PARTITION BY col) AS representative FROM c")
def net135_bucket_classes(spark, sf_dir):
    e = events(spark, sf_dir).groupBy(F.hour("ts").alias("bucket"), (F.col("user_id") % 3).alias("key")).agg((F.count(F.lit(1)) % 2).alias("speed"))
    return traffic.bucket_classes(e).select(F.col("bucket").cast("long"), F.col("representative").cast("long"))


LIVE_AT = 1704412800  # 2024-01-05 00:00 UTC


@query(
    f"""WITH u AS (SELECT user_id AS feature_id, event_id % 3 - 1 AS direction, event_id AS seq, ts, 900 + event_id % 5 * 30000 AS ttl_s, event_type AS action, value AS speed FROM events),
    b AS (SELECT feature_id, unnest(CASE WHEN direction = 0 THEN [-1, 1] ELSE [direction] END) AS direction, seq, ts, ttl_s, CASE action WHEN 'error' THEN 'clear' ELSE 'speed' END AS action, speed FROM u WHERE epoch(ts) < {LIVE_AT} + 1),
    l AS (SELECT feature_id, direction, arg_max(action, seq) AS action, arg_max(speed, seq) AS speed, CAST(ceil((floor(epoch(arg_max(ts, seq))) + arg_max(ttl_s, seq)) / 60) * 60 AS BIGINT) AS expires_at FROM b GROUP BY 1, 2)
    SELECT feature_id, direction, action, speed, expires_at FROM l WHERE action <> 'clear' AND expires_at > {LIVE_AT}"""
)
def net224_live_updates(spark, sf_dir):
    e = events(spark, sf_dir)
    u = e.select(F.col("user_id").alias("feature_id"), (F.col("event_id") % 3 - 1).alias("direction"), F.col("event_id").alias("seq"), "ts", (900 + F.col("event_id") % 5 * 30000).alias("ttl_s"), F.when(F.col("event_type") == "error", "clear").otherwise("speed").alias("action"), F.col("value").alias("speed"))
    return traffic.apply_live(u, LIVE_AT)


@query("SELECT event_id FROM events WHERE ((isodow(ts) - 1) IN (0, 2, 4) AND hour(ts) * 60 + minute(ts) >= 1320) OR ((isodow(ts) + 5) % 7 IN (0, 2, 4) AND hour(ts) * 60 + minute(ts) < 360)")
def net215_rule_activity(spark, sf_dir):
    return probes(spark, sf_dir).where(traffic.rule_active(F.col("ts"), 0b10101, 1320, 360)).select("event_id")


@query("WITH o AS (SELECT user_id, event_id AS oid, ts, value FROM events WHERE event_type = 'purchase') SELECT e.event_id, (SELECT o.value FROM o WHERE o.user_id = e.user_id AND o.ts <= e.ts ORDER BY o.ts DESC, o.oid DESC LIMIT 1) AS price FROM events e WHERE event_type = 'view'")
def net111_as_of_join(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("price"))
    return joins.as_of(left, right, "user_id", "ts", "price").select("event_id", "price")


@query("WITH o AS (SELECT user_id, event_id AS overlay_id, epoch(ts) AS s, epoch(ts) + 3600 * (1 + event_id % 6) AS e FROM events WHERE event_type = 'purchase') SELECT x.event_id, o.overlay_id FROM events x JOIN o ON o.user_id = x.user_id AND o.s <= epoch(x.ts) AND epoch(x.ts) < o.e WHERE event_type = 'click'")
def net112_overlay_interval_join(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("at", F.unix_micros("ts") / 1e6)
    left = e.where("event_type = 'click'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("overlay_id"), F.col("at").alias("s"), (F.col("at") + 3600 * (1 + F.col("event_id") % 6)).alias("e"))
    return joins.in_interval(left, right, "user_id", "at", "s", "e", 7200.0).select("event_id", "overlay_id")


@query("WITH g AS (SELECT user_id, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 21600000000 THEN 1 ELSE 0 END AS nw, ts FROM events) SELECT user_id, event_id, CAST(sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS segment FROM g")
def net152_trace_segmentation(spark, sf_dir):
    e = events(spark, sf_dir).select("user_id", "event_id", "ts")
    return intervals.sessions(e, "user_id", "ts", 6 * 3600).select("user_id", "event_id", "segment")


@query(
    """WITH s AS (SELECT l_suppkey AS k, CAST(l_linenumber * 10 + l_orderkey % 500 AS DOUBLE) AS a, CAST(l_linenumber * 10 + l_orderkey % 500 + l_quantity / 10 AS DOUBLE) AS b FROM lineitem),
    m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
    i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT k, round(min(a), 6) AS a, round(max(b), 6) AS b FROM i GROUP BY k, island"""
)
def net149_interval_coalescing(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a = (F.col("l_linenumber") * 10 + F.col("l_orderkey") % 500).cast("double")
    return intervals.coalesce_spans(l.select(F.col("l_suppkey").alias("k"), a.alias("a"), (a + F.col("l_quantity") / 10).alias("b")), ["k"], "a", "b").select("k", r6("a", "a"), r6("b", "b"))


@query(
    """WITH RECURSIVE s AS (SELECT l_orderkey AS trip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS o, CAST(l_quantity AS BIGINT) AS tr, l_linenumber * 40 AS ea, 5 AS sv FROM lineitem),
    r AS (SELECT trip, o, tr AS arrival, greatest(CAST(ea - tr AS BIGINT), 0) AS wait, greatest(tr, CAST(ea AS BIGINT)) + sv AS departure FROM s WHERE o = 1
      UNION ALL SELECT s.trip, s.o, r.departure + s.tr, greatest(s.ea - r.departure - s.tr, 0), greatest(r.departure + s.tr, s.ea) + s.sv FROM r JOIN s ON s.trip = r.trip AND s.o = r.o + 1)
    SELECT trip, o AS seq, arrival, wait, departure FROM r"""
)
def net151_schedule_roll(spark, sf_dir):
    from pyspark.sql import Window

    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    rows = l.select(F.col("l_orderkey").alias("trip"), seq.alias("seq"), F.col("l_quantity").cast("long").alias("tr"), (F.col("l_linenumber") * 40).cast("long").alias("ea"), F.lit(5).cast("long").alias("sv"))
    return intervals.roll_schedule(rows, "trip", "seq", "tr", "ea", "sv").select("trip", "seq", "arrival", "wait", "departure")


@query("WITH s AS (SELECT l_partkey AS feature_id, l_returnflag AS grp, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2) SELECT grp, feature_id, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, feature_id) AS rk FROM s) WHERE rk <= 10")
def net160_top_k_features(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature_id"), F.col("l_returnflag").alias("grp")).agg(F.sum("l_quantity").alias("score"))
    return intervals.top_per(s, ["grp"], [F.desc("score"), "feature_id"], 10).select("grp", "feature_id", "score")


@query("WITH b AS (SELECT user_id AS edge_id, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS bin, count(*) AS entered, round(avg(value), 4) AS mean_value FROM events GROUP BY 1, 2) SELECT * FROM b")
def net139_edge_bins(spark, sf_dir):
    e = events(spark, sf_dir)
    bin_ = (F.floor(F.unix_seconds("ts") / 21600) * 21600).cast("long")
    return e.groupBy(F.col("user_id").alias("edge_id"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("entered"), F.round(F.avg("value"), 4).alias("mean_value"))


@query(PRELUDE + f"SELECT e.edge_id, round({HAVERSINE.format(lat1='a.lat', lat2='b.lat', lon1='a.lon', lon2='b.lon')}, 4) AS flat_m, round(sqrt(pow({HAVERSINE.format(lat1='a.lat', lat2='b.lat', lon1='a.lon', lon2='b.lon')}, 2) + pow(b.z - a.z, 2)), 4) AS slant_m FROM edges e JOIN nodes a ON a.node_id = from_node JOIN nodes b ON b.node_id = to_node")
def net268_geodesy(spark, sf_dir):
    n = nodes(spark, sf_dir)
    end = lambda s: n.select(F.col("node_id").alias(f"{s}_node"), *[F.col(c).alias(f"{s}_{c}") for c in ("lon", "lat", "z")])
    c = F.col
    rows = edges(spark, sf_dir).join(end("from"), "from_node").join(end("to"), "to_node")
    flat = geo.haversine(c("from_lon"), c("from_lat"), c("to_lon"), c("to_lat"))
    slant = geo.distance_3d(c("from_lon"), c("from_lat"), c("from_z"), c("to_lon"), c("to_lat"), c("to_z"))
    return rows.select("edge_id", F.round(flat, 4).alias("flat_m"), F.round(slant, 4).alias("slant_m"))


@query(PRELUDE + "SELECT node_id, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / 3.141592653589793) / 2 * 4096) AS BIGINT) AS y FROM nodes")
def net294_tile_projection(spark, sf_dir):
    x, y = geo.tile(F.col("lon"), F.col("lat"), 12)
    return nodes(spark, sf_dir).select("node_id", x.alias("x"), y.alias("y"))


@query("SELECT p_partkey AS id, round(CASE p_partkey % 4 WHEN 0 THEN p_size * 1e0 WHEN 1 THEN p_size * 1.609344e0 WHEN 2 THEN p_size * 1.852e0 END, 6) AS kph FROM part")
def net275_parse_maxspeed(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("", " mph", " knots", " furlongs"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(parse.maxspeed_kph(text), 6).alias("kph"))


@query("SELECT l_orderkey AS trip, l_linenumber AS seq, min(l_quantity * 3600 + l_linenumber * 60 + 7) AS s FROM lineitem GROUP BY 1, 2")
def net279_gtfs_times(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    text = F.concat_ws(":", F.col("l_quantity").cast("int").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("07"))
    return l.groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq")).agg(F.min(parse.gtfs_time_s(text)).cast("double").alias("s"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def net282_attribute_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parse.attribute_name(F.concat("p_type", F.lit(" / "), "p_brand")).alias("name"))


@query("WITH s AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey % 20) AS e FROM lineitem GROUP BY 1) SELECT a.o AS a, b.o AS b, round(1 - len(list_intersect(a.e, b.e)) / len(list_distinct(list_concat(a.e, b.e))), 6) AS distance FROM s a JOIN s b ON b.o = a.o + 1")
def net285_jaccard_distance(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.collect_set(F.col("l_suppkey") % 20).alias("e"))
    a, b = s.select(F.col("o").alias("a"), F.col("e").alias("x")), s.select((F.col("o") - 1).alias("a"), F.col("o").alias("b"), F.col("e").alias("y"))
    return a.join(b, "a").select("a", "b", r6(1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), "distance"))


@query("SELECT o_orderkey AS ride, round(greatest(8e0, (3e0 + 1.2e0 * o_totalprice / 10000 + 0.3e0 * (o_orderkey % 40)) * CASE WHEN o_orderpriority LIKE '1%' THEN 1.5e0 ELSE 1e0 END) * (1 + o_orderkey % 3 * 0.25e0), 8) AS fare FROM orders")
def net293_fares(spark, sf_dir):
    k = F.col("o_orderkey")
    base = (3.0 + 1.2 * F.col("o_totalprice") / 10000 + 0.3 * (k % 40)) * F.when(F.col("o_orderpriority").startswith("1"), 1.5).otherwise(1.0)
    return table(spark, sf_dir, "orders").select(k.alias("ride"), F.round(F.greatest(F.lit(8.0), base) * (1 + k % 3 * 0.25), 8).alias("fare"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def net296_json_attributes(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(NET + ", t AS (SELECT edge_id, cost, cost * CASE WHEN edge_id % 4 = 0 THEN 1.8 WHEN edge_id % 4 = 1 THEN 0.9 ELSE 1.0 END AS changed FROM car WHERE cost IS NOT NULL) SELECT count(*) AS n_edges, count(CASE WHEN changed > cost + 1e-9 THEN 1 END) AS n_worse, count(CASE WHEN changed < cost - 1e-9 THEN 1 END) AS n_better, round(sum(abs(changed - cost)), 4) AS l1 FROM t")
def net141_scenario_difference(spark, sf_dir):
    k = F.col("edge_id")
    rows = car(spark, sf_dir).where("cost is not null").withColumn("changed", F.col("cost") * F.when(k % 4 == 0, 1.8).when(k % 4 == 1, 0.9).otherwise(1.0))
    worse, better = F.col("changed") > F.col("cost") + 1e-9, F.col("changed") < F.col("cost") - 1e-9
    return rows.agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(worse, 1)).alias("n_worse"), F.count(F.when(better, 1)).alias("n_better"), F.round(F.sum(F.abs(F.col("changed") - F.col("cost"))), 4).alias("l1"))


@query("WITH s AS (SELECT CASE WHEN o_totalprice < 100000 THEN 'short' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'long' END AS bucket, o_totalprice AS ms FROM orders) SELECT bucket, count(*) AS n, round(quantile_cont(ms, 0.5), 4) AS p50, round(quantile_cont(ms, 0.95), 4) AS p95, max(ms) AS worst FROM s GROUP BY bucket")
def net142_latency_summary(spark, sf_dir):
    ms = F.col("o_totalprice")
    bucket = F.when(ms < 100000, "short").when(ms < 300000, "medium").otherwise("long")
    return table(spark, sf_dir, "orders").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile(ms, 0.5), 4).alias("p50"), F.round(F.percentile(ms, 0.95), 4).alias("p95"), F.max(ms).alias("worst"))
