import json
import struct

import pytest
from pyspark.sql import functions as F

from waygrid.operators import assign, cells, graph, transit
from waygrid.sinks import geometry
from waygrid.sources import formats


def test_detect():
    assert [formats.detect(p) for p in ("a.osm.pbf", "x/y.parquet", "dir", "a.GPKG", "c.osc.gz")] == ["osm_pbf", "overture", "overture", "geopackage", "osm_change"]


def test_osm_change(spark, tmp_path):
    (tmp_path / "a.osc").write_text("""<osmChange><create><node id="1" version="1" lat="53" lon="6"/><node id="2" version="1" lat="53.1" lon="6.1"><tag k="a" v="b"/></node></create>
      <modify><node id="1" version="2" lat="54" lon="6"/></modify><delete><node id="3" version="4" lat="0" lon="0"/></delete></osmChange>""")
    changes = formats.osm_changes(spark, str(tmp_path / "a.osc"))
    got = {r.id: (r.action, r.version) for r in changes.collect()}
    assert got == {1: ("modify", 2), 2: ("create", 1), 3: ("delete", 4)}
    base = spark.createDataFrame([(1, 53.0, 6.0), (3, 1.0, 1.0), (9, 2.0, 2.0)], "id long, lat double, lon double")
    assert sorted(tuple(r) for r in formats.apply_changes(base, changes).collect()) == [(1, 54.0, 6.0), (2, 53.1, 6.1), (9, 2.0, 2.0)]


def test_gtfs(spark, tmp_path):
    feed = {
        "stops": "stop_id,stop_name,stop_lat,stop_lon\nA,a,53,6\nB,b,53,6.01\n",
        "routes": "route_id,route_short_name,route_long_name,route_type\nR,1,one,3\n",
        "trips": "route_id,service_id,trip_id,trip_headsign\nR,W,T1,b\n",
        "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT1,25:00:00,25:00:30,A,1\nT1,25:10:00,25:10:00,B,2\n",
        "calendar": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nW,1,0,0,0,0,0,0,20260501,20260531\n",
        "calendar_dates": "service_id,date,exception_type\nW,20260504,2\nW,20260505,1\n",
    }
    for name, text in feed.items():
        (tmp_path / f"{name}.txt").write_text(text)
    t = formats.gtfs(spark, str(tmp_path))
    c = transit.connections(t["stop_times"]).collect()
    assert [(r.from_stop, r.to_stop, r.departure, r.arrival) for r in c] == [("A", "B", 90030, 90600)]
    days = sorted(str(r.day) for r in transit.service_days(t["calendar"], t["calendar_dates"], "2026-05-01", "2026-05-20").collect())
    assert days == ["2026-05-05", "2026-05-11", "2026-05-18"]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, [(-120.2, 38.5), (-120.95, 40.7), (-126.453, 43.252)])], "id long, line array<struct<lon double, lat double>>")
    r = rows.select(geometry.polyline("line").alias("p"), geometry.wkb_line("line").alias("w"), geometry.wkt_line(F.col("line")).alias("t")).first()
    assert r.p == "_p~iF~ps|U_ulLnnqC_mqNvxq`@" and struct.unpack("<BII", bytes(r.w)[:9]) == (1, 2, 3) and r.t.startswith("LINESTRING (-120.2 38.5, ")
    geometry.write_geoparquet(rows, str(tmp_path / "g.parquet"), "line")
    back = spark.read.parquet(str(tmp_path / "g.parquet"))
    assert json.loads(back.schema["geometry"].metadata["geo"])["columns"]["geometry"]["bbox"] == [-126.453, 38.5, -120.2, 43.252]
    geometry.write_geojson(rows, str(tmp_path / "g.json"), "line", "id")
    assert json.loads(spark.read.text(str(tmp_path / "g.json")).first().value)["properties"] == {"id": 1}
    for kind in ("csv", "json", "parquet"):
        geometry.write_table(rows.select("id"), str(tmp_path / f"t.{kind}"))
    assert spark.read.csv(str(tmp_path / "t.csv"), header=True).count() == 1


def test_assignment_is_optimal():
    from itertools import permutations
    from random import Random

    rng = Random(1)
    for n, m in ((1, 1), (3, 3), (3, 5), (5, 3), (4, 4)):
        costs = [[None if rng.random() < 0.3 else float(rng.randint(1, 50)) for _ in range(m)] for _ in range(n)]
        got = assign.optimal_assignment(costs)
        rank = lambda pick: (-sum(c is not None for c in pick), sum(c for c in pick if c is not None))
        slots = [*range(m), *[None] * n]
        best = min(rank([costs[i][j] if j is not None else None for i, j in enumerate(p)]) for p in set(permutations(slots, n)))
        assert rank([costs[i][j] if j is not None else None for i, j in enumerate(got)]) == best


def test_held_karp_is_optimal():
    from itertools import permutations
    from random import Random

    rng = Random(2)
    cost = [[float(rng.randint(1, 99)) for _ in range(7)] for _ in range(7)]
    best = min(sum(cost[a][b] for a, b in zip((0, *p), p, strict=False)) for p in permutations(range(1, 7)))
    total, order = assign.held_karp(cost)
    assert total == best and order[0] == 0 and sorted(order) == list(range(7))


@pytest.fixture(scope="module")
def arcs(spark):
    """A small fixture graph: 0 to 2 goes by 1 at 30 rather than directly at 100."""
    return spark.createDataFrame([(0, 1, 10.0, 0), (1, 2, 20.0, 1), (0, 2, 100.0, 2), (2, 3, None, 3)], "u long, v long, w double, edge_id long")


def test_graph_fixture(spark, arcs):
    origins = spark.createDataFrame([(0, 0)], "origin long, node long")
    want = {(0, 0.0), (1, 10.0), (2, 30.0)}
    assert {(r.node, r.cost) for r in graph.trees(arcs, origins).collect()} == want
    assert {(r.node, r.cost) for r in graph.relax(arcs, origins.withColumn("cost", F.lit(0.0))).collect()} == want
    pairs = spark.createDataFrame([(7, 0, 2)], "pair_id long, source long, target long")
    assert [r.edge_id for r in graph.paths(arcs, pairs).orderBy("step").collect()] == [0, 1]
    spans = graph.spans(arcs, graph.trees(arcs, origins, 20.0), 20.0).collect()
    assert {(r.edge_id, r.end_fraction) for r in spans} == {(0, 1.0), (1, 0.5), (2, 0.2)}


def test_cells(spark):
    rows = spark.range(1).select(cells.cell_at(F.lit(-6.3), F.lit(53.2), 6).alias("c"))
    r = rows.select("c", cells.parent(F.col("c")).alias("p"), cells.cell_at(F.lit(-6.3), F.lit(53.2), 5).alias("q"), F.array_contains(cells.children(cells.parent(F.col("c"))), F.col("c")).alias("k"), F.size(cells.disk(F.col("c"), 2)).alias("n")).first()
    assert r.p == r.q and r.k and r.n == 25
