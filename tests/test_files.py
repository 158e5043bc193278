import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from waygrid.functions import values
from waygrid.operators import cells, components, relate, summaries
from waygrid.sinks import results
from waygrid.sources import files

LINE = [(6.0, 53.0), (6.1, 53.05), (6.2, 53.0)]


def test_geopackage_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 3, 0.5, LINE), (None, None, None, LINE[:2]), ("no shape", 1, 1.0, None)], "name string, `class` long, w double, line array<struct<lon double, lat double>>")
    path = str(tmp_path / "x.gpkg")
    results.write_geopackage(rows, path, "roads", "line")
    got = files.geopackage(spark, path, "roads", "name string,class long,w double").orderBy("fid").collect()
    assert [(r.name, r["class"], r.w, [tuple(p) for p in r.line]) for r in got] == [("a|b", 3, 0.5, LINE), (None, None, None, LINE[:2])]
    assert files.geopackage(spark, path, "other", "name string").count() == 0


def test_shapes():
    def wkb(kind, pts, order="<"):
        return struct.pack(f"{order}BII", order == "<", kind, len(pts)) + b"".join(struct.pack(f"{order}{len(p)}d", *p) for p in pts)

    head = struct.pack("<2sBBi", b"GP", 0, 1, 4326)
    assert files.lines_of(head + wkb(1002, [(1, 2, 9), (3, 4, 9)])) == [[(1, 2), (3, 4)]]
    many = struct.pack("<BII", 1, 5, 2) + wkb(2, [(1, 2), (3, 4)]) + wkb(2, [(5, 6), (7, 8)], ">")
    assert files.lines_of(head + many) == [[(1, 2), (3, 4)], [(5, 6), (7, 8)]]
    boxed = struct.pack("<2sBBi4d", b"GP", 0, 3, 4326, 0, 1, 0, 1)
    assert files.lines_of(boxed + wkb(2, [(1, 2), (3, 4)])) == [[(1, 2), (3, 4)]]
    assert files.lines_of(head + struct.pack("<BIdd", 1, 1, 1, 2)) == [] and files.lines_of(b"XX") == []


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 6\nyllcorner 53\ncellsize 0.5\nNODATA_value -99\n1 2 3\n4 -99 6\n")
    got = sorted((r.lon, r.lat, r.height) for r in files.ascii_grid(spark, str(tmp_path / "g.asc")).collect())
    assert got == [(6.25, 53.25, 4), (6.25, 53.75, 1), (6.75, 53.75, 2), (7.25, 53.25, 6), (7.25, 53.75, 3)]


def test_json_sources(spark, tmp_path):
    feature = lambda kind, c, **p: {"type": "Feature", "properties": p, "geometry": {"type": kind, "coordinates": c}}
    ring = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("Polygon", [ring], name="A", admin_level="4"), feature("MultiPolygon", [[ring], [[[9, 9], [10, 9], [10, 10]]]], name="B", admin_level=8), feature("Point", [1, 2], id="p"), {"type": "Feature", "geometry": None}]}))
    areas = files.admin_areas(spark, str(tmp_path / "a.geojson"))
    assert sorted((r.name, r.level, len(r.ring)) for r in areas.collect()) == [("A", 4, 5), ("B", 8, 3), ("B", 8, 5)]
    assert [tuple(r) for r in files.points(spark, str(tmp_path / "a.geojson")).collect()] == [("p", 1.0, 2.0)]
    held = relate.in_areas(spark.createDataFrame([(1, 1.0, 1.0), (2, 9.9, 9.5), (3, 8.0, 8.0)], "k int, lon double, lat double"), areas, 2.0)
    assert sorted((r.k, r.name) for r in held.collect()) == [(1, "A"), (1, "B"), (2, "B")]
    (tmp_path / "od.geojson").write_text("\n".join(json.dumps(feature("LineString", [[1, 2], [5, 5], [3, 4]], id=f"o{i}")) for i in range(2)))
    assert sorted(tuple(r) for r in files.od_pairs(spark, str(tmp_path / "od.geojson")).collect()) == [("o0", 1, 2, 3, 4), ("o1", 1, 2, 3, 4)]
    (tmp_path / "p.json").write_text('[{"id": "x", "lon": 1.5, "lat": 2}]')
    assert [tuple(r) for r in files.points(spark, str(tmp_path / "p.json")).collect()] == [("x", 1.5, 2.0)]


def test_small_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("cell,value\n5,1.5\n5,2\n7,1\n,9\n")
    assert sorted(tuple(r) for r in files.cell_values(spark, str(tmp_path / "c.csv")).collect()) == [(5, 3.5), (7, 1.0)]
    (tmp_path / "n.osm").write_text('<osm><node id="1" lat="53" lon="6"><tag k="amenity" v="cafe"/><tag k="name" v="x"/></node><node id="2" lat="53" lon="6"/><node id="3" lat="1" lon="2"><tag k="a" v="b"/></node></osm>')
    assert [(r.id, r.tags["name"]) for r in files.tagged_points(spark, str(tmp_path / "n.osm"), "amenity").collect()] == [(1, "x")]
    (tmp_path / "h.yaml").write_text("nl:\n  - 2026-04-27\n  - '2026-12-25'\nhk:\n  - 2026-02-17\n")
    assert sorted((r.region, str(r.day)) for r in files.holidays(spark, str(tmp_path / "h.yaml")).collect()) == [("hk", "2026-02-17"), ("nl", "2026-04-27"), ("nl", "2026-12-25")]


def test_feed_round_trip(spark, tmp_path):
    stops = spark.createDataFrame([("A", 'a, "b"', 53.0), ("B", None, 53.1)], "stop_id string, stop_name string, stop_lat double")
    results.write_feed({"stops": stops, "trips": spark.createDataFrame([("t",)], "trip_id string")}, str(tmp_path / "f.zip"))
    assert sorted(zipfile.ZipFile(tmp_path / "f.zip").namelist()) == ["stops.txt", "trips.txt"]
    lines = files.unzipped_feed(spark, str(tmp_path / "f.zip"))
    got = files.feed_table(lines, "stops", ["stop_id", "stop_lat", "zone"]).collect()
    assert sorted(tuple(r) for r in got) == [("A", "53.0", None), ("B", "53.1", None)]
    assert files.feed_table(lines, "absent", ["x"]).count() == 0


def test_result_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3.5, LINE)], "origin long, destination long, cost double, line array<struct<lon double, lat double>>")
    for kind in ("csv", "json", "parquet", "geojson"):
        results.write_result(rows, str(tmp_path / f"r.{kind}"), "line")
    assert json.loads(spark.read.text(str(tmp_path / "r.geojson")).first()[0])["properties"] == {"origin": 1, "destination": 2, "cost": 3.5}
    assert spark.read.csv(str(tmp_path / "r.csv"), header=True).first().line.startswith("LINESTRING (6.0 53.0")
    with pytest.raises(ValueError):
        results.write_result(rows, "x.txt")
    results.write_matrix(rows.union(rows.withColumn("origin", F.lit(9)).withColumn("destination", F.lit(7))), str(tmp_path / "m.json"), [1, 9])
    assert sorted((r.destination, r["1"], r["9"]) for r in spark.read.json(str(tmp_path / "m.json")).collect()) == [(2, 3.5, None), (7, None, 3.5)]
    layer = rows.select(cells.cell_at(F.lit(6.3), F.lit(53.2), 6).alias("cell"), F.lit(2.0).alias("value"))
    results.write_cells(layer, str(tmp_path / "c.geojson"), 6)
    ring = json.loads(spark.read.text(str(tmp_path / "c.geojson")).first()[0])["geometry"]["coordinates"][0]
    assert ring[0] == [6.25, 53.0] and ring[2] == [6.5, 53.25] and ring[0] == ring[-1]
    found = results.manifest(spark, str(tmp_path / "m.json.run"), "run", {"rows": rows}, {"k": 1})
    assert json.loads((tmp_path / "m.json.run").read_text()) == found and found["inputs"]["rows"]["rows"] == 1
    text = results.report("Run <1>", {"Part": [("a|b", 1)]})
    assert "| a\\|b | 1 |" in text and "Run &lt;1&gt;" in results.report("Run <1>", {}, True)


def test_guards(spark):
    assert summaries.capped(spark.range(5), 5, "rows").count() == 5
    with pytest.raises(ValueError):
        summaries.capped(spark.range(6), 5, "rows")
    with pytest.raises(ValueError):
        summaries.guarded_matrix(spark.range(3000), spark.range(2000))
    box = spark.createDataFrame([(6.0, 53.0, 7.0, 54.0)], "min_lon double, min_lat double, max_lon double, max_lat double")
    assert cells.cover(box, 7, 64).count() == 64
    with pytest.raises(Exception, match="more than 63 cells"):
        cells.cover(box, 7, 63).count()


def test_cells_come_back(spark):
    fine = spark.range(1).select(F.explode(cells.disk(cells.cell_at(F.lit(6.3), F.lit(53.2), 8), 3)).alias("cell"))
    mixed = fine.limit(1).select(F.lit(7).alias("resolution"), cells.parent(F.col("cell")).alias("cell")).union(fine.select(F.lit(8), "cell"))
    whole = cells.uncompact(mixed, 8)
    assert whole.count() == whole.distinct().count() and fine.join(whole, "cell", "left_anti").count() == 0
    assert whole.groupBy(cells.parent(F.col("cell"))).count().where("count = 4").count() >= 1


def test_times(spark):
    rows = spark.createDataFrame([("2026-07-01T12:00:00Z",), ("2026-07-01T12:00:00",), ("2026-01-01 12:00:00",), ("2026-07-01T12:00:00+05:30",), ("junk",)], "t string")
    got = [r[0] for r in rows.select(F.unix_seconds(values.instant(F.col("t"), "Europe/Amsterdam"))).collect()]
    assert got == [1782907200, 1782900000, 1767265200, 1782887400, None]
    # on the day of a clock change the zero isn't midnight
    zero = spark.range(1).select(*[values.service_zero(F.lit(d).cast("date"), "Europe/Amsterdam") for d in ("2026-03-28", "2026-03-29", "2026-10-25")]).first()
    assert [zero[1] - zero[0], zero[2]] == [82800, 1792882800]


def test_component_errors():
    q = {k: F.lit(1.0) for k in ("time", "distance", "ascent", "descent")}
    for bad in ("", "time * time", "surface == gravel", "time * overlay:a * overlay:b", "time * (a == b", "time * 'x", "time * a b"):
        with pytest.raises(ValueError):
            components.component(bad, q, F.col)
    assert components.merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"b": 5}, "d": {"x": 1}, "e": None}) == {"a": {"b": 5, "c": 2}, "d": {"x": 1}, "e": None}
