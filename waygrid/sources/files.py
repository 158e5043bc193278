"""Readers of files that Spark has no format for: GeoPackage, grids of heights, GeoJSON, OSM XML, zipped feeds.

Files are read through Spark's own binary and text readers, so any store that Spark reaches
will do, and decoded on executors, a file or line at a time.
"""

from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lengths in bytes of a GeoPackage geometry's envelope, by its code.
ENVELOPES = (0, 32, 48, 48, 64)


def lines_of(blob: bytes) -> list[list[tuple[float, float]]]:
    """The lines of a GeoPackage geometry (LineString, MultiLineString, also with z or m); none for other shapes."""
    if blob[:2] != b"GP" or blob[3] & 16:
        return []

    def one(at: int) -> tuple[list[list[tuple[float, float]]], int]:
        order = "<" if blob[at] else ">"
        kind, n = struct.unpack_from(order + "II", blob, at + 1)
        extra = (kind >> 31 & 1) + (kind >> 30 & 1) if kind >= 1 << 29 else {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
        kind, at = kind & 0x1FFFFFFF, at + 9
        if kind % 1000 == 2:
            size = 2 + extra
            flat = struct.unpack_from(f"{order}{n * size}d", blob, at)
            return [list(zip(flat[::size], flat[1::size], strict=True))], at + 8 * n * size
        if kind % 1000 == 5:
            out = []
            for _ in range(n):
                part, at = one(at)
                out += part
            return out, at
        return [], at

    return one(8 + ENVELOPES[blob[3] >> 1 & 7])[0]


def geopackage(spark: SparkSession, path: str, layer: str, columns: str) -> DataFrame:
    """The features of a layer, a row per line: fid, columns (DDL, of the layer's attributes), line (array of lon, lat).

    A file is one task's work, as the format is one database; many files are many tasks.
    """
    names = [c.split()[0] for c in columns.split(",")]
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    ddl = f"fid long, {columns}, line array<struct<lon:double,lat:double>>"
    schema = pa.schema([("fid", pa.int64()), *[(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[c.split()[1]]) for n, c in zip(names, columns.split(","), strict=True)], ("line", pa.list_(pa.struct([("lon", pa.float64()), ("lat", pa.float64())])))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                db = sqlite3.connect(":memory:")
                db.deserialize(content)
                shape = db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (layer,)).fetchone()
                key = next((r[1] for r in db.execute(f"pragma table_info({quoted(layer)})") if r[5]), "rowid")
                found = db.execute(f"select {quoted(key)}, {', '.join(map(quoted, names))}, {quoted(shape[0])} from {quoted(layer)}") if shape else iter(())
                while rows := [r for _, r in zip(range(1000), found, strict=False)]:
                    flat = [(*r[:-1], [{"lon": x, "lat": y} for x, y in line]) for r in rows if r[-1] for line in lines_of(r[-1])]
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in flat], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, ddl)


def ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, height, size) of the cells of an ESRI ASCII grid, by their centres; cells without data are left out."""
    text = spark.read.text(path, wholetext=True).select(F.filter(F.transform(F.split("value", r"[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "").alias("line"))
    header = F.map_from_entries(F.transform(F.filter("line", lambda x: F.regexp_like(x, F.lit("^[A-Za-z]"))), lambda x: F.struct(F.lower(F.split(x, r"\s+")[0]), F.split(x, r"\s+")[1].cast("double"))))
    body = text.select(header.alias("h"), F.posexplode(F.filter("line", lambda x: ~F.regexp_like(x, F.lit("^[A-Za-z]")))).alias("y", "row"))
    cells = body.select("h", "y", F.posexplode(F.split("row", r"\s+")).alias("x", "v")).withColumn("height", F.col("v").cast("double"))
    h = lambda k: F.col("h")[k]
    half = F.when(h("xllcenter").isNotNull(), 0.0).otherwise(0.5)
    west, south = F.coalesce(h("xllcenter"), h("xllcorner")), F.coalesce(h("yllcenter"), h("yllcorner"))
    rows = cells.where(F.col("height") != F.coalesce(h("nodata_value"), F.lit(-9999.0)))
    return rows.select((west + (F.col("x") + half) * h("cellsize")).alias("lon"), (south + (h("nrows") - 1 - F.col("y") + half) * h("cellsize")).alias("lat"), "height", h("cellsize").alias("size"))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties as text, kind, geometry as text) of the features of collections, or of a feature a line."""
    schema = pa.schema([("properties", pa.string()), ("kind", pa.string()), ("geometry", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                try:
                    found = [json.loads(text)]
                except ValueError:
                    found = [json.loads(line) for line in text.splitlines() if line.strip()]
                for x in found:
                    out += [f for f in x.get("features", [x]) if f.get("geometry")]
            yield pa.RecordBatch.from_pylist([{"properties": json.dumps(f.get("properties") or {}), "kind": f["geometry"]["type"], "geometry": json.dumps(f["geometry"]["coordinates"])} for f in out], schema=schema)

    return spark.read.text(path, wholetext=True).mapInArrow(read, "properties string, kind string, geometry string")


def admin_areas(spark: SparkSession, path: str, name: str = "name", level: str = "admin_level") -> DataFrame:
    """(area_id, name, level, ring) of the outer rings of polygons; a multipolygon is several rows with one area_id."""
    rows = geojson(spark, path).where("kind in ('Polygon', 'MultiPolygon')")
    parsed = F.when(F.col("kind") == "Polygon", F.array(F.from_json("geometry", "array<array<array<double>>>"))).otherwise(F.from_json("geometry", "array<array<array<array<double>>>>"))
    rows = rows.select(F.xxhash64("properties", "geometry").alias("area_id"), F.get_json_object("properties", f"$.{name}").alias("name"), F.get_json_object("properties", f"$.{level}").cast("int").alias("level"), F.explode(parsed).alias("polygon"))
    return rows.select("area_id", "name", "level", F.transform(F.col("polygon")[0], lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("ring"))


def points(spark: SparkSession, path: str) -> DataFrame:
    """(id, lon, lat) of a point set, by ending: CSV with a header, JSON array or lines, or GeoJSON."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "geojson":
        rows = geojson(spark, path).where("kind = 'Point'").withColumn("p", F.from_json("geometry", "array<double>"))
        return rows.select(F.get_json_object("properties", "$.id").alias("id"), F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"))
    ddl = "id string, lon double, lat double"
    return spark.read.json(path, schema=ddl, multiLine=True) if kind == "json" else spark.read.csv(path, header=True, schema=ddl)


def od_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, source_lon, source_lat, target_lon, target_lat), from CSV, JSON, or GeoJSON lines from origin to destination."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "geojson":
        rows = geojson(spark, path).where("kind = 'LineString'").withColumn("p", F.from_json("geometry", "array<array<double>>"))
        end = F.element_at("p", -1)
        return rows.select(F.get_json_object("properties", "$.id").alias("id"), F.col("p")[0][0].alias("source_lon"), F.col("p")[0][1].alias("source_lat"), end[0].alias("target_lon"), end[1].alias("target_lat"))
    ddl = "id string, source_lon double, source_lat double, target_lon double, target_lat double"
    return spark.read.json(path, schema=ddl, multiLine=True) if kind == "json" else spark.read.csv(path, header=True, schema=ddl)


def cell_values(spark: SparkSession, path: str) -> DataFrame:
    """(cell, value) of a CSV of cells; a cell that stands there twice counts with its sum."""
    return spark.read.csv(path, header=True, schema="cell long, value double").where("cell is not null").groupBy("cell").agg(F.sum("value").alias("value"))


def tagged_points(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(id, lon, lat, tags) of the nodes of an OSM XML file that carry the tag key."""
    node = "_id long, _lat double, _lon double, tag array<struct<_k:string,_v:string>>"
    rows = spark.read.format("xml").option("rowTag", "node").schema(node).load(path).where("tag is not null")
    tags = F.map_from_entries(F.transform("tag", lambda t: F.struct(t["_k"], t["_v"])))
    return rows.select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), tags.alias("tags")).where(F.col("tags")[key].isNotNull())


def holidays(spark: SparkSession, path: str) -> DataFrame:
    """(region, day) of a calendar of lines ``region:`` and ``- 2026-04-27`` (a YAML mapping of lists of dates)."""
    text = spark.read.text(path, wholetext=True).select(F.split("value", r"[\r\n]+").alias("lines"))
    rows = text.select(F.posexplode("lines").alias("n", "line")).withColumn("head", F.regexp_extract("line", r"^(\w[\w -]*):\s*$", 1))
    from pyspark.sql import Window

    by = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("region", F.last(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(by))
    return rows.select("region", F.to_date(F.nullif(F.regexp_extract("line", r"^\s*-\s*['\"]?([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))).alias("day")).where("day is not null")


def unzipped_feed(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of the text files of zipped feeds, for readers of tables; n counts lines from 0, the header."""
    schema = pa.schema([("file", pa.string()), ("n", pa.int64()), ("line", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith(".txt"):
                            with io.TextIOWrapper(z.open(name), "utf-8-sig", newline=None) as f:
                                held = []
                                for n, line in enumerate(f):
                                    held.append({"file": name.rpartition("/")[2][:-4], "n": n, "line": line.rstrip("\n")})
                                    if len(held) == 10_000:
                                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                                        held = []
                                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "file string, n long, line string")


def feed_table(unzipped: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One table of an unzipped feed: columns as text, null where the file has none of that name."""
    rows = unzipped.where(F.col("file") == name)
    header = rows.where("n = 0").first()
    there = [c.strip() for c in header.line.split(",")] if header else []
    names = ", ".join(f"c{i} string" for i in range(len(there))) or "c0 string"
    parsed = rows.where("n > 0 and trim(line) <> ''").select(F.from_csv("line", names).alias("x"))
    return parsed.select(*[F.col(f"x.c{there.index(c)}").alias(c) if c in there else F.lit(None).cast("string").alias(c) for c in columns])
