"""Writers of results: tables and features by ending, GeoPackage, zipped feeds, reports and manifests."""

from __future__ import annotations

import datetime
import html
import io
import json
import sqlite3
import struct
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cells
from ..operators.summaries import capped
from . import geometry

#: Features that one file of a single-file format may hold; more are refused.
MOST = 250_000


def save_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file, by the file system that the path names."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    out.write(content)
    out.close()


def write_result(rows: DataFrame, path: str, line: str | None = None) -> None:
    """Routes, pairs, matrices, service areas and scores, by ending: geojson (with a line column), csv, json or parquet."""
    kind = path.rpartition(".")[2].lower()
    if kind == "geojson":
        if not line:
            raise ValueError("geojson needs a line column")
        geometry.write_geojson(rows, path, line, *[c for c in rows.columns if c != line])
    elif kind in ("csv", "json", "parquet"):
        geometry.write_table(rows.withColumn(line, geometry.wkt_line(F.col(line))) if line and kind == "csv" else rows, path)
    else:
        raise ValueError(f"no writer for {path!r}")


def write_matrix(costs: DataFrame, path: str, origins: list) -> None:
    """A matrix as a row per destination and a column per origin; pairs without a route stay empty."""
    write_result(costs.groupBy("destination").pivot("origin", origins).agg(F.first("cost")).orderBy("destination"), path)


def cell_polygon(cell: Column, res: int) -> Column:
    """GeoJSON of a cell."""
    size = cells.BASE / (1 << res)
    x, y = cells.x_of(cell) * size, cells.y_of(cell) * size
    corners = F.array(*[F.array(x + i * size, y + j * size) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates")))


def write_cells(layer: DataFrame, path: str, res: int) -> None:
    """A layer (cell and values), as csv or as one GeoJSON feature a line."""
    if path.endswith(".csv"):
        geometry.write_table(layer.orderBy("cell"), path)
        return
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), cell_polygon(F.col("cell"), res), F.lit(',"properties":'), F.to_json(F.struct(*layer.columns)), F.lit("}"))
    layer.select(feature.alias("value")).write.mode("overwrite").text(path)


def write_geopackage(rows: DataFrame, path: str, layer: str, line: str) -> None:
    """One database of the lines and their attributes. The format is a single file, so rows beyond MOST are refused."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}
    plain = [(n, kinds[t]) for n, t in rows.dtypes if n != line]
    db = sqlite3.connect(":memory:")
    quoted = lambda n: '"' + n.replace('"', '""') + '"'
    db.executescript(
        "pragma application_id = 1196444487; pragma user_version = 10300;"
        "create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);"
        "insert into gpkg_spatial_ref_sys values ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', null), ('Undefined geographic', 0, 'NONE', 0, 'undefined', null), ('WGS 84', 4326, 'EPSG', 4326, 'GEOGCS[\"WGS 84\",DATUM[\"WGS_1984\",SPHEROID[\"WGS 84\",6378137,298.257223563]],PRIMEM[\"Greenwich\",0],UNIT[\"degree\",0.0174532925199433]]', null);"
        "create table gpkg_contents (table_name text primary key, data_type text not null, identifier text unique, description text default '', last_change text not null, min_x real, min_y real, max_x real, max_y real, srs_id integer);"
        "create table gpkg_geometry_columns (table_name text not null, column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));"
    )
    db.execute(f"create table {quoted(layer)} (fid integer primary key autoincrement, geom blob" + "".join(f", {quoted(n)} {t}" for n, t in plain) + ")")
    box = None
    for r in capped(rows, MOST, "features").toLocalIterator():
        pts = [(p["lon"], p["lat"]) for p in r[line] or []]
        blob = struct.pack("<2sBBi", b"GP", 0, 1, 4326) + struct.pack("<BII", 1, 2, len(pts)) + b"".join(struct.pack("<dd", *p) for p in pts) if pts else None
        for x, y in pts:
            box = (min(box[0], x), min(box[1], y), max(box[2], x), max(box[3], y)) if box else (x, y, x, y)
        db.execute(f"insert into {quoted(layer)} (geom{''.join(', ' + quoted(n) for n, _ in plain)}) values (?{', ?' * len(plain)})", (blob, *[r[n] for n, _ in plain]))
    db.execute("insert into gpkg_contents values (?, 'features', ?, '', ?, ?, ?, ?, ?, 4326)", (layer, layer, datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"), *(box or (None,) * 4)))
    db.execute("insert into gpkg_geometry_columns values (?, 'geom', 'LINESTRING', 4326, 0, 0)", (layer,))
    db.commit()
    save_bytes(rows.sparkSession, path, db.serialize())


def write_feed(tables: dict[str, DataFrame], path: str) -> None:
    """A zipped feed, a text file per table. Each is streamed to the archive; the archive is built in memory."""
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in tables.items():
            with z.open(f"{name}.txt", "w") as f:
                f.write((",".join(df.columns) + "\n").encode())
                for r in df.select(F.to_csv(F.struct(*df.columns)).alias("line")).toLocalIterator():
                    f.write((r.line + "\n").encode())
    save_bytes(next(iter(tables.values())).sparkSession, path, held.getvalue())


def report(title: str, sections: dict[str, list[tuple[str, object]]], as_html: bool = False) -> str:
    """A run's report: a table of names and values per section, as Markdown or HTML."""
    if as_html:
        body = "".join(f"<h2>{html.escape(s)}</h2><table>" + "".join(f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>" for k, v in rows) + "</table>" for s, rows in sections.items())
        return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{body}"
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    return f"# {title}\n" + "".join(f"\n## {s}\n\n| | |\n|-|-|\n" + "".join(f"| {cell(k)} | {cell(v)} |\n" for k, v in rows) for s, rows in sections.items())


def manifest(spark: SparkSession, path: str, name: str, inputs: dict[str, DataFrame], parameters: dict) -> dict:
    """Writes and returns what a run read (rows, columns and an order-free hash of each input) and its parameters."""
    seen = {}
    for key, df in inputs.items():
        n, mark = df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))).first()
        seen[key] = {"rows": n, "columns": df.columns, "hash": f"{(mark or 0) & (1 << 64) - 1:016x}"}
    out = {"name": name, "inputs": seen, "parameters": parameters}
    save_bytes(spark, path, json.dumps(out, indent=1, sort_keys=True).encode())
    return out
