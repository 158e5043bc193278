"""Geometry encodings and writers. A line is an array of structs (lon, lat)."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def wkt_line(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string"))), ", "), F.lit(")"))


def geojson_line(line: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")))


def geojson_feature(line: Column, *properties: str) -> Column:
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform(line, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


@F.pandas_udf(T.BinaryType())
def wkb_line(lines: pd.Series) -> pd.Series:
    """Little-endian well-known binary."""
    return lines.map(lambda pts: None if pts is None else struct.pack("<BII", 1, 2, len(pts)) + b"".join(struct.pack("<dd", p["lon"], p["lat"]) for p in pts))


def _varint(value: int) -> str:
    value, out = ~(value << 1) if value < 0 else value << 1, []
    while value >= 0x20:
        out.append(chr((0x20 | (value & 0x1F)) + 63))
        value >>= 5
    return "".join(out) + chr(value + 63)


@F.pandas_udf(T.StringType())
def polyline(lines: pd.Series) -> pd.Series:
    """Encoded polyline of precision 5."""

    def one(pts):
        if pts is None:
            return None
        out, before = [], (0, 0)
        for p in pts:
            now = (round(p["lat"] * 1e5), round(p["lon"] * 1e5))
            out += [_varint(now[0] - before[0]), _varint(now[1] - before[1])]
            before = now
        return "".join(out)

    return lines.map(one)


def write_geojson(rows: DataFrame, path: str, line: str, *properties: str) -> None:
    """Newline-delimited features, which any number of tasks can write."""
    rows.select(geojson_feature(F.col(line), *properties).alias("value")).write.mode("overwrite").text(path)


def write_geoparquet(rows: DataFrame, path: str, line: str) -> None:
    """Parquet with a WKB column and the extent and encoding in the column's metadata."""
    box = rows.select(F.explode(line).alias("p")).agg(F.min("p.lon"), F.min("p.lat"), F.max("p.lon"), F.max("p.lat")).first()
    geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": ["LineString"], "bbox": list(box)}}}
    out = rows.withColumn("geometry", wkb_line(F.col(line))).drop(line)
    out.withMetadata("geometry", {"geo": json.dumps(geo)}).write.mode("overwrite").parquet(path)


def write_table(rows: DataFrame, path: str) -> None:
    """By ending: csv, json (lines) or parquet."""
    kind = path.rpartition(".")[2].lower()
    writer = rows.write.mode("overwrite")
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()
