"""Readers of the external formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse

#: File endings of the formats.
ENDINGS = {".parquet": "overture", ".geoparquet": "overture", ".gpkg": "geopackage", ".osc": "osm_change", ".osc.gz": "osm_change", ".pbf": "osm_pbf", ".csv": "csv", ".geojson": "geojson"}


def detect(path: str) -> str:
    """The format of a source by its ending; what has none is a folder of Overture files, anything else OSM PBF."""
    name = path.rstrip("/").rpartition("/")[2].lower()
    for ending, kind in sorted(ENDINGS.items(), key=lambda x: -len(x[0])):
        if name.endswith(ending):
            return kind
    return "osm_pbf" if "." in name else "overture"


def od_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id string, source_lon double, source_lat double, target_lon double, target_lat double")


def point_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="id string, lon double, lat double")


def overlay(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema="feature_id long, t_start timestamp, t_end timestamp" + "".join(f", {v} double" for v in values))


def osm_changes(spark: SparkSession, path: str) -> DataFrame:
    """(action, id, version, lat, lon, tags) of an osmChange file's nodes; the last action on an object wins."""
    node = "array<struct<_id:long,_version:int,_lat:double,_lon:double,tag:array<struct<_k:string,_v:string>>>>"
    out = None
    for rank, action in enumerate(("create", "modify", "delete")):
        rows = spark.read.format("xml").option("rowTag", action).schema(f"node {node}").load(path)
        rows = rows.select(F.explode("node").alias("n")).select(F.lit(action).alias("action"), F.lit(rank).alias("rank"), F.col("n._id").alias("id"), F.col("n._version").alias("version"), F.col("n._lat").alias("lat"), F.col("n._lon").alias("lon"), F.transform("n.tag", lambda t: F.concat_ws("=", t["_k"], t["_v"])).alias("tags"))
        out = rows if out is None else out.unionByName(rows)
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("version"), F.desc("rank")))
    return out.withColumn("n", last).where("n = 1").drop("n", "rank")


def apply_changes(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """objects (id, lat, lon) after changes: deleted ones go, created and modified ones are replaced."""
    kept = objects.join(changes.select("id"), "id", "left_anti")
    return kept.unionByName(changes.where("action <> 'delete'").select("id", "lat", "lon"))


GTFS = {
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, trip_headsign string",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
    "calendar_dates": "service_id string, date string, exception_type int",
}


def gtfs(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The feed's tables with seconds for times, dates for dates and arrays for weekdays; columns by header."""
    read = {name: spark.read.option("header", True).option("enforceSchema", False).csv(f"{folder}/{name}.txt") for name in GTFS}
    typed = {name: df.select(*[F.col(c.split()[0]).cast(c.split()[1]) if c.split()[0] in df.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in GTFS[name].split(", ")]) for name, df in read.items()}
    t = typed["stop_times"]
    typed["stop_times"] = t.select(F.col("trip_id").alias("trip"), F.col("stop_sequence").alias("seq"), F.col("stop_id").alias("stop"), parse.gtfs_time_s(F.col("arrival_time")).cast("long").alias("arrival"), parse.gtfs_time_s(F.col("departure_time")).cast("long").alias("departure"))
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    c = typed["calendar"]
    typed["calendar"] = c.select(F.col("service_id").alias("service"), F.to_date("start_date", "yyyyMMdd").alias("start"), F.to_date("end_date", "yyyyMMdd").alias("end"), F.array_compact(F.array(*[F.when(F.col(d) == 1, i) for i, d in enumerate(days)])).alias("weekdays"))
    typed["calendar_dates"] = typed["calendar_dates"].select(F.col("service_id").alias("service"), F.to_date("date", "yyyyMMdd").alias("day"), F.col("exception_type").alias("type"))
    return typed
