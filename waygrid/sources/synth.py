"""A deterministic street network, timetable and traffic data over the test tables.

Everything is integer arithmetic on keys, so another SQL engine builds the same rows;
``PRELUDE`` is that construction in SQL, for the oracle queries.

Nodes are parts. Node k has a ring edge to k + 1, its reverse, and a chord to 7 k + 3
(modulo the number of parts), so paths are long but the graph is connected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSES = ["motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "track", "ferry", "path", "unknown"]
SURFACES = ["asphalt", "concrete", "paved", "cobble", "gravel", "unpaved", "dirt", "unknown"]
#: Access bits.
CAR, BICYCLE, FOOT = 1, 2, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(names: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (number % len(names) + 1).cast("int"))


def place(k: Column) -> tuple[Column, Column]:
    return F.lit(6.0) + (k * 37 % 1000) / F.lit(1000.0), F.lit(53.0) + (k * 91 % 1000) / F.lit(1000.0)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lon, lat = place(k)
    return table(spark, sf_dir, "part").select(k.alias("node_id"), lon.alias("lon"), lat.alias("lat"), F.col("p_size").cast("double").alias("z"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    rows = part.select((F.col("p_partkey")).alias("k")).join(F.broadcast(n)).withColumn("j", F.explode(F.array(*map(F.lit, (0, 1, 2)))))
    k, n, j = F.col("k"), F.col("n"), F.col("j")
    ring = (k + 1) % n
    return rows.select(
        (k * 3 + j).alias("edge_id"),
        F.when(j == 1, ring).otherwise(k).alias("from_node"),
        F.when(j == 0, ring).when(j == 1, k).otherwise((k * 7 + 3) % n).alias("to_node"),
        F.when(j == 2, k + n).otherwise(k).alias("way_id"),
        (100 + (k * 53 + j * 17) % 900).alias("length_m"),
        ((k * 13 + j * 5) % 40).cast("double").alias("ascent_m"),
        pick(CLASSES, k + F.when(j == 2, 4).otherwise(0)).alias("road_class"),
        pick(SURFACES, F.floor(k / 3).cast("long")).alias("surface"),
        F.when(k % 4 == 0, (30 + 10 * (k % 5)).cast("double")).alias("max_speed_kph"),
        F.when(k % 13 == 5, F.lit(6)).when(k % 7 == 3, F.lit(5)).otherwise(F.lit(7)).alias("access_mask"),
        (k % 17 == 0).alias("is_toll"),
        (k % 19 == 0).alias("signal"),
    )


def names_sql(names: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + "]"


PRELUDE = f"""
WITH RECURSIVE pn AS (SELECT count(*) AS n FROM part),
nodes AS (
  SELECT p_partkey AS node_id, CAST(6.0 AS DOUBLE) + CAST((p_partkey) * 37 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lon,
         CAST(53.0 AS DOUBLE) + CAST((p_partkey) * 91 % 1000 AS DOUBLE) / CAST(1000.0 AS DOUBLE) AS lat, CAST(p_size AS DOUBLE) AS z FROM part
),
pk AS (SELECT p_partkey AS k, n, j FROM part, pn, (SELECT unnest([0, 1, 2]) AS j)),
edges AS (
  SELECT k * 3 + j AS edge_id, CASE WHEN j = 1 THEN (k + 1) % n ELSE k END AS from_node,
         CASE j WHEN 0 THEN (k + 1) % n WHEN 1 THEN k ELSE (k * 7 + 3) % n END AS to_node,
         CASE WHEN j = 2 THEN k + n ELSE k END AS way_id, 100 + (k * 53 + j * 17) % 900 AS length_m,
         CAST((k * 13 + j * 5) % 40 AS DOUBLE) AS ascent_m,
         {names_sql(CLASSES)}[(k + CASE WHEN j = 2 THEN 4 ELSE 0 END) % 11 + 1] AS road_class,
         {names_sql(SURFACES)}[(k // 3) % 8 + 1] AS surface,
         CASE WHEN k % 4 = 0 THEN CAST(30 + 10 * (k % 5) AS DOUBLE) END AS max_speed_kph,
         CASE WHEN k % 13 = 5 THEN 6 WHEN k % 7 = 3 THEN 5 ELSE 7 END AS access_mask,
         k % 17 = 0 AS is_toll, k % 19 = 0 AS signal
  FROM pk
)
"""
