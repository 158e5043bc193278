"""Order-dependent scans and interval algebra, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coalesce_spans(spans: DataFrame, keys: list[str], start: str, end: str, tolerance: float = 1e-9) -> DataFrame:
    """Overlapping or touching spans of each key as one."""
    by = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(before.isNull() | (F.col(start) > before + tolerance), 1).otherwise(0)).over(by)
    return spans.withColumn("island", island).groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def sessions(rows: DataFrame, key: str, ts: str, gap_s: float) -> DataFrame:
    """rows with segment: a new one (from 0) wherever more than gap_s seconds passed."""
    by = Window.partitionBy(key).orderBy(ts, *[c for c in rows.columns if c.endswith("_id") and c != key])
    late = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(by)) > gap_s * 1e6
    return rows.withColumn("segment", F.sum(F.when(late, 1).otherwise(0)).over(by))


def best_origin(spans: DataFrame, keys: list[str], cost: str, origin: str, tolerance: float = 1e-9) -> DataFrame:
    """Per key the whole span of the origin with the least cost; ties within tolerance go to the smaller origin."""
    by = Window.partitionBy(*keys)
    near = spans.withColumn("least", F.min(cost).over(by)).where(F.col(cost) <= F.col("least") + tolerance)
    return near.withColumn("rank", F.row_number().over(by.orderBy(origin))).where("rank = 1").drop("rank", "least")


def roll_schedule(stops: DataFrame, trip: str, order: str, travel: str, earliest: str, service: str) -> DataFrame:
    """Arrival, wait and departure along each trip: departure = max(arrival, earliest) + service.

    The recurrence is a running maximum: with D the travel and service up to a stop, departure - D
    is the largest of earliest + service - D so far, so no row-by-row state is needed.
    """
    by = Window.partitionBy(trip).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col(travel) + F.col(service)).over(by)
    rows = stops.withColumn("total", total)
    departure = F.greatest(F.max(F.col(earliest) + F.col(service) - F.col("total")).over(by), F.lit(0)) + F.col("total")
    rows = rows.withColumn("departure", departure)
    last = F.coalesce(F.lag("departure").over(Window.partitionBy(trip).orderBy(order)), F.lit(0))
    rows = rows.withColumn("arrival", last + F.col(travel))
    return rows.withColumn("wait", F.greatest(F.col(earliest) - F.col("arrival"), F.lit(0))).drop("total")


def top_per(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def skyline(rows: DataFrame, keys: list[str], cost: str, component: str) -> DataFrame:
    """Rows that no other row of the key beats in one and equals or beats in the other; equal rows all stay."""
    by = Window.partitionBy(*keys).orderBy(cost).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("least", F.min(component).over(Window.partitionBy(*keys, cost)))
    rows = rows.withColumn("so_far", F.min(component).over(by))
    first = F.min(F.when(F.col(component) == F.col("so_far"), F.col(cost))).over(Window.partitionBy(*keys, "so_far"))
    return rows.withColumn("first", first).where((F.col(component) == F.col("least")) & (F.col(component) == F.col("so_far")) & (F.col(cost) == F.col("first"))).drop("least", "so_far", "first")


def difference(bands: DataFrame, keys: list[str], threshold: str, start: str, end: str) -> DataFrame:
    """Ring bands: of nested spans, what each threshold adds to the one before."""
    by = Window.partitionBy(*keys).orderBy(threshold)
    return bands.withColumn(start, F.coalesce(F.lag(end).over(by), F.col(start))).where(F.col(start) < F.col(end))
