"""Historical and live traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_metric(edges: DataFrame, speeds: DataFrame, slow_down_only: bool = False, time_weight: float = 1.0) -> DataFrame:
    """edges (edge_id, length_m, time_s, cost) with time and cost under speeds (edge_id, speed_kph):
    phi = speed / profile speed, time' = time / phi, cost' = max(0, cost + time_weight * (time' - time))."""
    rows = edges.join(speeds, "edge_id", "left")
    phi = F.col("speed_kph") / 3.6 * F.col("time_s") / F.col("length_m")
    phi = F.when((F.col("speed_kph") > 0) & (F.col("length_m") > 0) & (F.col("road_class") != "ferry"), F.least(phi, F.lit(1.0)) if slow_down_only else phi).otherwise(1.0)
    time = F.col("time_s") / phi
    return rows.select("edge_id", time.alias("time_s"), F.greatest(F.lit(0.0), F.col("cost") + time_weight * (time - F.col("time_s"))).alias("cost"))


def bucket_classes(speeds: DataFrame) -> DataFrame:
    """(bucket, representative): buckets whose columns of (key, speed) are equal share the smallest of them.

    A column, which is as long as the network, is known by its count and two order-free sums of 64-bit hashes.
    """
    mark = F.xxhash64("key", "speed")
    # the sum of the hashes' halves can't overflow
    marks = [F.count(F.lit(1)), F.bit_xor(mark), F.sum(F.shiftrightunsigned(mark, 32)), F.sum(F.xxhash64("speed", "key").bitwiseAND(F.lit(0xFFFFFFFF)))]
    column = speeds.groupBy("bucket").agg(*[m.alias(f"mark{i}") for i, m in enumerate(marks)])
    return column.select("bucket", F.min("bucket").over(Window.partitionBy(*[f"mark{i}" for i in range(4)])).alias("representative"))


def expiry(ts: Column, ttl_s: Column) -> Column:
    """Seconds at which an update ends, rounded up to a whole minute."""
    return (F.ceil((F.unix_seconds(ts) + ttl_s) / 60) * 60).cast("long")


def held(updates: DataFrame, at_s: int) -> DataFrame:
    """What is known at at_s of updates (feature_id, direction, seq, ts, ttl_s, action, speed): the last update of a key by seq;
    direction 0 means both; cleared keys are gone, expired ones still there."""
    both = updates.withColumn("direction", F.explode(F.when(F.col("direction") == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array("direction"))))
    last = both.where(F.unix_seconds("ts") <= at_s).groupBy("feature_id", "direction").agg(F.max_by(F.struct("ts", "ttl_s", "action", "speed", "seq"), "seq").alias("u"))
    rows = last.select("feature_id", "direction", "u.action", "u.speed", expiry(F.col("u.ts"), F.col("u.ttl_s")).alias("expires_at"))
    return rows.where(F.col("action") != "clear")


def apply_live(updates: DataFrame, at_s: int) -> DataFrame:
    """The state at at_s of updates, as ``held``, without expired keys."""
    return held(updates, at_s).where(F.col("expires_at") > at_s)


def status(updates: DataFrame, at_s: int) -> DataFrame:
    """One row at at_s: version (the last update's seq), entries that are held, and those of them that haven't expired."""
    rows = held(updates, at_s).agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(F.col("expires_at") > at_s, 1)).alias("active"))
    return updates.where(F.unix_seconds("ts") <= at_s).agg(F.max("seq").alias("version")).join(rows)


def rule_active(local: Column, days: int, start_minute: int, end_minute: int) -> Column:
    """A weekly time rule (bit 0 Monday); a window past midnight belongs to the day on which it starts."""
    minute, day = F.hour(local) * 60 + F.minute(local), F.weekday(local)
    on = lambda d: F.expr("1L").bitwiseAND(F.lit(0)) != 0 if days == 0 else F.array_contains(F.array(*[F.lit(i) for i in range(7) if days >> i & 1]), d)
    if start_minute <= end_minute:
        return on(day) & (minute >= start_minute) & (minute < end_minute)
    return (on(day) & (minute >= start_minute)) | (on((day + 6) % 7) & (minute < end_minute))
