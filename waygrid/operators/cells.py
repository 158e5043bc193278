"""Hierarchical grid cells: an aperture-4 lon/lat grid, not hexagons.

A cell at resolution r is the pair of floor(lon / size), floor(lat / size) with size =
BASE / 2^r degrees, packed into one number. A parent halves both; the algebra of parent,
children, disk and distance is that of any such hierarchy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = 16.0
SHIFT, OFFSET = 1 << 26, 1 << 25
AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}


def cell_at(lon: Column, lat: Column, res: int) -> Column:
    size = BASE / (1 << res)
    return pack(F.floor(lon / size), F.floor(lat / size))


def pack(x: Column, y: Column) -> Column:
    return (x + OFFSET) * SHIFT + y + OFFSET


def x_of(cell: Column) -> Column:
    return F.floor(cell / SHIFT).cast("long") - OFFSET


def y_of(cell: Column) -> Column:
    return cell % SHIFT - OFFSET


def parent(cell: Column, up: int = 1) -> Column:
    return pack(F.shiftright(x_of(cell), up), F.shiftright(y_of(cell), up))


def children(cell: Column) -> Column:
    """The four cells of the next resolution."""
    return F.array(*[pack(x_of(cell) * 2 + dx, y_of(cell) * 2 + dy) for dx in (0, 1) for dy in (0, 1)])


def distance(a: Column, b: Column) -> Column:
    """Steps between cells of one resolution, diagonals included."""
    return F.greatest(F.abs(x_of(a) - x_of(b)), F.abs(y_of(a) - y_of(b)))


def disk(cell: Column, k: int) -> Column:
    around = [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1)]
    return F.array(*[pack(x_of(cell) + dx, y_of(cell) + dy) for dx, dy in around])


def roll_up(points: DataFrame, resolutions: list[int], weight: str) -> DataFrame:
    """(resolution, cell, n, weight): grouped once at the finest resolution, then each coarser one from that."""
    finest = max(resolutions)
    base = points.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).groupBy(cell_at(F.col("lon"), F.col("lat"), finest).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))
    levels = [base.groupBy(parent(F.col("cell"), finest - r).alias("cell")).agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).select(F.lit(r).alias("resolution"), "cell", "n", "weight") for r in resolutions]
    return reduce(DataFrame.unionByName, levels)


def aggregate_layer(points: DataFrame, res: int, specs: list[str]) -> DataFrame:
    """Columns by 'source[:aggregate][=name]'; missing and non-finite values are left out; a count without source counts rows."""
    columns = []
    for spec in specs:
        head, _, name = spec.partition("=")
        source, _, how = head.partition(":")
        how = how or "sum"
        value = F.lit(1) if not source else F.when(F.abs(F.col(source)) < float("inf"), F.col(source))
        columns.append(AGGREGATES[how](value).alias(name or (f"{source}_{how}" if source else how)))
    return points.groupBy(cell_at(F.col("lon"), F.col("lat"), res).alias("cell")).agg(*columns)


def resample_up(layer: DataFrame, up: int, value: str) -> DataFrame:
    return layer.groupBy(parent(F.col("cell"), up).alias("cell")).agg(F.sum(value).alias(value))


def resample_down(layer: DataFrame, value: str) -> DataFrame:
    """Equal shares to the children; the total is preserved."""
    return layer.select(F.explode(children(F.col("cell"))).alias("cell"), (F.col(value) / 4).alias(value))


def merge(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """Upsert: new values replace old ones cell by cell."""
    return old.join(new.withColumnRenamed(value, "__new"), "cell", "full_outer").select("cell", F.coalesce("__new", value).alias(value))


def paint(layer: DataFrame, cells: DataFrame, how: str, amount: float, value: str) -> DataFrame:
    """set, add, multiply or clear on the listed cells; cells without a value vanish."""
    rows = layer.join(cells.select("cell", F.lit(1).alias("__hit")).distinct(), "cell", "full_outer")
    old = F.col(value)
    new = {"set": F.lit(amount), "add": F.coalesce(old, F.lit(0.0)) + amount, "multiply": old * amount, "clear": F.lit(None).cast("double")}[how]
    return rows.select("cell", F.when(F.col("__hit") == 1, new).otherwise(old).alias(value)).where(F.col(value).isNotNull())


def compact(cells: DataFrame) -> DataFrame:
    """Full sets of four siblings as their parent: (cell, parents), one level."""
    up = cells.select("cell", parent(F.col("cell")).alias("up")).distinct()
    full = up.groupBy("up").agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("up")
    return full.select(F.col("up").alias("cell"), F.lit(True).alias("is_parent")).unionByName(up.join(full, "up", "left_anti").select("cell", F.lit(False).alias("is_parent")))


def surge(demand: DataFrame, supply: DataFrame, rings: int, decay: float, balance: float, sensitivity: float, step: float, low: float, high: float, least_supply: float) -> DataFrame:
    """(cell, ratio, multiplier) of cells with demand or supply, each spread over rings with weights decay^d."""
    total = sum(decay**d * (1 if d == 0 else 8 * d) for d in range(rings + 1))

    def spread(rows: DataFrame, name: str) -> DataFrame:
        near = F.explode(disk(F.col("cell"), rings)).alias("to")
        out = rows.select("cell", "value", near).withColumn("w", F.pow(F.lit(decay), distance(F.col("cell"), F.col("to"))) / total)
        return out.groupBy(F.col("to").alias("cell")).agg(F.sum(F.col("value") * F.col("w")).alias(name))

    own = demand.select("cell").unionByName(supply.select("cell")).distinct()
    rows = own.join(spread(demand, "d"), "cell", "left").join(spread(supply, "s"), "cell", "left").fillna(0.0, ["d", "s"])
    ratio = F.col("d") / F.greatest(F.col("s"), F.lit(least_supply))
    raw = F.round((1 + sensitivity * (ratio / balance - 1)) / step) * step
    return rows.select("cell", ratio.alias("ratio"), F.least(F.lit(high), F.greatest(F.lit(low), raw)).alias("multiplier"))


def ring(cell: Column, k: int) -> Column:
    """The cells exactly k steps away."""
    around = [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if max(abs(dx), abs(dy)) == k]
    return F.array(*[pack(x_of(cell) + dx, y_of(cell) + dy) for dx, dy in around])


def uncompact(members: DataFrame, res: int) -> DataFrame:
    """(cell) of one resolution: members (resolution, cell), the coarser ones by their descendants."""
    step = lambda i, c: F.shiftleft(c, i)
    out = None
    for up in range(res + 1):
        at = members.where(F.col("resolution") == res - up)
        width = 1 << up
        wide = at.withColumn("dx", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("dy", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        part = wide.select(pack(step(up, x_of(F.col("cell"))) + F.col("dx"), step(up, y_of(F.col("cell"))) + F.col("dy")).alias("cell"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def cover(boxes: DataFrame, res: int, limit: int) -> DataFrame:
    """boxes (min_lon, min_lat, max_lon, max_lat) with each cell whose centre is inside; more than limit for a box is an error."""
    size = BASE / (1 << res)
    low = lambda c: F.ceil(F.col(c) / size - 0.5)
    high = lambda c: F.floor(F.col(c) / size - 0.5)
    rows = boxes.withColumns({"x0": low("min_lon"), "x1": high("max_lon"), "y0": low("min_lat"), "y1": high("max_lat")}).where("x1 >= x0 and y1 >= y0")
    n = (F.col("x1") - F.col("x0") + 1) * (F.col("y1") - F.col("y0") + 1)
    rows = rows.withColumn("x0", F.when(n > limit, F.raise_error(F.lit(f"more than {limit} cells"))).otherwise(F.col("x0")))
    rows = rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return rows.withColumn("cell", pack(F.col("x"), F.col("y"))).drop("x0", "x1", "y0", "y1", "x", "y")
