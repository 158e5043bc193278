"""Heights along edges and lines, and travel through speeds that change with time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def edge_elevation(edges: DataFrame, raster: DataFrame, size: float, spacing_m: float = 10.0) -> DataFrame:
    """(edge_id, ascent_m, descent_m, max_up, max_down) of edges with ends (lon, lat, z) and structure (bridges and tunnels).

    An edge is sampled every spacing_m at most; structures, and samples that no raster cell
    (cell_x, cell_y of side size, height) covers, are interpolated between the ends' heights.
    """
    length = geo.haversine(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    rows = edges.withColumn("run_m", length).withColumn("pieces", F.when(F.col("structure") | (F.col("run_m") <= spacing_m), 1).otherwise(F.ceil(F.col("run_m") / spacing_m)).cast("int"))
    t = F.col("i") / F.col("pieces")
    at = lambda c: F.col(f"from_{c}") + (F.col(f"to_{c}") - F.col(f"from_{c}")) * t
    samples = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("pieces")))).select("edge_id", "i", "pieces", "run_m", at("z").alias("plain"), at("lon").alias("lon"), at("lat").alias("lat"))
    inner = (F.col("i") > 0) & (F.col("i") < F.col("pieces"))
    placed = samples.withColumn("cell_x", F.when(inner, F.floor(F.col("lon") / size))).withColumn("cell_y", F.when(inner, F.floor(F.col("lat") / size)))
    known = placed.join(raster.select("cell_x", "cell_y", "height"), ["cell_x", "cell_y"], "left").withColumn("h", F.coalesce("height", "plain"))
    rise = F.col("h") - F.lag("h").over(Window.partitionBy("edge_id").orderBy("i"))
    steps = known.withColumn("rise", rise).where("rise is not null").withColumn("grade", F.when(F.col("run_m") > 0, F.col("rise") / (F.col("run_m") / F.col("pieces"))).otherwise(0.0))
    up = F.greatest(F.lit(0.0), F.col("rise"))
    return steps.groupBy("edge_id").agg(F.sum(up).alias("ascent_m"), F.sum(up - F.col("rise")).alias("descent_m"), (F.greatest(F.max("grade"), F.lit(0.0)) + F.lit(0.0)).alias("max_up"), (F.greatest(-F.min("grade"), F.lit(0.0)) + F.lit(0.0)).alias("max_down"))


def resample(lines: DataFrame, key: str, interval_m: float) -> DataFrame:
    """(key, step, lon, lat): a point every interval_m along each line (key, seq, lon, lat), and its last one."""
    by = Window.partitionBy(key).orderBy("seq")
    legs = lines.withColumns({"to_lon": F.lead("lon").over(by), "to_lat": F.lead("lat").over(by), "last": F.lead("seq").over(by).isNull()})
    legs = legs.withColumn("leg_m", F.when(F.col("last"), 0.0).otherwise(geo.haversine(F.col("lon"), F.col("lat"), F.col("to_lon"), F.col("to_lat"))))
    legs = legs.withColumn("end_m", F.sum("leg_m").over(by)).withColumn("start_m", F.col("end_m") - F.col("leg_m"))
    first, most = F.floor(F.col("start_m") / interval_m) + 1, F.floor(F.col("end_m") / interval_m)
    inner = legs.where(~F.col("last") & (most >= first)).withColumn("step", F.explode(F.sequence(first, most)))
    t = (F.col("step") * interval_m - F.col("start_m")) / F.col("leg_m")
    points = inner.select(key, "step", (F.col("lon") + (F.col("to_lon") - F.col("lon")) * t).alias("lon"), (F.col("lat") + (F.col("to_lat") - F.col("lat")) * t).alias("lat"))
    start = legs.where("start_m = 0").groupBy(key).agg(F.min_by(F.struct("lon", "lat"), "seq").alias("p")).select(key, F.lit(0).cast("long").alias("step"), "p.lon", "p.lat")
    # the last point, where no step ends on it
    end = legs.where(F.col("last") & (F.col("end_m") - F.floor(F.col("end_m") / interval_m) * interval_m > 1e-6)).select(key, (most + 1).alias("step"), "lon", "lat")
    return start.unionByName(points).unionByName(end)


def traversal(entries: DataFrame, buckets: DataFrame, key: str) -> DataFrame:
    """entries (key, entry_s, base_s: seconds at speed 1) with exit_s through speeds that change over time.

    buckets: key, start_s, ratio, each valid until the next one of its key; before the first the
    first one's holds, after the last the last one's. Who enters later leaves no earlier.
    Progress is cumulative, so the exit is found in one bucket without stepping through them.
    """
    by = Window.partitionBy(key).orderBy("start_s")
    spans = buckets.withColumn("end_s", F.lead("start_s").over(by)).withColumn("work", F.coalesce((F.col("end_s") - F.col("start_s")) * F.col("ratio"), F.lit(0.0)))
    spans = spans.withColumn("before", F.sum("work").over(by) - F.col("work")).withColumn("n", F.row_number().over(by))
    rows = entries.join(spans, key)
    inside = ((F.col("n") == 1) | (F.col("entry_s") >= F.col("start_s"))) & (F.col("end_s").isNull() | (F.col("entry_s") < F.col("end_s")))
    done = rows.where(inside).select(*entries.columns, (F.col("before") + (F.col("entry_s") - F.col("start_s")) * F.col("ratio") + F.col("base_s")).alias("goal"))
    out = done.join(spans, key).where(((F.col("n") == 1) | (F.col("goal") >= F.col("before"))) & (F.col("end_s").isNull() | (F.col("goal") < F.col("before") + F.col("work"))))
    return out.select(*entries.columns, (F.col("start_s") + (F.col("goal") - F.col("before")) / F.col("ratio")).alias("exit_s"))


def maneuvers(path: DataFrame, key: str, turn: Column) -> DataFrame:
    """The steps of a path (key, seq, name, heading) where a driver has something to do: a turn or another name.

    turn: the class of the turn from prev_heading to heading, in these columns.
    """
    by = Window.partitionBy(key).orderBy("seq")
    rows = path.withColumn("prev_heading", F.lag("heading").over(by)).withColumn("prev_name", F.lag("name").over(by))
    rows = rows.withColumn("turn", F.when(F.col("prev_heading").isNull(), "depart").otherwise(turn))
    return rows.where((F.col("turn") != "straight") | ~F.col("name").eqNullSafe(F.col("prev_name"))).drop("prev_heading", "prev_name")
