"""Structured Streaming: live traffic state with expiry, tumbling bins, gap sessions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.graph import shared_folder


def read_stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)


def tumbling_bins(stream: DataFrame, ts: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(key, start, entered, mean): closed bins; rows later than the watermark are left out."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width), key)
    return rows.agg(F.count(F.lit(1)).alias("entered"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias("start"), "entered", "mean")


def sliding_counts(stream: DataFrame, ts: str, key: str, width: str, slide: str, late: str) -> DataFrame:
    """(key, start, end, n): closed windows of that width, one each slide; rows later than the watermark are left out."""
    rows = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide), key)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def gap_sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    rows = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def live_state(updates: DataFrame, ts: str = "ts") -> DataFrame:
    """Each key's (feature_id, direction) latest update (seq, ts, ttl_s, action, speed), whenever it changes.

    A clear deletes the key. Expiry is rounded up to a minute; with event-time timeouts an
    expired key leaves the state even if no update comes.
    """

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        for frame in frames:
            # the latest of the frame's, the first of equals: no other one can stay
            seq = frame["seq"].to_numpy()
            k = int(seq.argmax()) if len(seq) else None
            if k is not None and (held is None or seq[k] > held[0]):
                ends = -(-(int(frame["at"].to_numpy()[k]) + int(frame["ttl_s"].to_numpy()[k])) // 60) * 60
                held = (int(seq[k]), ends, str(frame["action"].to_numpy()[k]), float(frame["speed"].to_numpy()[k]))
        if held[2] == "clear":
            state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(max(held[1] * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"feature_id": [key[0]], "direction": [key[1]], "seq": [held[0]], "action": [held[2]], "speed": [held[3]], "expires_at": [held[1]]})

    rows = updates.withColumn("direction", F.explode(F.when(F.col("direction") == 0, F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.col("direction").cast("int")))))
    rows = rows.withColumn("at", F.unix_seconds(ts)).withWatermark(ts, "10 minutes")
    out = "feature_id long, direction int, seq long, action string, speed double, expires_at long"
    return rows.groupBy("feature_id", "direction").applyInPandasWithState(step, out, "seq long, expires_at long, action string, speed double", "update", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream has sent when all present input is done, for batch catch-up: written to the shared folder batch by
    batch, and read back (the last batch in mode ``complete``, else all)."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/drained_{uuid.uuid4().hex}"
    sent: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces what it had written
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        sent.append(number)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    use = sorted(set(sent))[-1:] if mode == "complete" else sorted(set(sent))
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/batch-{n}" for n in use]) if use else spark.createDataFrame([], stream.schema)
