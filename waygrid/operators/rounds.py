"""Timetable search by rounds of boarding, riding and walking, as joins: no timetable is held in one place.

Round k knows the earliest arrival at every stop with at most k boardings, so the number
of rounds bounds the boardings, and the arrivals of all requests advance together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut


def earliest(conns: DataFrame, walks: DataFrame, requests: DataFrame, boardings: int, slack_s: int = 0, wait_s: int = 7200) -> DataFrame:
    """(request, stop, arrival): earliest arrivals with at most that many boardings.

    conns: trip, seq, from_stop, to_stop, departure, arrival. walks: from_stop, to_stop, seconds.
    requests: request, stop, departure. Boarding takes slack_s, and nobody waits longer than
    wait_s after that. One walks once between rides, and before the first and after the last.
    """
    # a stop's departures by spans of the waiting time, so that a busy stop is many keys
    dealt = conns.withColumn("span", F.floor(F.col("departure") / wait_s))
    rides = conns.select("trip", F.col("seq").alias("ride_seq"), F.col("to_stop").alias("stop"), "arrival")

    def least(rows: DataFrame) -> DataFrame:
        return rows.groupBy("request", "stop").agg(F.min("arrival").alias("arrival"))

    def walked(rows: DataFrame) -> DataFrame:
        on = rows.join(walks, F.col("stop") == F.col("from_stop")).select("request", F.col("to_stop").alias("stop"), (F.col("arrival") + F.col("seconds")).alias("arrival"))
        return least(rows.unionByName(on))

    reached = walked(requests.select("request", "stop", F.col("departure").alias("arrival")))
    for _ in range(boardings):
        ready = (F.col("arrival") + slack_s).alias("ready")
        ask = reached.select("request", F.col("stop").alias("from_stop"), ready)
        ask = ask.withColumn("span", F.explode(F.sequence(F.floor(F.col("ready") / wait_s), F.floor((F.col("ready") + wait_s) / wait_s))))
        boarded = ask.join(dealt, ["from_stop", "span"]).where(F.col("departure").between(F.col("ready"), F.col("ready") + wait_s))
        boarded = boarded.groupBy("request", "trip").agg(F.min("seq").alias("first"))
        rode = boarded.join(rides, "trip").where("ride_seq >= first").select("request", "stop", "arrival")
        reached = cut(least(reached.unionByName(walked(least(rode)))))
    return reached


def latest(conns: DataFrame, walks: DataFrame, requests: DataFrame, boardings: int, slack_s: int = 0, wait_s: int = 7200) -> DataFrame:
    """(request, stop, departure): the latest departures that reach the request's stop by its time (request, stop, arrive).

    The search of the mirrored timetable, in which time runs backwards and trips too.
    """
    mirrored = conns.select("trip", (-F.col("seq")).alias("seq"), F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), (-F.col("arrival")).alias("departure"), (-F.col("departure")).alias("arrival"))
    back = walks.select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "seconds")
    found = earliest(mirrored, back, requests.select("request", "stop", (-F.col("arrive")).alias("departure")), boardings, slack_s, wait_s)
    return found.select("request", "stop", (-F.col("arrival")).alias("departure"))


def area(conns: DataFrame, walks: DataFrame, requests: DataFrame, boardings: int, budget_s: int, slack_s: int = 0, wait_s: int = 7200) -> DataFrame:
    """(request, stop, arrival, elapsed): the stops within budget_s of each request's departure."""
    found = earliest(conns, walks, requests, boardings, slack_s, wait_s).join(requests.select("request", "departure"), "request")
    elapsed = F.col("arrival") - F.col("departure")
    return found.select("request", "stop", "arrival", elapsed.alias("elapsed")).where(F.col("elapsed") <= budget_s)
