"""Stairs, escalators, lifts, travelators and ramps: times on edges that aren't plain ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a one-time wait or boarding is charged from this much height.
LEAST_VERTICAL_M = 0.25


def traversal_s(kind: Column, length_m: Column, ascent_m: Column, descent_m: Column, flat_mps: float, slope_factor: Column, *, stairs_mps: float = 0.25, escalator_mps: float = 0.5, lift_mps: float = 1.0, lift_wait_s: float = 30.0, travelator_mps: float = 0.7, walking_mps: float = 0.0, ramp_factor: float = 0.8, boarding_s: float = 0.0) -> Column:
    """Seconds over an edge by its facility (null: a plain way).

    Stairs and lifts have a vertical speed of their own, so the slope's factor doesn't apply to them.
    """
    flat = F.lit(max(flat_mps, 0.1 / 3.6))
    height = ascent_m + descent_m
    across = F.sqrt(F.greatest(length_m * length_m - height * height, F.lit(0.0)))
    rises = height >= LEAST_VERTICAL_M
    once = lambda s: F.when(rises, s).otherwise(0.0)
    plain, level = length_m / F.greatest(flat * slope_factor, F.lit(0.1 / 3.6)), length_m / flat
    return (
        F.when(kind == "stairs", F.greatest(level, height / stairs_mps) + once(boarding_s))
        .when(kind == "escalator", F.when(rises, length_m / (escalator_mps + walking_mps) + boarding_s).otherwise(level))
        .when(kind == "travelator", length_m / (travelator_mps + walking_mps) + boarding_s)
        .when(kind == "lift", F.greatest(height / lift_mps, across / flat) + once(lift_wait_s))
        .when(kind == "ramp", plain / ramp_factor + boarding_s)
        .otherwise(plain)
    )
