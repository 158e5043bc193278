"""Who may use a way: access by mode, vehicle limits, and directions that a profile can refuse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import parse

#: Modes and their bits.
MODES = {"car": 1, "bicycle": 2, "foot": 4, "hgv": 8, "bus": 16, "taxi": 32, "motorcycle": 64, "moped": 128}
MOTOR = ("car", "hgv", "bus", "taxi", "motorcycle", "moped")
#: Access keys from the most to the least specific.
KEYS = {
    "car": ["motorcar", "motor_vehicle", "vehicle", "access"],
    "hgv": ["hgv", "motor_vehicle", "vehicle", "access"],
    "bus": ["bus", "psv", "motor_vehicle", "vehicle", "access"],
    "taxi": ["taxi", "psv", "motor_vehicle", "vehicle", "access"],
    "motorcycle": ["motorcycle", "motor_vehicle", "vehicle", "access"],
    "moped": ["moped", "motor_vehicle", "vehicle", "access"],
    "bicycle": ["bicycle", "vehicle", "access"],
    "foot": ["foot", "access"],
}
#: What an access value says; others say nothing and the next key decides.
ALLOWED = ("yes", "designated", "official", "permissive", "discouraged")
DESTINATION = ("destination", "delivery", "customers")
DENIED = ("no", "private", "agricultural", "forestry", "use_sidepath", "permit", "emergency", "military")
#: Classes that only some modes may use by default.
ON_FOOT = ("path", "footway", "pedestrian", "steps", "bridleway")
#: Limits by tag.
LENGTHS = {"maxheight": "height", "maxwidth": "width", "maxlength": "length"}
WEIGHTS = {"maxweight": "weight", "maxaxleload": "axle_load"}


def default_mask(highway: Column, motorroad: Column) -> Column:
    """Bits of the modes that may use a class before any access tag."""
    every = sum(MODES.values())
    motor = sum(MODES[m] for m in MOTOR)
    bits = (
        F.when(highway.isin("motorway", "motorway_link"), motor - MODES["moped"])
        .when(highway.isin(*ON_FOOT), MODES["foot"])
        .when(highway == "cycleway", MODES["bicycle"] + MODES["foot"])
        .when(highway == "busway", MODES["bus"])
        .otherwise(every)
    )
    slow = MODES["foot"] + MODES["bicycle"] + MODES["moped"]
    return F.when(motorroad == "yes", bits.bitwiseAND(every - slow)).otherwise(bits)


def verdict(value: Column) -> Column:
    value = F.trim(value)
    return F.when(value.isin(*ALLOWED), "allowed").when(value.isin(*DESTINATION), "destination").when(value.isin(*DENIED), "denied")


def mode_access(tags: Column, mode: str) -> Column:
    """``allowed``, ``destination`` or ``denied``: the most specific key that says something, else the class's default."""
    default = F.when(default_mask(tags["highway"], tags["motorroad"]).bitwiseAND(F.lit(MODES[mode])) != 0, "allowed").otherwise("denied")
    return F.coalesce(*[verdict(tags[k]) for k in KEYS[mode]], default)


def masks(tags: Column) -> tuple[Column, Column]:
    """Bits of the modes that may pass, and of those among them that may only to reach a destination on the way."""
    found = {m: mode_access(tags, m) for m in MODES}
    passing = sum((F.when(v != "denied", MODES[m]).otherwise(0) for m, v in found.items()), F.lit(0))
    only = sum((F.when(v == "destination", MODES[m]).otherwise(0) for m, v in found.items()), F.lit(0))
    return passing, only


def vehicle_limits(tags: Column) -> Column:
    """Array of (kind, maximum): centimetres, kilograms, and 0 for what is forbidden outright; null entries left out."""
    one = lambda kind, value: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.cast("long").alias("maximum")))
    found = [one(kind, F.floor(parse.length_m(tags[k]) * 100 + 0.5)) for k, kind in LENGTHS.items()]
    found += [one(kind, F.floor(parse.weight_t(tags[k]) * 1000 + 0.5)) for k, kind in WEIGHTS.items()]
    found += [one(kind, F.when(tags[k] == "no", 0)) for k, kind in (("hazmat", "hazmat"), ("hazmat:water", "hazmat_water"), ("trailer", "trailer"), ("hgv_articulated", "articulated"))]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def refused_direction(mode: str, foot_reverse: Column, bicycle_contraflow: Column, foot_ignores_oneway: bool, contraflow_allowed: bool) -> Column:
    """Whether a profile refuses an edge that exists only by inference: on foot against a one-way, by bicycle against the flow."""
    if mode == "foot" and not foot_ignores_oneway:
        return foot_reverse
    if mode == "bicycle" and not contraflow_allowed:
        return bicycle_contraflow
    return F.lit(False)
