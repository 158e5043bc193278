"""Cost components: products of one quantity, predicates on attributes and at most one overlay, as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the quantities.
QUANTITIES = {"0": "zero", "zero": "zero", "travel_time": "time", "travel_time_s": "time", "time": "time", "distance": "distance", "distance_m": "distance", "length": "distance", "length_m": "distance", "ascent": "ascent", "ascent_m": "ascent", "descent": "descent", "descent_m": "descent"}
PREDICATE = re.compile(r"""^\s*([\w:.-]+)\s*(==|!=|=)\s*(?:"([^"]*)"|'([^']*)'|([^\s"'()]+))\s*$""")


def factors(text: str) -> list[str]:
    """The factors of a product; quotes and parentheses hold theirs together."""
    out, depth, quote, held = [], 0, "", ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if depth < 0:
                raise ValueError(f"unbalanced parentheses in {text!r}")
        elif c == "*" and not depth:
            out.append(held)
            held = ""
            continue
        held += c
    if depth or quote:
        raise ValueError(f"unbalanced quotes or parentheses in {text!r}")
    return [*out, held]


def bare(factor: str) -> str:
    factor = factor.strip()
    while factor.startswith("(") and factor.endswith(")") and factors(factor[1:-1]):
        factor = factor[1:-1].strip()
    return factor


def component(text: str, quantities: dict[str, Column], attribute: Callable[[str], Column], overlay: Callable[[str], Column] | None = None) -> Column:
    """The value of a component on an edge, e.g. ``travel_time * (surface == "gravel") * (1 - overlay:flood)``.

    quantities: time, distance, ascent and descent. A predicate is one or zero; an attribute
    that is null equals nothing. Without overlay data an overlay counts zero, its inverse one.
    """
    quantity, value, overlays = None, F.lit(1.0), 0
    for factor in map(bare, factors(text.replace("×", "*").replace("⋅", "*").replace("−", "-"))):
        plain = re.sub(r"\s", "", factor).lower()
        if plain in QUANTITIES:
            if quantity is not None:
                raise ValueError("more than one base quantity")
            name = QUANTITIES[plain]
            quantity = F.lit(0.0) if name == "zero" else quantities[name]
        elif plain.startswith(("overlay:", "1-overlay:")):
            inverse, name = plain.startswith("1-"), plain.partition("overlay:")[2]
            overlays += 1
            if not name or overlays > 1:
                raise ValueError("an overlay needs a name, and a component has one at most")
            found = overlay(name) if overlay else F.lit(0.0)
            value = value * (1 - found if inverse else found)
        elif m := PREDICATE.match(factor):
            equal = F.coalesce(attribute(m[1]) == next(g for g in m.groups()[2:] if g is not None), F.lit(False))
            value = value * (~equal if m[2] == "!=" else equal).cast("double")
        else:
            raise ValueError(f"unsupported factor {factor!r}")
    if quantity is None:
        raise ValueError("a component needs travel_time, distance, ascent, descent or zero")
    return quantity * value


def merged(base, overrides):
    """base with overrides: objects key by key, anything else replaced."""
    if not (isinstance(base, dict) and isinstance(overrides, dict)):
        return overrides
    return base | {k: merged(base.get(k), v) for k, v in overrides.items()}
