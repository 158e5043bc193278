"""Conditional tag values (``value @ (condition); ...``): weekly time rules and limits of vehicles.

Read by an Arrow function: parse a table's distinct values and join them back, as tags repeat.
Dates, sun times, school holidays, comments and combined conditions make an entry unsupported;
none is taken in part.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WEEK = ["Mo", "Tu", "We", "Th", "Fr", "Sa", "Su"]
HOLIDAY = 128
LENGTHS = {"": 1.0, "m": 1.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254}
WEIGHTS = {"": 1.0, "t": 1.0, "kg": 0.001, "lbs": 0.00045359237}
LIMITS = {"height": LENGTHS, "width": LENGTHS, "length": LENGTHS, "weight": WEIGHTS, "axleload": WEIGHTS}

DAY = "(?:" + "|".join([*WEEK, "PH"]) + ")"
DAYS = rf"{DAY}(?:\s*-\s*{DAY})?"
TIMES = r"\d{1,2}:[0-5]\d\s*-\s*\d{1,2}:[0-5]\d"
RULE = re.compile(rf"\s*(?:(?P<always>24/7)|(?P<days>{DAYS}(?:\s*,\s*{DAYS})*)?\s*(?P<times>{TIMES}(?:\s*,\s*{TIMES})*)?)\s*(?P<word>(?i:off|closed|open)\b)?\s*")
LIMIT = re.compile(r"\s*(?P<what>[a-z]+)\s*>=?\s*(?P<much>\d+(?:[.,]\d+)?)\s*(?P<unit>[a-z]*)\s*", re.I)
ENTRIES = "array<struct<value:string,kind:string,property:string,above:double,rules:array<struct<days:int,start_minute:int,end_minute:int,holidays_as_weekdays:boolean>>>>"


def day_mask(text: str) -> int | None:
    """Bits of a list of days and ranges, Monday 1; a range may pass Sunday."""
    mask = 0
    for part in text.split(","):
        ends = [p.strip() for p in part.split("-")]
        if ends == ["PH"]:
            mask |= HOLIDAY
            continue
        if "PH" in ends:
            return None
        first, last = WEEK.index(ends[0]), WEEK.index(ends[-1])
        for i in range((last - first) % 7 + 1):
            mask |= 1 << (first + i) % 7
    return mask


def minutes(text: str | None) -> list[tuple[int, int]] | None:
    """(start, end) of each span of times, an end before its start on the next day; without times the whole day."""
    out = []
    for span in text.split(",") if text else ["0:00-24:00"]:
        a, b = (int(h) * 60 + int(m) for h, m in (t.strip().split(":") for t in span.split("-")))
        b = b - 1440 if 1440 < b <= 2880 else b
        if a >= 1440 or b > 1440 or a == b:
            return None
        out.append((a, b))
    return out


def weekly_rules(text: str) -> list[tuple[int, int, int, bool]] | None:
    """(days, start, end, holidays as weekdays) of a weekly time domain, None if it is another.

    A part after ``;`` takes its days from the parts before, one after ``,`` adds to them.
    """
    parts, holidays = [], False
    for part in filter(None, map(str.strip, unwrapped(text).split(";"))):
        fresh, at = [], 0
        while True:
            m = RULE.match(part, at)
            days = day_mask(m["days"]) if m["days"] else 127
            spans = minutes(m["times"])
            off = (m["word"] or "").lower() in ("off", "closed")
            if days is None or spans is None or not (m["always"] or m["days"] or m["times"]) or (off and (m["times"] or days != HOLIDAY)):
                return None
            holidays = holidays or bool(days & HOLIDAY)
            if not off and not fresh and not at:
                parts = [(d & ~days, s) for d, s in parts]
            if not off:
                fresh.append((days, spans))
            at = m.end()
            if at == len(part):
                break
            if part[at] != ",":
                return None
            at += 1
        parts += fresh
    return [(d, a, b, not holidays) for d, spans in parts if d for a, b in spans] or None


def unwrapped(text: str) -> str:
    """text without brackets around the whole of it."""
    text = text.strip()
    while m := re.fullmatch(r"\(([^()]*)\)", text):
        text = m[1].strip()
    return text


def entries(raw: str | None) -> list[tuple] | None:
    """The entries of a conditional value in its order; None without any, or if one has no condition."""
    out = []
    for entry in filter(None, map(str.strip, re.findall(r"(?:\([^()]*\)|[^;])+", raw or ""))):
        value, at, condition = entry.partition("@")
        if not at:
            return None
        condition = unwrapped(condition)
        limit = LIMIT.fullmatch(condition)
        what = limit and limit["what"].lower()
        factor = LIMITS[what].get(limit["unit"].lower()) if what in LIMITS else None
        if re.search(" (?:AND|and) ", condition):
            out.append((value.strip(), "unsupported", None, None, []))
        elif factor:
            out.append((value.strip(), "vehicle", what, float(limit["much"].replace(",", ".")) * factor, []))
        else:
            rules = weekly_rules(condition)
            out.append((value.strip(), "time" if rules else "unsupported", None, None, rules or []))
    return out or None


def conditional(raw: Column | str) -> Column:
    """Entries of conditional values: kind ``time`` (rules), ``vehicle`` (property above a limit in metres or tonnes) or ``unsupported``."""
    names, parts = ("value", "kind", "property", "above", "rules"), ("days", "start_minute", "end_minute", "holidays_as_weekdays")

    def one(text):
        found = entries(text)
        return found and [dict(zip(names, (*e[:4], [dict(zip(parts, r, strict=True)) for r in e[4]]), strict=True)) for e in found]

    @F.pandas_udf(ENTRIES)
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return read(raw)
