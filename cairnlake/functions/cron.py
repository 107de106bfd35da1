"""Cron schedules of five fields (O-75, O-76): parsed at plan time, matched as column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6))


def parse(schedule: str) -> list[list[int]]:
    """Allowed values of minute, hour, day, month and weekday (0 is Sunday): ``*``, numbers, ranges and lists."""
    fields = schedule.split()
    if len(fields) != len(BOUNDS):
        raise ValueError(f"expected {len(BOUNDS)} fields, got {len(fields)}")
    out = []
    for field, (least, most) in zip(fields, BOUNDS):
        values: set[int] = set()
        for part in ["%d-%d" % (least, most)] if field == "*" else field.split(","):
            a, _, b = part.partition("-")
            lo, hi = int(a), int(b or a)
            if not least <= lo <= hi <= most:
                raise ValueError(f"{part} is out of bounds {least}-{most}")
            values.update(range(lo, hi + 1))
        out.append(sorted(values))
    return out


def matches(time: Column, schedule: str) -> Column:
    parts = (F.minute(time), F.hour(time), F.day(time), F.month(time), F.dayofweek(time) - 1)
    fits = F.lit(True)
    for part, values, (least, most) in zip(parts, parse(schedule), BOUNDS):
        if len(values) <= most - least:
            fits = fits & part.isin(values)
    return fits
