"""Regex matches with their places, by SQL functions only.

``split`` and ``regexp_extract_all`` walk the same matches of a pattern, so the
pieces between matches and the matches themselves give every offset (in code
points)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value, part>> of the leftmost non-overlapping
    matches of a pattern that never matches the empty string; ``part`` is the
    text of ``group``. ``end`` is exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    parts = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    rows = F.arrays_zip(found.alias("value"), parts.alias("part"), F.slice(between, 1, F.size(found)).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string,part:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.length(m["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
            start.alias("start"), end.alias("end"), m["value"].alias("value"), m["part"].alias("part")))).alias("out"))
    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


def no_matches() -> Column:
    return F.array().cast("array<struct<start:int,end:int,value:string,part:string>>")
