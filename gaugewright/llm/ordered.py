"""Dealing rows out to partitions that hold consecutive id ranges."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What orders a row without an id: before all others.
NO_ID = -(2**63)


def cut_points(rows: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 increasing ids that cut the column ``ord`` (long) of rows in ranges of about as many rows."""
    if parts < 2:
        return []
    found = rows.agg(F.percentile_approx("ord", [i / parts for i in range(1, parts)], 20_000)).first()[0]
    return sorted(set(found or []))


def range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts below a value, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    step = isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda bounds: F.size(F.filter(bounds, lambda x: x < value))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    group = below(longs([g[-1] for g in groups]))
    return F.when(group == len(groups), len(cuts)).otherwise(group * step + below(F.get(F.array(*[longs(g) for g in groups]), group))).cast("int")
