"""Filters over whole frames in long form (frame, y, x, s): neighbourhoods are windows along rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from tessera.functions import fx


def clamped_lag(value: str, along: str, across: str, k: int) -> Column:
    """The value k places before (after, if negative) along an axis; the last one there is at the frame's edge."""
    line = Window.partitionBy("frame", across).orderBy(along)
    edge = F.first(value) if k > 0 else F.last(value)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.lag(value, k).over(line) if k > 0 else F.lead(value, -k).over(line), edge.over(whole)) if k else F.col(value)


def wiener_taps(coefficients: list[int]) -> list[int]:
    """Seven symmetric taps that sum to 128 from the three outer ones."""
    return [*coefficients, 128 - 2 * sum(coefficients), *coefficients[::-1]]


def edge_filter(v: list[Column], limit: int, blimit: int, thresh: int) -> dict[str, Column]:
    """The narrow filter of the samples p1, p0 | q0, q1 of an edge: filtered values, unchanged where the masks forbid."""
    p1, p0, q0, q1 = (x.cast("long") for x in v)
    c = lambda x: fx.clip3(F.lit(-128).cast("long"), F.lit(127).cast("long"), x)
    hev = (F.abs(p1 - p0) > thresh) | (F.abs(q1 - q0) > thresh)
    mask = (F.abs(p1 - p0) <= limit) & (F.abs(q1 - q0) <= limit) & (F.abs(p0 - q0) * 2 + fx.shr(F.abs(p1 - q1), 1) <= blimit)
    base = F.when(hev, c(p1 - q1)).otherwise(F.lit(0).cast("long"))
    f = c(base + 3 * (q0 - p0))
    f1, f2 = fx.shr(c(f + 4), 3), fx.shr(c(f + 3), 3)
    half = fx.shr(f1 + 1, 1)
    keep = lambda new, old: F.when(mask, new).otherwise(old)
    outer = lambda new, old: F.when(mask & ~hev, new).otherwise(old)
    return {"p1": outer(c(p1 - 128 + half) + 128, p1), "p0": keep(c(p0 - 128 + f2) + 128, p0), "q0": keep(c(q0 - 128 - f1) + 128, q0), "q1": outer(c(q1 - 128 - half) + 128, q1)}


#: Offsets (dy, dx) of the two taps of each of the eight CDEF directions.
DIRECTIONS = (((-1, 1), (-2, 2)), ((0, 1), (-1, 2)), ((0, 1), (0, 2)), ((0, 1), (1, 2)), ((1, 1), (2, 2)), ((1, 0), (2, 1)), ((1, 0), (2, 0)), ((1, 0), (2, -1)))
