"""Bearings in classes: the eight compass bins and what share of them arcs cover."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compass_bin(bearing: Column) -> Column:
    """0 for north to 7 for north-west, each 45 degrees wide about its direction."""
    return F.pmod(F.floor((bearing + 22.5) / 45), F.lit(8)).cast("int")


def sun_arcs(latitude: Column, tilt: float = 23.44) -> Column:
    """Ranges (lo, hi) of bearings at which the sun rises and sets over a year; all round beyond the polar circles."""
    x = F.sin(F.radians(F.lit(tilt))) / F.cos(F.radians(latitude))
    low = F.degrees(F.acos(F.least(F.abs(x), F.lit(1.0))))
    arc = lambda a, b: F.struct(a.cast("double").alias("lo"), b.cast("double").alias("hi"))
    return F.when(F.abs(x) > 1, F.array(arc(F.lit(0.0), F.lit(360.0)))).otherwise(F.array(arc(low, 180 - low), arc(180 + low, 360 - low)))


def overlap(lo: Column, hi: Column, k: int) -> Column:
    """How much of an arc lies in a compass bin, round the circle."""
    parts = [F.greatest(F.lit(0.0), F.least(hi + s, F.lit(45.0 * k + 22.5)) - F.greatest(lo + s, F.lit(45.0 * k - 22.5))) for s in (-360.0, 0.0, 360.0)]
    return parts[0] + parts[1] + parts[2]


def bin_shares(arcs: Column) -> Column:
    """Share of the arcs' length in each compass bin, an array of eight."""
    covered = lambda k: F.aggregate(arcs, F.lit(0.0), lambda a, x: a + overlap(x["lo"], x["hi"], k))
    length = [covered(k) for k in range(8)]
    total = sum(length[1:], length[0])
    return F.array(*(F.try_divide(x, total) for x in length))
