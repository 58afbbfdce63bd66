"""Scores, clocks, keys and vectors as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NS_HOUR, NS_DAY = 3_600_000_000_000, 86_400_000_000_000
#: Largest unsigned 32-bit value: tags saturate at it.
U32 = 4294967295
#: Severity names from mild to severe, and the z from which the later ones hold.
SEVERITIES = ("low", "medium", "high", "critical")
Z_STEPS, GRAPH_STEPS = (3.5, 4.5, 6.0), (3.5, 6.0, 10.0)


def cosine(a: Column, b: Column) -> Column:
    """Null for empty, unequal lengths, values that are not finite, or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    under = norm(a) * norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (under > 0) & (under < float("inf")) & ~F.isnan(dot)
    return F.when(ok, F.try_divide(dot, under))


def z_score(value: Column, mean: Column, sigma: Column) -> Column:
    """Absolute; without spread 0 at the mean and infinite elsewhere."""
    gap = F.abs(value - mean)
    return F.when(sigma > 1e-6, F.try_divide(gap, sigma)).otherwise(F.when(gap <= 1e-6, F.lit(0.0)).otherwise(F.lit(float("inf"))))


def robust_z(value: Column, median: Column, mad: Column) -> Column:
    gap = F.abs(value - median)
    return F.when(mad > 1e-6, F.try_divide(gap * 0.6745, mad)).otherwise(F.when(gap <= 1e-6, F.lit(0.0)).otherwise(F.lit(float("inf"))))


def hour_of_day(ns: Column) -> Column:
    return F.floor(F.pmod(ns, F.lit(NS_DAY)) / NS_HOUR).cast("int")


def day_of_week(ns: Column) -> Column:
    """0 is the day of the epoch, a Thursday."""
    return F.pmod(F.floor(ns / NS_DAY), F.lit(7)).cast("int")


def hour_delta(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def severity(score: Column, steps: tuple[float, ...] = Z_STEPS) -> Column:
    out = F.lit(SEVERITIES[0])
    for step, name in zip(steps, SEVERITIES[1:], strict=True):
        out = F.when(score >= step, F.lit(name)).otherwise(out)
    return out


def media_time_ns(ticks: str, timescale: str) -> Column:
    """ticks / timescale (column names) in nanoseconds, truncated towards zero, without overflow on the way."""
    return F.expr(f"({ticks} div {timescale}) * 1000000000 + (({ticks} % {timescale}) * 1000000000) div {timescale}")


def fused_identity(similarity: Column, *factors: Column) -> Column:
    """The similarity mapped to 0..1 times five factors, each clamped to 0..1."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = clamp((similarity + 1) / 2)
    for f in factors:
        out = out * clamp(f)
    return out


def route_key(zones: Column) -> Column:
    """32-bit FNV-1a over whole zone ids."""
    return F.aggregate(zones, F.lit(2166136261).cast("long"), lambda h, z: F.expr("cast(4294967295 as bigint)").bitwiseAND(h.bitwiseXOR(z.cast("long")) * 16777619))


def pair_tag(a: Column, b: Column) -> Column:
    low = F.lit(0xFFFF).cast("long")
    return F.shiftleft(b.bitwiseAND(low), 16).bitwiseOR(a.bitwiseAND(low))


def saturated_tag(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value, F.lit(U32))).cast("long")


def contains_run(route: Column, needle: list[int]) -> Column:
    """Whether an array holds a contiguous run."""
    n = len(needle)
    want = F.array(*[F.lit(z).cast("int") for z in needle])
    places = F.sequence(F.lit(1), F.greatest(F.size(route) - n + 1, F.lit(1)))
    return (F.size(route) >= n) & F.exists(places, lambda i: F.slice(route, i, F.lit(n)) == want)


def names(kinds: tuple[str, ...], ordinal: Column) -> Column:
    """The name of an ordinal that counts from one."""
    return F.element_at(F.array(*map(F.lit, kinds)), ordinal.cast("int"))


def track_key(source: Column, track: Column) -> Column:
    """A source and a track of it in one number: the source in the upper 32 bits (negative from source 2**31 on)."""
    return F.shiftleft(source.cast("long"), 32).bitwiseOR(track.cast("long").bitwiseAND(F.lit(U32).cast("long")))


def track_of_key(key: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(key, 32).cast("long"), key.bitwiseAND(F.lit(U32).cast("long"))


def class_factor(asked: Column, known: Column) -> Column:
    """1 unless both classes are there and differ."""
    return F.when(asked.isNotNull() & known.isNotNull() & (asked != known), F.lit(0.0)).otherwise(F.lit(1.0))


def time_factor(last_ns: Column, now_ns: Column, most_gap_ns: int | None) -> Column:
    """0 if the last sighting is further away than allowed, else 1; so it is without a sighting or a limit."""
    if most_gap_ns is None:
        return F.lit(1.0)
    return F.when(F.coalesce(F.abs(now_ns - last_ns) > most_gap_ns, F.lit(False)), F.lit(0.0)).otherwise(F.lit(1.0))


def fnv64(data: Column) -> Column:
    """64-bit FNV-1a of binary values, as a signed long; null for null."""
    @F.pandas_udf("long")
    def checksum(values: pd.Series) -> pd.Series:
        there = [b"" if v is None else bytes(v) for v in values]
        size = np.array(list(map(len, there)))
        out = np.full(len(there), 0xCBF29CE484222325, np.uint64)
        for at in range(int(size.max()) if len(size) else 0):  # byte by byte over all values
            live = np.flatnonzero(size > at)
            out[live] = (out[live] ^ np.array([there[i][at] for i in live], np.uint64)) * np.uint64(0x100000001B3)
        return pd.Series(out.view(np.int64)).where(values.notna()).astype("Int64")

    return checksum(data)
