"""Sets of keypoints: array<struct<x, y, score, idx>> columns, and a store of them by handle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackmesh.operators import memory


def keypoint(x: Column, y: Column, score: Column, idx: Column) -> Column:
    """One keypoint; a value that is not finite is an error."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    x, y, score = (c.cast("double") for c in (x, y, score))
    point = F.struct(x.alias("x"), y.alias("y"), score.alias("score"), idx.cast("int").alias("idx"))
    return F.when(finite(x) & finite(y) & finite(score), point).otherwise(F.raise_error(F.lit("a keypoint is not finite")).cast("struct<x:double,y:double,score:double,idx:int>"))


def insert(store: DataFrame, sets: DataFrame, order: list[str]) -> DataFrame:
    """The store (keypoints_ref, points) with further sets (order columns, points), whose handles go on from its largest."""
    new = sets.withColumns({"keypoints_ref": F.lit(0).cast("long"), "supersedes": F.lit(None).cast("long")})
    numbered = memory.append_ids(store.withColumn("revision", F.lit(1).cast("long")), new, order, key="keypoints_ref")
    return store.unionByName(numbered.select("keypoints_ref", "points"))


def bounds(points: Column) -> Column:
    """struct<left, top, right, bottom> of a set; null for an empty one."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom")))


def confident(points: Column, least: float) -> Column:
    return F.filter(points, lambda p: p["score"] >= least)
