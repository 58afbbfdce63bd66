"""Checks of a table of samples, as one table of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g


def validate(samples: DataFrame) -> DataFrame:
    """(rule, n) for each rule; n counts what breaks it."""
    named = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    ids = samples.select(F.col("sample_id").alias("supersedes"))
    w = W.partitionBy("source_id").orderBy("sample_id")
    found = [
        named(samples.filter("supersedes is not null").join(ids, "supersedes", "left_anti"), "dangling_supersedes"),
        named(samples.filter(~g.is_valid(g.box()) | (g.width(g.box()) <= 0) | (g.height(g.box()) <= 0)), "degenerate_box"),
        named(samples.groupBy("sample_id").agg(F.count("*").alias("c")).filter("c > 1"), "duplicate_id"),
        named(samples.withColumn("b", F.col("pts_ns") < F.lag("pts_ns").over(w)).filter("b"), "pts_regression"),
    ]
    return reduce(DataFrame.unionByName, found)


def validate_links(samples: DataFrame, sources: DataFrame, masks: DataFrame) -> DataFrame:
    """(rule, n) of references to sources and masks (0 is none) that do not exist, of sides and scores that are no finite
    numbers, of scores outside 0 to 1, and of frames that go back."""
    named = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    w = W.partitionBy("source_id").orderBy("sample_id")
    numbers = [F.col(c) for c in ("left", "top", "right", "bottom", "confidence")]
    odd = reduce(lambda a, b: a | b, [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in numbers])
    found = [
        named(samples.join(sources.select("source_id"), "source_id", "left_anti"), "unknown_source"),
        named(samples.filter("mask_ref <> 0").join(masks.select("mask_ref"), "mask_ref", "left_anti"), "dangling_mask"),
        named(samples.filter(odd), "not_finite"),
        named(samples.filter("confidence < 0 or confidence > 1"), "score_range"),
        named(samples.withColumn("b", F.col("frame_index") < F.lag("frame_index").over(w)).filter("b"), "frame_regression"),
    ]
    return reduce(DataFrame.unionByName, found)
