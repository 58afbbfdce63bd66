"""Motion of a track's box centre, and membership of zones over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g


def trajectory(samples: DataFrame) -> DataFrame:
    """First and second differences of the centre by sample, and the mean absolute step of the track so far."""
    w = W.partitionBy("source_id", "track_id").orderBy("pts_ns", "sample_id")
    x, y = g.center(g.box())
    rows = samples.select("sample_id", "source_id", "track_id", "pts_ns", x.alias("x"), y.alias("y"))
    rows = rows.withColumns({"vx": F.col("x") - F.lag("x").over(w), "vy": F.col("y") - F.lag("y").over(w)})
    rows = rows.withColumns({"ax": F.col("vx") - F.lag("vx").over(w), "jitter": F.avg(F.abs("vx") + F.abs("vy")).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return rows.select("sample_id", "vx", "vy", "ax", "jitter")


def zone_events(samples: DataFrame, inside: Column) -> DataFrame:
    """Changes of membership in a zone; a track that is inside at first has entered."""
    w = W.partitionBy("source_id", "track_id").orderBy("pts_ns", "sample_id")
    rows = samples.withColumn("_in", inside).withColumn("_was", F.lag("_in", 1, False).over(w)).filter("_in <> _was")
    return rows.select("sample_id", "source_id", "track_id", F.when(F.col("_in"), "entered").otherwise("exited").alias("event"))
