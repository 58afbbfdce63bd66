"""The comma-separated text of tracking benchmarks: frame, id, left, top, width, height, confidence, and three unused fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_lines(samples: DataFrame) -> DataFrame:
    """A line per sample, in the order of frame and id; frames count from one, numbers have two decimals."""
    line = F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.2f,-1,-1,-1", F.col("frame_index") + 1, F.col("track_id"), F.col("left"), F.col("top"), F.col("right") - F.col("left"), F.col("bottom") - F.col("top"), F.col("confidence"))
    return samples.orderBy("frame_index", "track_id").select(line.alias("line"))


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of lines with at least seven fields; blank lines and comments are skipped, and a line that cannot be read,
    or a box of negative size, is an error."""
    text = lines.select(F.trim(column).alias("line")).filter("line <> '' and not startswith(line, '#')")
    at = F.split("line", ",")
    names = ("frame", "id", "left", "top", "width", "height", "confidence")
    rows = text.select("line", *[F.try_element_at(at, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])
    bad = F.lit(False)
    for n in names:
        bad = bad | F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf"))
    bad = bad | (F.col("width") < 0) | (F.col("height") < 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("cannot read line: "), F.col("line"))).cast("double")).otherwise(F.col("frame"))
    return rows.select(checked.cast("long").alias("frame"), F.col("id").cast("long").alias("id"), *names[2:])
