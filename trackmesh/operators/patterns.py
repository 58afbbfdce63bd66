"""The nine pattern miners. Each yields (kind, subject_id, subject_b, bucket, count, total, confidence, tag)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.functions import scalars as s
from trackmesh.operators import memory, pairs
from trackmesh.shared import write_once

COLUMNS = ("kind", "subject_id", "subject_b", "bucket", "n", "confidence", "tag")


def _rows(df: DataFrame, kind: str, subject="subject_id", subject_b=None, bucket=None, n="n", confidence="confidence", tag=None) -> DataFrame:
    col = lambda c, kind_: (F.col(c) if isinstance(c, str) else c if isinstance(c, Column) else F.lit(c)).cast(kind_)
    return df.select(F.lit(kind).alias("kind"), col(subject, "long").alias("subject_id"), col(subject_b, "long").alias("subject_b"), col(bucket, "long").alias("bucket"), col(n, "long").alias("n"), col(confidence, "double").alias("confidence"), col(tag, "long").alias("tag"))


def _modal(timed: DataFrame, bucket: Column, kind: str) -> DataFrame:
    """The most frequent bucket of each subject (unknown is a subject), of equals the one seen first."""
    per = timed.groupBy("subject_id", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    best = per.groupBy("subject_id").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("first")).alias("early"), "bucket")).alias("top"))
    rows = best.filter("total >= 3 and top.n >= 2").select("subject_id", F.col("top.bucket").alias("bucket"), F.col("top.n").alias("n"), (F.col("top.n") / F.col("total")).alias("confidence"))
    return _rows(rows, kind, bucket="bucket", tag="bucket")


def time_of_day(timed: DataFrame) -> DataFrame:
    return _modal(timed, s.hour_of_day(F.col("at_ns")), "time_of_day")


def day_of_week(timed: DataFrame) -> DataFrame:
    return _modal(timed, s.day_of_week(F.col("at_ns")), "day_of_week")


def gaps(timed: DataFrame, keys: tuple[str, ...] = ("subject_id",)) -> DataFrame:
    """Successive differences of a subject's times."""
    w = W.partitionBy(*keys).orderBy("at_ns", "event_id")
    return timed.withColumn("gap_ns", F.col("at_ns") - F.lag("at_ns").over(w)).filter("gap_ns is not null")


def visit_periodicity(timed: DataFrame) -> DataFrame:
    found = gaps(timed.filter("subject_id is not null")).filter("gap_ns > 0").groupBy("subject_id").agg(F.count("*").alias("n"), F.stddev_pop("gap_ns").alias("sd"), F.median("gap_ns").alias("median"))
    rows = found.filter("n >= 2").withColumn("confidence", 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("sd", "median"))))
    return _rows(rows.filter("confidence >= 0.35"), "visit_periodicity", tag=s.saturated_tag(F.floor("median")))


def dwell_distribution(durations: DataFrame) -> DataFrame:
    found = durations.filter("subject_id is not null and duration_ns > 0").groupBy("subject_id").agg(F.count("*").alias("n"), F.avg("duration_ns").alias("mean"), F.stddev_pop("duration_ns").alias("sd"))
    rows = found.filter("n >= 2").withColumn("confidence", 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("sd", "mean"))))
    return _rows(rows, "dwell_distribution", tag=s.saturated_tag(F.floor("mean")))


def _shared(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts by key, and the share of all rows; the total is one row."""
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(*by).agg(F.count("*").alias("n")).filter("n >= 2").crossJoin(F.broadcast(total)).withColumn("confidence", F.col("n") / F.col("total"))


def route_sequence(routes: DataFrame) -> DataFrame:
    rows = _shared(routes.withColumn("key", s.route_key(F.col("zones"))), ["subject_id", "key"])
    return _rows(rows, "route_sequence", tag="key")


def co_occurrence(counts: DataFrame, total: DataFrame) -> DataFrame:
    """From the counts of pairs: those that meet twice at least, and their share of all meetings (total: one row)."""
    rows = counts.filter("n >= 2").crossJoin(F.broadcast(total)).withColumn("confidence", F.col("n") / F.col("total"))
    return _rows(rows, "co_occurrence", subject="a", subject_b="b", tag=s.pair_tag(F.col("a"), F.col("b")))


def met_in_all(met: DataFrame) -> DataFrame:
    """One row: the number of meetings, each of which is counted by both its subjects in met (subject_id, n)."""
    return met.agg(F.expr("sum(n) div 2").alias("total"))


def expected_absence(timed: DataFrame) -> DataFrame:
    found = gaps(timed.filter("subject_id is not null")).filter("gap_ns > 0").groupBy("subject_id").agg(F.count("*").alias("n"), F.stddev_pop("gap_ns").alias("sd"), F.median("gap_ns").alias("median"))
    rows = found.filter(f"n >= 2 and median >= {s.NS_HOUR}").withColumn("confidence", 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide("sd", "median"))))
    return _rows(rows, "expected_absence", tag=s.saturated_tag(F.floor(F.col("median") / 1_000_000_000)))


def group_formation(met: DataFrame) -> DataFrame:
    """From how often each subject meets others (subject_id, n; see memory.meetings): those that do three times at least."""
    return _rows(met.filter("n >= 3").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 10)), "group_formation", tag="n")


def event_before_event(timed: DataFrame, max_gap_ns: int = 0) -> DataFrame:
    """Adjacent events of different kinds; max_gap_ns 0 is any gap."""
    w = W.partitionBy("subject_id").orderBy("at_ns", "event_id")
    rows = timed.filter("subject_id is not null and kind_tag <> 0").select("subject_id", F.col("kind_tag").alias("a"), F.lead("kind_tag").over(w).alias("b"), (F.lead("at_ns").over(w) - F.col("at_ns")).alias("gap"))
    rows = rows.filter("b is not null and a <> b")
    if max_gap_ns:
        rows = rows.filter(F.col("gap") <= max_gap_ns)
    found = rows.groupBy("subject_id", "a", "b").agg(F.count("*").alias("n")).filter("n >= 2").withColumn("confidence", F.least(F.lit(1.0), F.col("n") / 5))
    return _rows(found, "event_before_event", bucket="b", tag=F.col("a") * 65536 + F.col("b").bitwiseAND(F.lit(0xFFFF).cast("long")))


def mine_all(series: dict[str, DataFrame]) -> DataFrame:
    """All miners over the analysis inputs; those of pairs look at the stays, so that no table of pairs is made."""
    timed, met, counts = series["timed"], write_once(memory.meetings(series["stays"]), "meetings"), pairs.counts(series["stays"], 2)
    found = [event_before_event(timed), time_of_day(timed), day_of_week(timed), visit_periodicity(timed), dwell_distribution(series["durations"]), route_sequence(series["routes"]), co_occurrence(counts, met_in_all(met)), expected_absence(timed), group_formation(met)]
    return reduce(DataFrame.unionByName, found)
