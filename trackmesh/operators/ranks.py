"""Running sums and medians over whole tables, without a task that sorts or holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 64


def running(df: DataFrame, by: str, order: list[str], sums: dict[str, str], descending: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with running sums (new name: column) in the order of by, then order; by decides the direction of both.

    Rows are dealt into PARTS ranges of `by`, each summed on its own behind the totals of those before it. Equal values of
    `by` share a range, so count equal rows first where one value may hold many. With keys (none of them null), each key's
    rows are summed apart.
    """
    bounds = df.agg(F.percentile_approx(by, [i / PARTS for i in range(1, PARTS)], 1000).alias("_bounds"))  # one row
    part = F.size(F.filter("_bounds", lambda x: x < F.col(by)))
    rows = df.crossJoin(F.broadcast(bounds)).withColumn("_part", -part if descending else part).drop("_bounds")
    totals = rows.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each of at most PARTS ranges
    before = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    turn = F.desc if descending else F.asc
    w = W.partitionBy(*keys, "_part").orderBy(*[turn(c) for c in [by, *order]]).rowsBetween(W.unboundedPreceding, 0)
    return rows.join(before if keys else F.broadcast(before), [*keys, "_part"]).withColumns({n: F.sum(c).over(w) + F.col(f"_{n}") for n, c in sums.items()}).drop("_part", *[f"_{n}" for n in sums])


def median(df: DataFrame, value: str) -> DataFrame:
    """One row: the median, found by rank among counts of equal values; null where there is no value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    ranked = running(counts, "v", [], {"upto": "n"}).crossJoin(F.broadcast(total))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    return ranked.agg(((at(F.expr("(all - 1) div 2")) + at(F.expr("all div 2"))) / 2).alias("median"))
