"""Text for people and monitors: metrics in exposition format and as JSON, intervals as JSON, summaries of tracking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def prometheus(metrics: DataFrame, namespace: str, label: str) -> DataFrame:
    """Counters in exposition format: a type line and a value line for every number of a row, labelled with a column."""
    names = [f.name for f in metrics.schema if f.name != label]
    value = lambda n: F.format_string(f'# TYPE {namespace}_{n} counter\n{namespace}_{n}{{{label}="%s"}} %s', F.col(label).cast("string"), F.col(n).cast("string"))
    return metrics.select(label, F.explode(F.array(*map(value, names))).alias("text"))


def metric_points(metrics: DataFrame, label: str) -> DataFrame:
    """One row (label, name, value) per number, and the point as JSON."""
    names = [f.name for f in metrics.schema if f.name != label]
    long = metrics.unpivot(label, names, "name", "value")
    return long.withColumn("json", F.to_json(F.struct("name", "value", F.struct(label).alias("attributes"))))


def as_json_array(rows: DataFrame, by: str) -> DataFrame:
    """A document per value of a column: its rows as a JSON array in the order of their fields."""
    return rows.groupBy(by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("json"))


#: Fixed names of the scores in summaries.
SCORES = ("HOTA", "DetA", "AssA", "MOTA", "IDF1", "IDSW", "Frag")


def score_of(text: Column, name: str) -> Column:
    """A score in a summary, as `name: v`, `name=v` or a JSON field; a percent sign is dropped."""
    found = F.regexp_extract(text, rf"(?i)(?:^|[^A-Za-z0-9_]){name}[\"']?\s*[:=]\s*[\"']?(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def parse_summary(summaries: DataFrame, column: str = "text") -> DataFrame:
    """The scores in each text; a text without any is an error."""
    found = summaries.select(column, *[score_of(F.col(column), n).alias(n.lower()) for n in SCORES])
    none = F.coalesce(*[F.col(n.lower()) for n in SCORES]).isNull()
    return found.withColumn(column, F.when(none, F.raise_error(F.concat(F.lit("no score in: "), F.col(column))).cast("string")).otherwise(F.col(column)))


def redaction_quality(pixels: DataFrame) -> DataFrame:
    """Mean leakage over rows that have target pixels, and mean collateral over all rows."""
    has = F.col("target") > 0
    leak = F.sum(F.when(has, F.try_divide(F.col("leaked").cast("double"), F.col("target"))))
    collateral = F.sum(F.when(F.col("background") > 0, F.try_divide(F.col("covered").cast("double"), F.col("background"))).otherwise(F.lit(0.0)))
    n = F.count("*")
    return pixels.agg(n.alias("n"), F.coalesce(leak / F.greatest(F.count_if(has), F.lit(1)), F.lit(0.0)).alias("leakage"), F.coalesce(collateral / F.greatest(n, F.lit(1)), F.lit(0.0)).alias("collateral"))
