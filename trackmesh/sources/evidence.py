"""Packs of evidence: small reports written as CSV, JSON and one Markdown text; and the inventory of model files."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reports are aggregates; more rows than this are an error and not a pack.
MOST_ROWS = 10_000


def markdown_lines(report: DataFrame, title: str) -> DataFrame:
    """(place, line): a report as a Markdown table, its rows in the order of their columns."""
    spark, names = report.sparkSession, report.columns
    head = [(0, f"## {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "| " + " | ".join("---" for _ in names) + " |")]
    cells = F.concat(F.lit("| "), F.array_join(F.array(*[F.col(f"`{c}`").cast("string") for c in names]), " | ", ""), F.lit(" |"))
    rows = report.select(F.lit(4).alias("place"), cells.alias("line"))
    return spark.createDataFrame(head, "place int, line string").unionByName(rows)


def write_pack(reports: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Write each report as <folder>/<name>.csv and .json and all as <folder>/report.md; the paths by name."""
    paths, lines = {}, None
    for i, (name, report) in enumerate(reports.items()):
        if report.limit(MOST_ROWS + 1).count() > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows; aggregate it first")
        one = report.coalesce(1)  # at most MOST_ROWS rows
        one.write.option("header", True).csv(f"{folder}/{name}.csv")
        one.write.json(f"{folder}/{name}.json")
        paths |= {f"{name}.csv": f"{folder}/{name}.csv", f"{name}.json": f"{folder}/{name}.json"}
        part = markdown_lines(report, name).withColumn("part", F.lit(i))
        lines = part if lines is None else lines.unionByName(part)
    if lines is not None:
        lines.coalesce(1).sortWithinPartitions("part", "place", "line").select("line").write.text(f"{folder}/report.md")
        paths["report.md"] = f"{folder}/report.md"
    return paths


class ModelFetcher(Protocol):
    """Puts the file of a model where it is wanted."""

    def fetch(self, name: str, path: str) -> None: ...


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(name, length, sha256) of the model files in a folder; none where there is no folder."""
    try:
        files = spark.read.format("binaryFile").load(folder)
    except Exception as fault:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(fault):
            raise
        return spark.createDataFrame([], "name string, length long, sha256 string")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def ensure_models(spark: SparkSession, wanted: dict[str, str], folder: str, fetcher: ModelFetcher) -> DataFrame:
    """Fetch the models (name: digest) that are missing or not what they should be; an error if one still is not."""
    have = {r.name: r.sha256 for r in inventory(spark, folder).collect()}  # a row for each model
    for name, digest in wanted.items():
        if have.get(name) != digest:
            fetcher.fetch(name, f"{folder}/{name}")
    found = inventory(spark, folder)
    have = {r.name: r.sha256 for r in found.collect()}
    wrong = [name for name, digest in wanted.items() if have.get(name) != digest]
    if wrong:
        raise ValueError(f"not what they should be: {', '.join(wrong)}")
    return found
