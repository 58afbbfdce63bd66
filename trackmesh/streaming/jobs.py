"""Streams of the driver's tables, and jobs that work off what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmesh.shared import shared_folder
from trackmesh.streaming import machines as mc
from trackmesh.streaming.fold import over_stream


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table's files as a stream, some at a time."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet")
    return source.parquet(f"{sf_dir}/{name}.parquet*")


def work_off(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, and read what it wrote. State and progress lie in the shared folder, so
    a job that is started again goes on where it was."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    job = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def gate_stream(stamps: DataFrame, config: mc.Gate | None = None) -> DataFrame:
    """Decisions per source, in order of arrival. A watermark of the whole stream would let one source's clock close
    another's frames, so each source keeps its own in the state store."""
    return over_stream(stamps, ["source_id"], ["arrival"], config or mc.Gate())


def first_hits_stream(samples: DataFrame) -> DataFrame:
    """Each subject of a source once, as soon as it is seen; the state of a pair is one flag."""
    return over_stream(samples.select("source_id", "subject_id", "pts_ns", "sample_id"), ["source_id", "subject_id"], ["pts_ns", "sample_id"], mc.FirstHits())


def windowed_counts(events: DataFrame, at: str, minutes: int = 60, lateness: str = "1 hour") -> DataFrame:
    """Rows in tumbling windows behind a watermark, partial sums before the shuffle."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    return stamped.groupBy(F.window("_at", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def rebuild_on(stream: DataFrame, rebuild, every_rows: int, progress: str):
    """Start a job that appends batches by ``rebuild(batch, due)``; ``due`` tells that ``every_rows`` more rows have come
    since the last rebuild. The count is that of the running query: a restart begins with a rebuild."""
    seen = {"rows": every_rows}

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        try:
            seen["rows"] += df.count()
            due = seen["rows"] >= every_rows
            rebuild(df, due)
            if due:
                seen["rows"] = 0
        finally:
            df.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", progress).trigger(availableNow=True).start()
