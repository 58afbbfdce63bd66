"""What a user can put in place of the engine's own parts: anomaly detectors, vector indexes, exporters of metrics."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.operators import anomalies, graph_index, identity


class AnomalyDetector(Protocol):
    """Fitted on a history, it finds events (reason, subject_id, source_id, at_ns, score, severity) in live series."""

    def fit(self, history: dict[str, DataFrame]) -> AnomalyDetector: ...

    def detect(self, live: dict[str, DataFrame]) -> DataFrame: ...


class Statistical:
    """The statistical detectors as one."""

    def __init__(self, config: anomalies.StatConfig = anomalies.StatConfig()) -> None:
        self.config, self.base = config, None

    def fit(self, history: dict[str, DataFrame]) -> Statistical:
        self.base = anomalies.baseline(history, self.config)
        return self

    def detect(self, live: dict[str, DataFrame]) -> DataFrame:
        return anomalies.detect_statistical(live, self.base, self.config)


class Graph:
    """The graph detector, with its topology."""

    def __init__(self, edges: DataFrame, config: anomalies.GraphConfig = anomalies.GraphConfig()) -> None:
        self.edges, self.config, self.history = edges, config, None

    def fit(self, history: dict[str, DataFrame]) -> Graph:
        self.history = history
        return self

    def detect(self, live: dict[str, DataFrame]) -> DataFrame:
        return anomalies.detect_graph(live, self.history, self.edges, self.config)


def detect_with(detector: AnomalyDetector, live: dict[str, DataFrame], known: DataFrame | None = None) -> DataFrame:
    """The events known so far and those that a detector finds."""
    found = detector.detect(live)
    return found if known is None else known.unionByName(found)


class VectorIndex(Protocol):
    """Finds the k nearest rows of a store (embedding_ref, vector) for queries (query_id, query)."""

    def search(self, store: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class Exact:
    def search(self, store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return identity.top_k(store, queries, k)


class Planes:
    def __init__(self, dims: int, planes: int = 6, tables: int = 12) -> None:
        self.dims, self.planes, self.tables = dims, planes, tables

    def search(self, store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return identity.lsh_top_k(store, queries, k, self.dims, self.planes, self.tables)


class SmallWorld:
    def __init__(self, degree: int = 16, beam: int = 64) -> None:
        self.degree, self.beam = degree, beam

    def search(self, store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        return graph_index.search(graph_index.build(store, self.degree), queries, k, self.beam)


def search_tracks(embeddings: DataFrame, queries: DataFrame, k: int, index: VectorIndex | None = None) -> DataFrame:
    """The k tracks (source_id, track_id) nearest to each query, by the mean of each track's vectors (source_id, track_id, vector)."""
    from trackmesh.functions import scalars as s

    pooled = identity.mean_pool(embeddings, ["source_id", "track_id"])
    store = pooled.select(s.track_key(F.col("source_id"), F.col("track_id")).alias("embedding_ref"), F.col("pooled").alias("vector"))
    hits = (index or Exact()).search(store, queries, k)
    source, track = s.track_of_key(F.col("embedding_ref"))
    return hits.select("query_id", source.alias("source_id"), track.alias("track_id"), "score")


class MetricsExporter(Protocol):
    """Takes points (a label, name, value, json) of metrics."""

    def export(self, points: DataFrame) -> None: ...


class FileExporter:
    """Appends points to a folder of JSON lines."""

    def __init__(self, path: str) -> None:
        self.path = path

    def export(self, points: DataFrame) -> None:
        points.select("json").write.mode("append").text(self.path)
