"""A host that wires models to the engine: frames in, tracks with subjects out; and its configuration as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.operators import identity, models, tracking
from trackmesh.operators.anomalies import GraphConfig, StatConfig
from trackmesh.operators.identity import ResolveConfig
from trackmesh.streaming.machines import Gate, Tracker


@dataclass(frozen=True)
class HostConfig:
    """The settings of a host's parts."""

    gate: Gate = field(default_factory=Gate)
    tracker: Tracker = field(default_factory=Tracker)
    resolve: ResolveConfig = field(default_factory=ResolveConfig)
    statistical: StatConfig = field(default_factory=StatConfig)
    graph: GraphConfig = field(default_factory=GraphConfig)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> HostConfig:
        """A part or setting that is not given has its default; one that is not known, or of another kind, is an error."""
        given = json.loads(text)
        if not isinstance(given, dict):
            raise ValueError("a configuration is an object")
        parts = {}
        for name, settings in given.items():
            default = getattr(cls(), name, None)
            if default is None or not isinstance(settings, dict):
                raise ValueError(f"not a part of the configuration: {name}")
            known = {f.name: getattr(default, f.name) for f in fields(default)}
            for key, value in settings.items():
                if key not in known or (known[key] is not None and isinstance(value, str) != isinstance(known[key], str)):
                    raise ValueError(f"not a setting of {name}: {key}={value!r}")
            parts[name] = type(default)(**{**known, **settings})
        return cls(**parts)


class Host:
    """frames: source_id, arrival, pts_ns, width, height, pixels. references: subject_id, vector, is_positive."""

    def __init__(self, detector: models.Detector, embedder: models.Embedder | None = None, config: HostConfig | None = None) -> None:
        self.detector, self.embedder, self.config = detector, embedder, config or HostConfig()

    def track(self, frames: DataFrame) -> DataFrame:
        """Tracks of the frames that the gate lets in."""
        decided = tracking.gate(frames.select("source_id", "arrival", "pts_ns"), self.config.gate).filter("decision = 'accept'")
        seen = frames.withColumn("frame_index", F.col("arrival")).join(decided.select("source_id", "arrival"), ["source_id", "arrival"], "left_semi")
        return tracking.track(models.detect(seen, self.detector), self.config.tracker)

    def embed(self, frames: DataFrame, tracked: DataFrame) -> DataFrame:
        """A vector for each box of a track."""
        if self.embedder is None:
            raise ValueError("the host has no embedder")
        return models.embed(frames.withColumn("frame_index", F.col("arrival")), tracked, self.embedder)

    def identify(self, vectors: DataFrame, references: DataFrame) -> DataFrame:
        """Each track against the references, by the mean of its vectors: the resolver's rows, with source_id and track_id."""
        pooled = identity.mean_pool(vectors, ["source_id", "track_id"])
        ids = pooled.select(F.xxhash64("source_id", "track_id").alias("fragment_id"), "source_id", "track_id", F.col("pooled").alias("query"), F.lit(1.0).alias("topology"))
        found = identity.resolve(ids.select("fragment_id", "query", "topology"), references, self.config.resolve)
        return found.join(ids.select("fragment_id", "source_id", "track_id"), "fragment_id").drop("fragment_id")
