"""Hooks for models of the host: detectors and embedders over tables of frames, and decoding of detectors' output."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.functions import images
from trackmesh.operators import suppress
from trackmesh.session import ship

_FRAME = "source_id long, frame_index long, pts_ns long"
_KEYS = ["source_id", "frame_index", "pts_ns"]
_BOX = ["left", "top", "right", "bottom"]


class Detector(Protocol):
    """Loaded once per task; gives (left, top, right, bottom, score, class or None) rows of an image."""

    def load(self) -> None: ...

    def detect(self, image: np.ndarray) -> list[tuple]: ...


class Embedder(Protocol):
    """Loaded once per task; gives the vector of an image."""

    def load(self) -> None: ...

    def embed(self, image: np.ndarray) -> np.ndarray: ...


def detect(frames: DataFrame, detector: Detector) -> DataFrame:
    """Detections of frames (source_id, frame_index, pts_ns, width, height, pixels), a row per box."""
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector.load()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                found = detector.detect(images.unpack(r.pixels, r.width, r.height))
                rows += [(r.source_id, r.frame_index, r.pts_ns, i, *map(float, b[:5]), b[5]) for i, b in enumerate(found)]
            out = pd.DataFrame(rows, columns=[*_KEYS, "det_idx", *_BOX, "score", "class_id"])
            out["class_id"] = out["class_id"].astype("Int32")
            yield out

    schema = _FRAME + ", det_idx long, left double, top double, right double, bottom double, score double, class_id int"
    return frames.select(*_KEYS, "width", "height", "pixels").mapInPandas(run, schema)


def embed(frames: DataFrame, boxes: DataFrame, embedder: Embedder) -> DataFrame:
    """A vector per box (source_id, frame_index, track_id, sides) of its crop. Boxes are gathered by frame before they
    meet the pixels, so that a frame's pixels are moved once."""
    ship(frames.sparkSession)
    per = boxes.groupBy("source_id", "frame_index").agg(F.collect_list(F.struct("track_id", *_BOX)).alias("boxes"))
    cut = frames.select("source_id", "frame_index", "width", "height", "pixels").join(per, ["source_id", "frame_index"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder.load()
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                image = images.unpack(r.pixels, r.width, r.height)
                for b in r.boxes:
                    part = images.crop(image, *(b[c] for c in _BOX))
                    rows.append((r.source_id, r.frame_index, b["track_id"], [float(v) for v in embedder.embed(part)]))
            yield pd.DataFrame(rows, columns=["source_id", "frame_index", "track_id", "vector"])

    return cut.mapInPandas(run, "source_id long, frame_index long, track_id long, vector array<double>")


class MeanColour:
    """A stand-in for a model, for tests: one box over all, and mean colours as vectors."""

    def load(self) -> None:
        pass

    def detect(self, image: np.ndarray) -> list[tuple]:
        h, w = image.shape[:2]
        return [(0, 0, w, h, round(float(image.mean()) / 255, 6), None)]

    def embed(self, image: np.ndarray) -> np.ndarray:
        return image.reshape(-1, 3).mean(axis=0) / 255


def decode_rows(values: np.ndarray, least: float) -> np.ndarray:
    """(left, top, right, bottom, score, class) of candidates in rows, -1 for no class.

    Six values with ordered corners are a box, its score and class; else centre and size lead, then an objectness with
    class scores (85 values: the best one times it; 5: it alone), or class scores only.
    """
    n, width = values.shape
    if width < 4:
        raise ValueError("a candidate needs four values")
    x, y, w, h = (values[:, i] for i in range(4))
    boxes = np.column_stack([x - w / 2, y - h / 2, x + w / 2, y + h / 2])
    score, cls = np.ones(n), np.full(n, -1.0)
    if width == 5:
        score = values[:, 4]
    elif width > 5:
        lead = 5 if width == 85 else 4
        cls = values[:, lead:].argmax(axis=1).astype(float)
        score = values[:, lead:].max(axis=1) * (values[:, 4] if lead == 5 else 1.0)
    if width == 6:
        done = (values[:, 2] > x) & (values[:, 3] > y) & (values[:, 4] >= least)
        boxes = np.where(done[:, None], values[:, :4], boxes)
        score, cls = np.where(done, values[:, 4], score), np.where(done, values[:, 5], cls)
    found = np.column_stack([boxes, score, cls])
    return found[np.isfinite(found).all(axis=1) & (score >= least)]


def decode(outputs: DataFrame, channels_first: bool, least: float = 0.25, nms: float = 0.45, most: int = 300) -> DataFrame:
    """Detections of a model's raw output per frame.

    Rows: frame, raw (array of numbers), channels, and the placement (scale_x, scale_y, pad_x, pad_y, source_w, source_h).
    Boxes are put back in the source, then suppressed by class, and the best ``most`` of a frame stay.
    """
    ship(outputs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for r in pdf.itertuples(index=False):
                raw = np.asarray(r.raw, float)
                values = raw.reshape(r.channels, -1).T if channels_first else raw.reshape(-1, r.channels)
                found = decode_rows(values, least)
                place = images.Placement(r.scale_x, r.scale_y, r.pad_x, r.pad_y, r.source_w, r.source_h)
                part = pd.DataFrame(place.to_source(found[:, :4]), columns=_BOX)
                parts.append(part.assign(frame=r.frame, det_idx=np.arange(len(found)), score=found[:, 4], class_id=np.maximum(found[:, 5], 0).astype(int)))
            yield pd.concat(parts)[["frame", "det_idx", *_BOX, "score", "class_id"]] if parts else pd.DataFrame(columns=["frame", "det_idx", *_BOX, "score", "class_id"])

    boxes = outputs.select("frame", "raw", "channels", "scale_x", "scale_y", "pad_x", "pad_y", "source_w", "source_h").mapInPandas(run, "frame long, det_idx long, left double, top double, right double, bottom double, score double, class_id int")
    return suppress.nms(boxes, nms, max_det=most)
