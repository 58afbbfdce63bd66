"""Suppression within frames: greedy folds in SQL functions, and grouped code where rows change one another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackmesh.functions import geometry as g

_KEPT = "array<struct<neg:double,det_idx:bigint,left:double,top:double,right:double,bottom:double,class_id:int>>"


def nms(frames: DataFrame, threshold: float, class_aware: bool = True, null_matches_any: bool = False, max_det: int = 0) -> DataFrame:
    """Greedy suppression per frame: by score, then index; a box goes if its IoU with a kept one is over the threshold.

    A frame is one row of the fold, so frames run in parallel and nothing leaves the JVM.
    """
    entry = F.struct((-F.col("score")).alias("neg"), F.col("det_idx").cast("long").alias("det_idx"), *[F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")], F.col("class_id").cast("int").alias("class_id"))
    boxes = frames.groupBy("frame").agg(F.array_sort(F.collect_list(entry)).alias("boxes"))

    def step(kept, x):
        def clash(k):
            over = g.iou(g.box(source=k), g.box(source=x)) > threshold
            if not class_aware:
                return over
            same = k["class_id"].eqNullSafe(x["class_id"])
            return over & (same | k["class_id"].isNull() | x["class_id"].isNull() if null_matches_any else same)

        return F.when(F.exists(kept, clash), kept).otherwise(F.concat(kept, F.array(x)))

    kept = F.aggregate("boxes", F.array().cast(_KEPT), step)
    if max_det:
        kept = F.slice(kept, 1, max_det)
    out = boxes.select("frame", F.explode(kept).alias("k"))
    return out.select("frame", "k.det_idx", "k.left", "k.top", "k.right", "k.bottom", (-F.col("k.neg")).alias("score"), "k.class_id")


def _iou_matrix(b: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1]), 0, None)
    inter, area = w * h, (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    union = area[:, None] + area[None, :] - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


_BOXES = "frame long, det_idx long, left double, top double, right double, bottom double, score double, class_id int"
_NAMES = [c.split()[0] for c in _BOXES.split(", ")]
_BOX = ["left", "top", "right", "bottom"]


def _per_frame(frames: DataFrame, suppress_frame) -> DataFrame:
    """suppress_frame(boxes, scores, classes, indices) -> rows, for each frame; a frame is one row of arrays, so that
    Python is entered once a batch of frames and not once a frame."""
    entry = F.struct("det_idx", *[F.col(c).cast("double").alias(c) for c in (*_BOX, "score")], F.coalesce("class_id", F.lit(-1)).cast("int").alias("class_id"))
    arrays = frames.groupBy("frame").agg(F.array_sort(F.collect_list(entry)).alias("d")).select("frame", *[F.col(f"d.{c}").alias(c) for c in _NAMES[1:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for frame, idx, left, top, right, bottom, score, classes in pdf.itertuples(index=False):
                found = suppress_frame(np.stack([left, top, right, bottom], axis=1), np.array(score), np.array(classes), np.array(idx))
                rows += [(frame, *r) for r in found]
            out = pd.DataFrame(rows, columns=_NAMES)
            out["class_id"] = out["class_id"].where(out["class_id"] >= 0).astype("Int32")
            yield out

    return arrays.mapInPandas(run, _BOXES)


def soft_nms(frames: DataFrame, threshold: float = 0.5, sigma: float = 0.5, gaussian: bool = False, score_threshold: float = 0.001, class_aware: bool = True) -> DataFrame:
    """The best box decays the scores of those around it; boxes under score_threshold go."""

    def one(boxes: np.ndarray, score: np.ndarray, classes: np.ndarray, idx: np.ndarray) -> list[tuple]:
        overlap = _iou_matrix(boxes)
        decay = np.exp(-overlap * overlap / sigma) if gaussian else np.where(overlap > threshold, 1 - overlap, 1.0)
        if class_aware:
            decay = np.where(classes[:, None] == classes[None, :], decay, 1.0)
        live, rows = np.ones(len(score), bool), []
        while live.any():
            best = int(np.where(live, score, -np.inf).argmax())
            if score[best] < score_threshold:
                break
            rows.append((idx[best], *boxes[best], score[best], classes[best]))
            live[best] = False
            score = np.where(live, score * decay[best], score)
        return rows

    return _per_frame(frames, one)


def merge_nms(frames: DataFrame, threshold: float, class_aware: bool = True) -> DataFrame:
    """Boxes linked by an IoU over the threshold, directly or not, become their mean box with the best score."""

    def one(boxes: np.ndarray, score: np.ndarray, classes: np.ndarray, idx: np.ndarray) -> list[tuple]:
        linked = _iou_matrix(boxes) > threshold
        np.fill_diagonal(linked, True)
        if class_aware:
            linked &= classes[:, None] == classes[None, :]
        label = np.arange(len(score))
        while True:
            near = np.where(linked, label[None, :], len(label)).min(axis=1)
            if (near == label).all():
                break
            label = near
        rows = []
        for k in np.unique(label):
            own = label == k
            known = classes[own][classes[own] >= 0]
            rows.append((idx[own].min(), *boxes[own].mean(axis=0), max(score[own].max(), 0.0), known[-1] if len(known) else -1))
        return rows

    return _per_frame(frames, one)


def greedy_assign(tracks: DataFrame, detections: DataFrame, threshold: float) -> DataFrame:
    """One-to-one pairs per frame by IoU, then track, then detection; only IoU over the threshold counts."""
    a = tracks.select("frame", F.col("det_idx").alias("track"), *[F.col(c).alias("t_" + c) for c in _BOX])
    b = detections.select("frame", F.col("det_idx").alias("det"), *[F.col(c).alias("d_" + c) for c in _BOX])
    pairs = a.join(b, "frame").withColumn("iou", g.iou(g.box("t_"), g.box("d_"))).filter(F.col("iou") > threshold)
    entry = F.struct((-F.col("iou")).alias("neg"), "track", "det")
    sets = pairs.groupBy("frame").agg(F.array_sort(F.collect_list(entry)).alias("pairs"))
    kind = "array<struct<neg:double,track:bigint,det:bigint>>"
    step = lambda kept, x: F.when(F.exists(kept, lambda k: (k["track"] == x["track"]) | (k["det"] == x["det"])), kept).otherwise(F.concat(kept, F.array(x)))
    out = sets.select("frame", F.explode(F.aggregate("pairs", F.array().cast(kind), step)).alias("p"))
    return out.select("frame", "p.track", "p.det", (-F.col("p.neg")).alias("iou"))


def mask_nms(masks: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression by the IoU of masks of a frame (frame, det_idx, score, mask): by score, then index; a mask goes
    if its IoU with a kept one is over the threshold. Masks are folded within a frame's row, in the JVM."""
    from trackmesh.functions import masks as m

    entry = F.struct((-F.col("score")).alias("neg"), F.col("det_idx").cast("long").alias("det_idx"), F.transform("mask", lambda v: v.cast("int")).alias("mask"))
    rows = masks.groupBy("frame").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    step = lambda kept, x: F.when(F.exists(kept, lambda k: m.iou(k["mask"], x["mask"]) > threshold), kept).otherwise(F.concat(kept, F.array(x)))
    kept = F.aggregate("all", F.array().cast("array<struct<neg:double,det_idx:bigint,mask:array<int>>>"), step)
    out = rows.select("frame", F.explode(kept).alias("k"))
    return out.select("frame", "k.det_idx", (-F.col("k.neg")).alias("score"), "k.mask")
