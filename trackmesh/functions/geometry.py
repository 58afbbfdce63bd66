"""Boxes, lines and polygons as column expressions; all of them stay in whole-stage code."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "", source: Column | None = None) -> Box:
    """left, top, right, bottom columns, or fields of a struct."""
    get = (lambda n: source[n]) if source is not None else (lambda n: F.col(prefix + n))
    return get("left"), get("top"), get("right"), get("bottom")


def literal_box(left: float, top: float, right: float, bottom: float) -> Box:
    return tuple(F.lit(float(v)) for v in (left, top, right, bottom))


def is_valid(b: Box) -> Column:
    """Finite, and not inside out; a box without area is valid."""
    finite = F.lit(True)
    for c in b:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return finite & (b[2] >= b[0]) & (b[3] >= b[1])


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return b[0] * 0.5 + b[2] * 0.5, b[1] * 0.5 + b[3] * 0.5


def anchor(b: Box, policy: str, mask_centroid: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """The point that stands for a box: 'center', 'bottom_center', or 'mask_centroid' (the centre where there is none)."""
    x, y = center(b)
    if policy == "bottom_center":
        return x, b[3]
    if policy == "mask_centroid" and mask_centroid is not None:
        return F.coalesce(mask_centroid[0], x), F.coalesce(mask_centroid[1], y)
    return x, y


def intersection_area(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, F.try_divide(over, under)).otherwise(F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    inter = intersection_area(a, b)
    return _ratio(inter, area(a) + area(b) - inter)


def ios(a: Box, b: Box) -> Column:
    return _ratio(intersection_area(a, b), F.least(area(a), area(b)))


def overlaps(a: Box, b: Box) -> Column:
    """Open intervals: boxes that only touch do not overlap."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def side(start: tuple, end: tuple, x: Column, y: Column) -> Column:
    """1 left of the directed line, -1 right of it, 0 on it."""
    cross = (F.lit(end[0]) - F.lit(start[0])) * (y - F.lit(start[1])) - (F.lit(end[1]) - F.lit(start[1])) * (x - F.lit(start[0]))
    return F.signum(cross).cast("int")


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_cross(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column]) -> Column:
    """Whether two closed segments share a point; end points and collinear touching count."""
    s1, s2 = _cross(*c, *d, *a), _cross(*c, *d, *b)
    s3, s4 = _cross(*a, *b, *c), _cross(*a, *b, *d)

    def within(p: tuple, q: tuple, r: tuple) -> Column:
        return (F.least(p[0], q[0]) <= r[0]) & (r[0] <= F.greatest(p[0], q[0])) & (F.least(p[1], q[1]) <= r[1]) & (r[1] <= F.greatest(p[1], q[1]))

    touching = ((s1 == 0) & within(c, d, a)) | ((s2 == 0) & within(c, d, b)) | ((s3 == 0) & within(a, b, c)) | ((s4 == 0) & within(a, b, d))
    return ((s1 * s2 < 0) & (s3 * s4 < 0)) | touching


def in_polygon(points: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd rule, with the boundary inside. The polygon is a constant of at least three points."""
    if len(points) < 3:
        raise ValueError("a polygon needs three points")
    inside, edge = F.lit(False), F.lit(False)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True):
        cross = F.lit(x2 - x1) * (y - F.lit(y1)) - F.lit(y2 - y1) * (x - F.lit(x1))
        on = (cross == 0) & (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
        edge = edge | on
        if y1 != y2:
            meets = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < F.lit(x2 - x1) * (y - F.lit(y1)) / F.lit(y2 - y1) + F.lit(x1))
            inside = inside != meets
    return edge | inside


def oriented_corners(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> list[tuple[Column, Column]]:
    """Corners of a rotated box, counter-clockwise from the one at (-w/2, -h/2)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return [(cx + dx * w / 2 * c - dy * h / 2 * s, cy + dx * w / 2 * s + dy * h / 2 * c) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def oriented_bounds(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Box:
    xs, ys = zip(*oriented_corners(cx, cy, w, h, degrees), strict=True)
    return F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)


def lerp_box(a: Box, b: Box, t: Column) -> Box:
    """The box between two at t, clamped to 0 and 1."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return tuple(p + (q - p) * u for p, q in zip(a, b, strict=True))


def from_letterbox(x: Column, y: Column, scale: Column, pad_x: Column, pad_y: Column, source_w: Column, source_h: Column) -> tuple[Column, Column]:
    """A point of the padded model input in the source image, clamped to it."""
    clamp = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    return clamp((x - pad_x) / scale, source_w), clamp((y - pad_y) / scale, source_h)


def tiles(frame_w: Column, frame_h: Column, tile: int, overlap: int) -> Column:
    """Row-major windows array<struct<x, y, w, h>>; the last of a row or column is moved to the frame's edge."""
    if not 0 <= overlap < tile:
        raise ValueError("the overlap must be less than the tile")
    step = tile - overlap

    def starts(size: Column) -> Column:
        last = F.greatest(size - tile, F.lit(0))
        n = F.ceil(last / step).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.least(i * step, last))

    at = lambda y: F.transform(starts(frame_w), lambda x: F.struct(x.alias("x"), y.alias("y"), F.least(F.lit(tile), frame_w).alias("w"), F.least(F.lit(tile), frame_h).alias("h")))
    return F.flatten(F.transform(starts(frame_h), at))


def to_global(b: Box, x: Column, y: Column) -> Box:
    """A tile's box in the frame, the tile's corner at (x, y)."""
    return b[0] + x, b[1] + y, b[2] + x, b[3] + y


def _corners(r: pd.DataFrame) -> np.ndarray:
    """The corners of rotated boxes, counterclockwise: rows, four, x and y."""
    t = np.radians(r["degrees"].to_numpy(float))[:, None]
    x, y = np.array([-1, 1, 1, -1]) * r["w"].to_numpy(float)[:, None] / 2, np.array([-1, -1, 1, 1]) * r["h"].to_numpy(float)[:, None] / 2
    return np.stack([x * np.cos(t) - y * np.sin(t) + r["cx"].to_numpy(float)[:, None], x * np.sin(t) + y * np.cos(t) + r["cy"].to_numpy(float)[:, None]], axis=2)


def _turns(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _common_area(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The area that each two convex quadrilaterals share: its corners are theirs that lie in the other one, and crossings of
    their sides; in the order of their angles around the middle they bound it."""
    sides_p, sides_q = np.roll(p, -1, axis=1) - p, np.roll(q, -1, axis=1) - q
    scale = np.abs(sides_p).max(axis=(1, 2), initial=1e-9) * np.abs(sides_q).max(axis=(1, 2), initial=1e-9)
    within = lambda points, start, side: (_turns(side[:, None], points[:, :, None] - start[:, None]) >= -1e-12 * scale[:, None, None]).all(axis=2)
    apart = q[:, None] - p[:, :, None]
    turn = _turns(sides_p[:, :, None], sides_q[:, None])
    meets = np.abs(turn) > 1e-12 * scale[:, None, None]
    safe = np.where(meets, turn, 1.0)
    t, u = _turns(apart, sides_q[:, None]) / safe, _turns(apart, sides_p[:, :, None]) / safe
    meets &= (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    crossings = p[:, :, None] + t[..., None] * sides_p[:, :, None]
    n = len(p)
    points = np.concatenate([p, q, crossings.reshape(n, 16, 2)], axis=1)
    there = np.concatenate([within(p, q, sides_q), within(q, p, sides_p), meets.reshape(n, 16)], axis=1)
    middle = np.where(there[..., None], points, 0).sum(axis=1) / np.maximum(there.sum(axis=1), 1)[:, None]
    points = points - middle[:, None]
    angle = np.where(there, np.arctan2(points[..., 1], points[..., 0]), np.inf)
    order = np.argsort(angle, axis=1)
    points, there = np.take_along_axis(points, order[..., None], axis=1), np.take_along_axis(there, order, axis=1)
    points = np.where(there[..., None], points, points[:, :1])  # the others fall on the first
    return np.where(there.any(axis=1), np.abs(_turns(points, np.roll(points, -1, axis=1)).sum(axis=1)) / 2, 0.0)


def oriented_iou(a: Column, b: Column) -> Column:
    """IoU of rotated boxes struct<cx, cy, w, h, degrees>; 0 where one has no area. A batch of pairs at a time."""

    @F.pandas_udf("double")
    def run(one: pd.DataFrame, two: pd.DataFrame) -> pd.Series:
        sizes = one["w"].to_numpy(float) * one["h"].to_numpy(float), two["w"].to_numpy(float) * two["h"].to_numpy(float)
        solid = np.minimum(*sizes) > 0
        inter = np.where(solid, _common_area(_corners(one), _corners(two)), 0.0)
        return pd.Series(inter / np.where(solid, sizes[0] + sizes[1] - inter, 1.0))

    return run(a, b)
