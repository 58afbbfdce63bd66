"""Shapes of masks that need a walk or a flood: filled holes, soft edges, outlines; batches of masks as pandas UDFs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The eight neighbours in turn from the right one; rows grow downwards, so the turn is clockwise as seen.
AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def _grow(seed: np.ndarray, within: np.ndarray, diagonal: bool) -> np.ndarray:
    """The seed spread over connected cells of ``within``."""
    live = seed & within
    while True:
        p = np.pad(live, 1)
        near = p[1:-1, :-2] | p[1:-1, 2:] | p[:-2, 1:-1] | p[2:, 1:-1] | live
        if diagonal:
            near |= p[:-2, :-2] | p[:-2, 2:] | p[2:, :-2] | p[2:, 2:]
        near &= within
        if (near == live).all():
            return live
        live = near


def filled(mask: np.ndarray) -> np.ndarray:
    """Background that no path of side-by-side cells joins to the border becomes foreground."""
    edge = np.zeros_like(mask)
    edge[[0, -1], :] = edge[:, [0, -1]] = True
    return ~_grow(edge, ~mask, diagonal=False)


def feathered(mask: np.ndarray, radius: int) -> np.ndarray:
    """Opacity 0 to 255: grows with the chessboard distance to the background, full at ``radius``; outside is background."""
    if radius < 1:
        raise ValueError("the radius must be positive")
    depth, live = np.zeros(mask.shape, int), mask
    for _ in range(radius):
        depth += live
        p = np.pad(live, 1)
        live = np.logical_and.reduce([p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dx, dy in (*AROUND, (0, 0))])
    return np.where(mask, np.maximum((np.minimum(depth, radius) / radius * 255 + 0.5).astype(int), 1), 0)


def outlines(mask: np.ndarray) -> list[list[tuple[float, float]]]:
    """The outer boundary of each part (cells that touch, corners too) through cell centres, clockwise from its first
    cell by rows; a part whose walk has fewer than three points has the corners of its box."""
    found, left = [], mask.copy()
    while left.any():
        y, x = (int(v) for v in np.argwhere(left)[0])
        seed = np.zeros_like(mask)
        seed[y, x] = True
        part = _grow(seed, left, diagonal=True)
        left &= ~part
        cells = np.pad(part, 1)
        walk, at, came = [], (x, y), 4  # the first cell is entered from its left
        seen = set()
        while (at, came) not in seen:
            seen.add((at, came))
            walk.append((at[0] + 0.5, at[1] + 0.5))
            for turn in range(1, 9):
                d = (came + turn) % 8
                if cells[at[1] + AROUND[d][1] + 1, at[0] + AROUND[d][0] + 1]:
                    # go on from the empty neighbour seen last, as the next cell sees it
                    e = AROUND[(d - 1) % 8]
                    back = (e[0] - AROUND[d][0], e[1] - AROUND[d][1])
                    at, came = (at[0] + AROUND[d][0], at[1] + AROUND[d][1]), AROUND.index(back)
                    break
            else:
                break
            if at == (x, y) and came == 4:
                break
        if len(walk) < 3:
            ys, xs = np.nonzero(part)
            l, t, r, b = (float(v) for v in (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1))
            walk = [(l, t), (r, t), (r, b), (l, b)]
        found.append(walk)
    return found


def _grid(cells, width: int) -> np.ndarray:
    data = np.asarray(cells) != 0
    if width < 1 or len(data) % width:
        raise ValueError("a mask's size is not a multiple of its width")
    return data.reshape(-1, width)


def _each(column: Column, width: Column, kind: str, change) -> Column:
    @F.pandas_udf(kind)
    def run(data: pd.Series, widths: pd.Series) -> pd.Series:
        return pd.Series([None if d is None else change(_grid(d, int(w))) for d, w in zip(data, widths, strict=True)], dtype=object)

    return run(column, width)


def fill_holes(data: Column, width: Column) -> Column:
    return _each(data, width, "array<int>", lambda m: filled(m).astype(int).ravel() if m.size else [])


def feather(data: Column, width: Column, radius: int) -> Column:
    return _each(data, width, "array<int>", lambda m: feathered(m, radius).ravel() if m.size else [])


def contours(data: Column, width: Column) -> Column:
    return _each(data, width, "array<array<struct<x:double,y:double>>>", lambda m: [[{"x": x, "y": y} for x, y in line] for line in outlines(m)])
