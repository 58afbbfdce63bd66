"""Dense masks (row-major arrays, non-zero is set) and run lengths (background first) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(data: Column) -> Column:
    return F.size(F.filter(data, lambda v: v != 0))


def bbox(data: Column, width: Column) -> Column:
    """struct<left, top, right, bottom>, the right and bottom outside; null for an empty mask."""
    places = F.filter(F.transform(data, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(places, lambda i: i % width), F.transform(places, lambda i: F.floor(i / width).cast("int"))
    found = F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), (F.array_max(xs) + 1).alias("right"), (F.array_max(ys) + 1).alias("bottom"))
    return F.when(F.size(places) > 0, found)


def crop(data: Column, width: Column) -> Column:
    """The rows of the bounding box, cut to it and joined."""
    b = bbox(data, width)
    rows = F.sequence(b["top"], b["bottom"] - 1)
    return F.when(b.isNotNull(), F.flatten(F.transform(rows, lambda y: F.slice(data, y * width + b["left"] + 1, b["right"] - b["left"]))))


def rle_encode(data: Column) -> Column:
    """Lengths of alternating runs, the first of background (0 where the first cell is set)."""
    # cells where the value changes, with a background cell put before the first
    bits = F.transform(data, lambda v: (v != 0).cast("int"))
    before = F.concat(F.array(F.lit(0)), bits)
    cuts = F.filter(F.transform(bits, lambda v, i: F.when(v != F.element_at(before, i + 1), i)), lambda i: i.isNotNull())
    ends = F.concat(cuts, F.array(F.size(data)))
    starts = F.concat(F.array(F.lit(0)), cuts)
    return F.zip_with(ends, starts, lambda e, s: (e - s).cast("long"))


def rle_decode(counts: Column) -> Column:
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat((i % 2).cast("int"), n.cast("int"))))


def rle_area(counts: Column) -> Column:
    return F.aggregate(F.transform(counts, lambda n, i: F.when(i % 2 == 1, n).otherwise(0)), F.lit(0).cast("long"), lambda s, n: s + n)


def _both(a: Column, b: Column, keep) -> Column:
    same = F.assert_true(F.size(a) == F.size(b), F.lit("masks differ in size"))
    return F.when(same.isNull(), F.zip_with(a, b, lambda x, y: keep(x != 0, y != 0).cast("int")))


def union(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x | y)


def difference(a: Column, b: Column) -> Column:
    return _both(a, b, lambda x, y: x & ~y)


def iou(a: Column, b: Column) -> Column:
    inter, whole = area(_both(a, b, lambda x, y: x & y)), area(union(a, b))
    return F.when(whole > 0, F.try_divide(inter.cast("double"), whole)).otherwise(F.lit(0.0))


def dilate(data: Column, width: Column, radius: int) -> Column:
    """Set where any cell of the square around is set."""
    return _square(data, width, radius, any_set=True)


def erode(data: Column, width: Column, radius: int) -> Column:
    """Set where all cells of the square around are set; outside the mask there is background."""
    return _square(data, width, radius, any_set=False)


def _square(data: Column, width: Column, radius: int, any_set: bool) -> Column:
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)])

    def cell(i: Column, o: Column) -> Column:
        x, y = i % width + o["dx"], F.floor(i / width) + o["dy"]
        inside = (x >= 0) & (x < width) & (y >= 0) & (y * width + x < F.size(data))
        return F.when(inside, F.element_at(data, F.when(inside, (y * width + x + 1).cast("int")).otherwise(1)) != 0).otherwise(False)

    test = (lambda i: F.exists(offsets, lambda o: cell(i, o))) if any_set else (lambda i: F.forall(offsets, lambda o: cell(i, o)))
    return F.transform(data, lambda _, i: test(i).cast("int"))


def rasterise(points: list[tuple[float, float]], width: int, height: int) -> Column:
    """A constant polygon as a mask: a pixel is set if its centre is in it."""
    from trackmesh.functions.geometry import in_polygon

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: in_polygon(points, i % width + 0.5, F.floor(i / width) + 0.5).cast("int"))


def centroid(data: Column, width: Column) -> Column:
    """struct<x, y> of the set cells' mean centre; null for an empty mask."""
    places = F.filter(F.transform(data, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    mean = lambda part: F.aggregate(places, F.lit(0.0), lambda total, i: total + part(i)) / F.size(places)
    return F.when(F.size(places) > 0, F.struct((mean(lambda i: i % width) + 0.5).alias("x"), (mean(lambda i: F.floor(i / width)) + 0.5).alias("y")))


def box_polygon(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The corners of a box, clockwise from the first, as array<struct<x, y>>."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    return F.array(at(left, top), at(right, top), at(right, bottom), at(left, bottom))
