"""Geometry on arrays of doubles: boxes [x0, y0, x1, y1], polygons of [x, y], 3x3 matrices by rows.

Coordinates are continuous pixel edges. Invalid geometry is an error for the caller to report, never clipped in silence.
What is a fixed formula is an expression; order-dependent loops (crops to a fixpoint, clipping, rasters) are Arrow UDFs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StructField, StructType

#: How far beyond the edges a coordinate may lie and still be put onto them (fixed value).
SNAP = 1e-7


def finite(x: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def once(value: Column, of) -> Column:
    """``of(value)`` with the value computed once a row, however often ``of`` uses it: a lambda binds it, where a plain expression would be repeated."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def box_polygon(box: Column) -> Column:
    """Corners of a box, clockwise from the upper left."""
    return F.array(F.array(box[0], box[1]), F.array(box[2], box[1]), F.array(box[2], box[3]), F.array(box[0], box[3]))


def bounds(polygon: Column) -> Column:
    """The box around a polygon."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def region_error(polygon: Column, width: Column, height: Column) -> Column:
    """Why a polygon isn't valid within an image, or null: points, finite, within bounds, positive extents."""
    points_ok = F.forall(polygon, lambda p: (F.size(p) == 2) & finite(p[0]) & finite(p[1]))
    inside = F.forall(polygon, lambda p: (p[0] >= -SNAP) & (p[1] >= -SNAP) & (p[0] <= width + SNAP) & (p[1] <= height + SNAP))
    b = bounds(polygon)
    return F.when(polygon.isNull() | (F.size(polygon) < 3), "too_few_points").when(~points_ok, "not_finite").when(~inside, "out_of_bounds").when((b[2] <= b[0]) | (b[3] <= b[1]), "empty_extent")


def snapped(polygon: Column, width: Column, height: Column) -> Column:
    """Coordinates within ``SNAP`` of an edge put onto it."""
    return F.transform(polygon, lambda p: F.array(F.least(F.greatest(p[0], F.lit(0.0)), width.cast("double")), F.least(F.greatest(p[1], F.lit(0.0)), height.cast("double"))))


def transformed(polygon: Column, m: Column) -> Column:
    """Points through an affine map or homography (G1)."""
    row = lambda n, k, p: n[k][0] * p[0] + n[k][1] * p[1] + n[k][2]
    return once(m, lambda n: F.transform(polygon, lambda p: F.array(row(n, 0, p) / row(n, 2, p), row(n, 1, p) / row(n, 2, p))))


def moved_regions(items: Column, m: Column) -> Column:
    """Regions (structs with polygon and bbox among others) through a map, their boxes drawn anew (G1); with the ``inverse`` of the map, back again."""
    return F.transform(items, lambda r: once(transformed(r["polygon"], m), lambda p: r.withField("polygon", p).withField("bbox", bounds(p))))


def scale_matrix(sx: Column, sy: Column) -> Column:
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.array(sx, zero, zero), F.array(zero, sy, zero), F.array(zero, zero, one))


def inverse(m: Column) -> Column:
    """Inverse of a 3x3 matrix by its adjugate; null if singular."""

    def of(n: Column) -> Column:
        e = lambda a, b: n[a % 3][b % 3]
        cofactor = lambda r, c: e(r + 1, c + 1) * e(r + 2, c + 2) - e(r + 1, c + 2) * e(r + 2, c + 1)
        det = sum((e(0, c) * cofactor(0, c) for c in range(1, 3)), e(0, 0) * cofactor(0, 0))
        return once(det, lambda d: F.when(d != 0, F.array(*[F.array(*[cofactor(c, r) / d for c in range(3)]) for r in range(3)])))

    return once(m, of)


def composed(a: Column, b: Column) -> Column:
    """The map that does b, then a."""
    cell = lambda x, y, r, c: x[r][0] * y[0][c] + x[r][1] * y[1][c] + x[r][2] * y[2][c]
    return once(a, lambda x: once(b, lambda y: F.array(*[F.array(*[cell(x, y, r, c) for c in range(3)]) for r in range(3)])))


def long_edge_size(width: Column, height: Column, edge: int) -> Column:
    """struct(width, height, scale) with the longer side ``edge``; halves round to even, sides are 1 at least."""
    scale = F.lit(float(edge)) / F.greatest(width, height)
    side = lambda x: F.greatest(F.lit(1), F.rint(x * scale).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"), scale.alias("scale"))


def intersects(a: Column, b: Column) -> Column:
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def contains(outer: Column, inner: Column) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def area(box: Column) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0.0)) * F.greatest(box[3] - box[1], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    return F.coalesce(F.try_divide(inter, area(a) + area(b) - inter), F.lit(0.0))


def complete_regions(boxes: Column, crop: Column) -> Column:
    """Boxes that a crop holds whole, relative to it."""
    return F.transform(F.filter(boxes, lambda b: contains(crop, b)), lambda b: F.array(b[0] - crop[0], b[1] - crop[1], b[2] - crop[0], b[3] - crop[1]))


def signed_area(polygon: Column) -> Column:
    """Shoelace area: positive for clockwise polygons in image coordinates."""
    following = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.aggregate(F.zip_with(polygon, following, lambda p, q: p[0] * q[1] - q[0] * p[1]), F.lit(0.0), lambda s, x: s + x) / 2


def line_size(polygon: Column) -> Column:
    """struct(width, height) of a text line: the longer of each pair of opposite sides; a line 1.5 times as high as wide is vertical, and its sides swap.

    A polygon of other than four corners counts as the least rectangle around it.
    """
    quad = F.when(F.size(polygon) == 4, polygon).otherwise(least_rectangle(F.when(F.size(polygon) != 4, polygon)))

    def sides(q: Column) -> Column:
        side = lambda a, b: F.sqrt(F.pow(q[a][0] - q[b][0], 2) + F.pow(q[a][1] - q[b][1], 2))
        return F.array(F.greatest(side(0, 1), side(3, 2)), F.greatest(side(0, 3), side(1, 2)))

    turned = lambda s: s[1] >= 1.5 * s[0]
    size = lambda s: F.struct(F.when(turned(s), s[1]).otherwise(s[0]).alias("width"), F.when(turned(s), s[0]).otherwise(s[1]).alias("height"))
    return once(quad, lambda q: once(sides(q), size))


def rectangle_around(points: np.ndarray) -> np.ndarray:
    """The corners of the least rectangle that holds all points, from the upper left one on; one of its sides has a side of their hull."""
    order = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(some: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = np.array([*chain(order), *chain(order[::-1])]).reshape(-1, 2)
    if len(hull) < 3:
        hull = np.array([order[0], order[-1]])
    best = None
    for p, q in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        length = np.hypot(*(q - p))
        if not length:
            continue
        along = (q - p) / length
        axes = np.array([along, [-along[1], along[0]]])
        seen = hull @ axes.T
        low, high = seen.min(0), seen.max(0)
        size = float(np.prod(high - low))
        if best is None or size < best[0]:
            corners = np.array([[low[0], low[1]], [high[0], low[1]], [high[0], high[1]], [low[0], high[1]]]) @ axes
            best = size, corners
    corners = best[1] if best is not None else np.repeat(hull[:1], 4, axis=0)
    middle = corners.mean(0)
    corners = corners[np.argsort(np.arctan2(corners[:, 1] - middle[1], corners[:, 0] - middle[0]), kind="stable")]  # clockwise in image coordinates
    return np.roll(corners, -int(corners.sum(1).argmin()), axis=0)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def least_rectangle(polygons: pd.Series) -> pd.Series:
    """``rectangle_around`` of each polygon of three points or more; null otherwise."""
    return pd.Series([rectangle_around(np.array(_lists(p))).tolist() if p is not None and len(p) > 2 else None for p in polygons])


def quad_of(values: Column) -> Column:
    """A quad from 4 numbers (a box whose far corner lies beyond the near one) or 8 (corners); null otherwise."""
    upright = (F.size(values) == 4) & (values[2] > values[0]) & (values[3] > values[1])
    return F.when(upright, box_polygon(values)).when(F.size(values) == 8, F.array(*[F.array(values[2 * k], values[2 * k + 1]) for k in range(4)]))


#: What a corner's cross product and a quad's area have to exceed (fixed values).
LEAST_TURN, LEAST_AREA = 1e-8, 1e-6


def convex_clockwise(quad: Column) -> Column:
    """The quad with corners clockwise, or null where it is crossed, not convex, flat or not finite."""
    turn = lambda q, k: (q[(k + 1) % 4][0] - q[k][0]) * (q[(k + 2) % 4][1] - q[(k + 1) % 4][1]) - (q[(k + 1) % 4][1] - q[k][1]) * (q[(k + 2) % 4][0] - q[(k + 1) % 4][0])

    def of(q: Column) -> Column:
        turned = F.array(q[0], q[3], q[2], q[1])
        bad = (F.size(q) != 4) | ~F.forall(q, lambda p: finite(p[0]) & finite(p[1])) | (F.abs(signed_area(q)) < LEAST_AREA)
        way = lambda t: F.when(F.forall(t, lambda x: x > LEAST_TURN), q).when(F.forall(t, lambda x: x < -LEAST_TURN), turned)
        return F.when(bad, None).otherwise(once(F.array(*[turn(q, k) for k in range(4)]), way))

    return once(quad, of)


def rescaled(polygon: Column, sx: Column, sy: Column) -> Column:
    return F.transform(polygon, lambda p: F.array(p[0] * sx, p[1] * sy))


def far_outside(polygon: Column, width: Column, height: Column) -> Column:
    """Whether a point lies beyond the edges by more than max(2, 2 % of the longer side)."""
    slack = F.greatest(F.lit(2.0), 0.02 * F.greatest(width, height))
    return F.exists(polygon, lambda p: (p[0] < -slack) | (p[1] < -slack) | (p[0] > width + slack) | (p[1] > height + slack))


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Starts of tiles that cover a length; the last ends with it."""
    last = F.greatest(length - tile, F.lit(0)).cast("long")
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0).cast("long"), last, F.lit(tile - overlap).cast("long")), lambda s: s < last), F.array(last))))


def pixel_box(polygon: Column, width: Column, height: Column) -> Column:
    """The box of whole pixels around a polygon, clipped to an image."""
    b = bounds(polygon)
    return F.array(F.greatest(F.floor(b[0]), F.lit(0)), F.greatest(F.floor(b[1]), F.lit(0)), F.least(F.ceil(b[2]), width), F.least(F.ceil(b[3]), height))


def _lists(values) -> list[list[float]]:
    return [[float(v) for v in x] for x in values] if values is not None else []


def grown_crops(boxes: list[list[float]], width: float, height: float, least_w: float, least_h: float, context: float, most: int) -> list[list[float]]:
    """Crops of whole pixels around boxes: centred, with context, moved into the image, grown until they cut no box that they touch; equal ones once, the first ``most``."""
    found: dict[tuple, None] = {}
    b = np.array(boxes, float).reshape(-1, 4)
    near, far = np.floor(b[:, :2]), np.ceil(b[:, 2:])
    extent = np.array([width, height])
    size = np.minimum(extent, np.maximum([least_w, least_h], np.ceil((b[:, 2:] - b[:, :2]) * (1 + 2 * context))))
    corner = np.minimum(np.maximum(0, np.floor((b[:, :2] + b[:, 2:] - size) / 2)), extent - size)
    for crop in np.hstack([corner, corner + size]):
        while True:
            touched = (b[:, 0] < crop[2]) & (crop[0] < b[:, 2]) & (b[:, 1] < crop[3]) & (crop[1] < b[:, 3])
            wide = np.concatenate([np.minimum(crop[:2], near[touched].min(0, initial=np.inf)), np.maximum(crop[2:], far[touched].max(0, initial=-np.inf))])
            if (wide == crop).all():
                break
            crop = wide  # noqa: PLW2901
        found[tuple(crop.tolist())] = None
        if len(found) == most:
            break
    return [list(c) for c in found]


def text_crops(boxes: Column, width: Column, height: Column, least_w: float, least_h: float, context: float, most: int) -> Column:
    """``grown_crops`` of each image; null boxes give none."""

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def run(b: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([grown_crops(_lists(x), ww, hh, least_w, least_h, context, most) for x, ww, hh in zip(b, w, h, strict=True)])

    return run(boxes, width.cast("double"), height.cast("double"))


def clip(polygon: np.ndarray, box: np.ndarray) -> np.ndarray:
    """A convex polygon within a box, edge by edge; empty where they don't meet."""
    sides: list[tuple[int, float, Callable]] = [(0, box[0], np.greater_equal), (0, box[2], np.less_equal), (1, box[1], np.greater_equal), (1, box[3], np.less_equal)]
    for axis, edge, inside in sides:
        if not len(polygon):
            break
        nxt = np.roll(polygon, -1, axis=0)
        here, there = inside(polygon[:, axis], edge), inside(nxt[:, axis], edge)
        out = []
        for p, q, a, c in zip(polygon, nxt, here, there, strict=True):
            if a:
                out.append(p)
            if a != c:
                out.append(p + (q - p) * (edge - p[axis]) / (q[axis] - p[axis]))
        polygon = np.array(out).reshape(-1, 2)
    return polygon


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def clipped(polygons: pd.Series, boxes: pd.Series) -> pd.Series:
    """The part of each polygon within its box."""
    return pd.Series([clip(np.array(_lists(p)).reshape(-1, 2), np.array(b, float)).tolist() if p is not None and b is not None else None for p, b in zip(polygons, boxes, strict=True)])


def visible_fraction(polygon: Column, box: Column) -> Column:
    """The share of a polygon's area within a box; 0 for flat polygons."""
    whole = F.abs(signed_area(polygon))
    return F.when(whole > 0, F.abs(signed_area(clipped(polygon, box))) / whole).otherwise(0.0)


def raster(polygon: np.ndarray, width: int, height: int) -> np.ndarray:
    """Pixels whose centres lie in a polygon, by even and odd crossings."""
    ys, xs = np.arange(height)[:, None] + 0.5, np.arange(width)[None, :] + 0.5
    inside = np.zeros((height, width), bool)
    for (x0, y0), (x1, y1) in zip(polygon, np.roll(polygon, -1, axis=0), strict=True):
        if y0 != y1:
            inside ^= ((y0 > ys) != (y1 > ys)) & (xs < (x1 - x0) * (ys - y0) / (y1 - y0) + x0)
    return inside


def polygon_mask(polygon: Column, width: int, height: int) -> Column:
    """The raster of each polygon, row by row."""

    @F.pandas_udf(ArrayType(BooleanType()))
    def run(polygons: pd.Series) -> pd.Series:
        return polygons.map(lambda p: None if p is None else raster(np.array(_lists(p)), width, height).ravel().tolist())

    return run(polygon)


@F.pandas_udf(ArrayType(ArrayType(DoubleType())))
def homography(quads: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
    """The matrix that maps an upright rectangle of the given size onto each quad, for rectification."""

    def solve(quad, w, h):
        if quad is None or len(quad) != 4:
            return None
        rows, right = [], []
        for (x, y), (u, v) in zip([(0, 0), (w, 0), (w, h), (0, h)], _lists(quad), strict=True):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            right += [u, v]
        try:
            return np.append(np.linalg.solve(np.array(rows, float), right), 1.0).reshape(3, 3).tolist()
        except np.linalg.LinAlgError:
            return None

    return pd.Series([solve(q, w, h) for q, w, h in zip(quads, widths, heights, strict=True)])


def trust_map(lines: Column, width: int, height: int, weight: float) -> Column:
    """By pixel 1, but ``weight`` within lines that the teacher misread though they are valid and aligned, the least where lines overlap.

    ``lines``: array of struct(polygon, valid, aligned, teacher_correct). An unknown reading is no misreading.
    """
    yes = lambda x: F.coalesce(x, F.lit(False))
    misread = F.transform(F.filter(lines, lambda x: yes(x["valid"]) & yes(x["aligned"]) & yes(~x["teacher_correct"])), lambda x: x["polygon"])

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for polygons in rows:
            inside = np.zeros((height, width), bool)
            for p in polygons if polygons is not None else []:
                inside |= raster(np.array(_lists(p)), width, height)
            out.append(np.where(inside, min(weight, 1.0), 1.0).ravel().tolist())
        return pd.Series(out)

    return run(misread)


@F.pandas_udf(StructType([StructField("variance", DoubleType()), StructField("deviation", DoubleType())]))
def sharpness(rows: pd.Series, widths: pd.Series) -> pd.DataFrame:
    """Of grey values row by row: the variance of the four-neighbour Laplacian, edges mirrored, and the standard deviation of the values (G22); null without values."""
    out = []
    for values, width in zip(rows, widths, strict=True):
        if values is None or not len(values) or not width:
            out.append((None, None))
            continue
        image = np.asarray(values, float).reshape(-1, int(width))
        wide = np.pad(image, 1, mode="reflect" if min(image.shape) > 1 else "edge")
        laplacian = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * image
        out.append((float(laplacian.var()), float(image.std())))
    return pd.DataFrame(out, columns=["variance", "deviation"])
