"""Geometry on ring arrays: a ring is an array of structs x, y; a polygon an array of rings, the outer one first.

All but the clip and the cover by cells are array expressions that run in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kilometres per degree in the box formula, square kilometres per square degree at 13 degrees north.
KM_PER_DEGREE = 111.32
KM2_PER_DEGREE2 = 110.6**2 * math.cos(math.radians(13.0))
METRES_PER_DEGREE = 110600.0
LEAST_AREA, MOST_AREA_KM2 = 8e-9, 10.0
SLIVER_EDGE, SLIVER_COMPACTNESS = 5.0, 0.15


class Box(NamedTuple):
    """A rectangle of corner coordinates, in columns or numbers."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column


def closed(ring: Column) -> Column:
    """The ring with its first vertex again at its end, unless it is there."""
    same = (F.element_at(ring, 1).x == F.element_at(ring, -1).x) & (F.element_at(ring, 1).y == F.element_at(ring, -1).y)
    return F.when(F.size(ring) == 0, ring).when(same, ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def cleaned(ring: Column) -> Column:
    """The closed ring without vertices that repeat the one before; what is left of a ring with under 4 is empty."""
    ring = closed(ring)
    kept = F.filter(ring, lambda p, i: (i == 0) | (p.x != F.get(ring, i - 1).x) | (p.y != F.get(ring, i - 1).y))
    return F.when(F.size(kept) >= 4, kept).otherwise(F.slice(kept, 1, 0))


def edges(ring: Column) -> Column:
    """Pairs of neighbouring vertices a, b."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b))


def _sum(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))


def ring_area(ring: Column) -> Column:
    return F.abs(_sum(edges(ring), lambda e: e.a.x * e.b.y - e.b.x * e.a.y)) / 2


def polygon_area(rings: Column) -> Column:
    """The outer ring's area less that of the holes, in square degrees."""
    return F.aggregate(F.slice(rings, 2, 1_000_000), ring_area(F.element_at(rings, 1)), lambda s, r: s - ring_area(r))


def ring_length(ring: Column) -> Column:
    return _sum(edges(ring), lambda e: F.sqrt((e.b.x - e.a.x) * (e.b.x - e.a.x) + (e.b.y - e.a.y) * (e.b.y - e.a.y)))


def compactness(ring: Column) -> Column:
    """4 pi area / perimeter^2: 1 for a circle, towards 0 for a thread."""
    length = ring_length(ring)
    return F.try_divide(4 * math.pi * ring_area(ring), length * length)


def in_metres(ring: Column, latitude: float = 13.0) -> Column:
    east = METRES_PER_DEGREE * math.cos(math.radians(latitude))
    return F.transform(ring, lambda p: F.struct((p.x * east).alias("x"), (p.y * METRES_PER_DEGREE).alias("y")))


def is_sliver(ring: Column, edge_factor: float = SLIVER_EDGE, most: float = SLIVER_COMPACTNESS) -> Column:
    """True where the closing edge is far longer than the others' mean and the shape is a thread."""
    ring = in_metres(ring)
    length = lambda e: F.sqrt((e.b.x - e.a.x) * (e.b.x - e.a.x) + (e.b.y - e.a.y) * (e.b.y - e.a.y))
    lengths = F.transform(edges(ring), length)
    n = F.size(lengths)
    others = F.aggregate(F.slice(lengths, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    mean = F.try_divide(others, n - 1)
    return F.coalesce((F.element_at(lengths, -1) > edge_factor * mean) & (compactness(ring) < most), F.lit(False))


def vertex_mean(points: Column) -> Column:
    """Mean of all vertices, the closing one included; null without any."""
    n = F.size(points)
    return F.when(n > 0, F.struct((_sum(points, lambda p: p.x) / n).alias("x"), (_sum(points, lambda p: p.y) / n).alias("y")))


def bbox(polygons: Column) -> Box:
    """Corners of the rectangle about all outer rings."""
    points = F.flatten(F.transform(polygons, lambda rings: F.element_at(rings, 1)))
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def bbox_km2(box: tuple[float, float, float, float]) -> float:
    x0, y0, x1, y1 = box
    return abs(x1 - x0) * KM_PER_DEGREE * math.cos(math.radians((y0 + y1) / 2)) * abs(y1 - y0) * KM_PER_DEGREE


def crossings(items: Column, x: Column, y: Column) -> Column:
    """How many of the edges lie to the right of the point; -1 if the point is on one."""

    def step(state: Column, e: Column) -> Column:
        cross = (e.b.x - e.a.x) * (y - e.a.y) - (e.b.y - e.a.y) * (x - e.a.x)
        on = (cross == 0) & x.between(F.least(e.a.x, e.b.x), F.greatest(e.a.x, e.b.x)) & y.between(F.least(e.a.y, e.b.y), F.greatest(e.a.y, e.b.y))
        spans = (e.a.y > y) != (e.b.y > y)
        # the point is left of an edge that goes up where cross > 0, of one that goes down where cross < 0
        right = spans & F.when(e.b.y > e.a.y, cross > 0).otherwise(cross < 0)
        return F.when((state < 0) | on, -1).otherwise(state + right.cast("int"))

    return F.aggregate(items, F.lit(0), step)


def inside_near(parts: Column, x: Column, y: Column) -> Column:
    """contains() for a point of a cell, from the edges and odd numbers that cover_cells gives for it."""

    def inside(p: Column) -> Column:
        n = crossings(p.edges, x, y)
        return (n >= 0) & ((n + p.odd) % 2 == 1)

    return F.exists(parts, inside)


def numbered_edges(ring: Column) -> Column:
    """Edges a, b of the closed ring with their number i."""
    return F.transform(edges(closed(ring)), lambda e, i: F.named_struct(F.lit("a"), e.a, F.lit("b"), e.b, F.lit("i"), i))


def edges_cross(e: Column, f: Column, n: Column) -> Column:
    """True where two of a ring's n numbered edges, e before f, cross, or touch other than neighbours do at their vertex."""
    side = lambda p, q, r: F.signum((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x))
    within = lambda p, q, r: r.x.between(F.least(p.x, q.x), F.greatest(p.x, q.x)) & r.y.between(F.least(p.y, q.y), F.greatest(p.y, q.y))
    s = [side(e.a, e.b, f.a), side(e.a, e.b, f.b), side(f.a, f.b, e.a), side(f.a, f.b, e.b)]
    touch = ((s[0] == 0) & within(e.a, e.b, f.a)) | ((s[1] == 0) & within(e.a, e.b, f.b)) | ((s[2] == 0) & within(f.a, f.b, e.a)) | ((s[3] == 0) & within(f.a, f.b, e.b))
    meet = ((s[0] * s[1] < 0) & (s[2] * s[3] < 0)) | touch

    def back(e: Column, f: Column) -> Column:  # neighbours: the later one turns back onto the earlier
        return (side(e.a, e.b, f.b) == 0) & ((e.b.x - e.a.x) * (f.b.x - f.a.x) + (e.b.y - e.a.y) * (f.b.y - f.a.y) < 0)

    return F.when(f.i == e.i + 1, back(e, f)).when((e.i == 0) & (f.i == n - 1), back(f, e)).otherwise(meet)


def crosses_itself(ring: Column) -> Column:
    """True where two edges of the closed ring cross or touch (see edges_cross): each edge is held against all later ones."""
    crosses = lambda own: F.exists(own, lambda e: F.exists(F.slice(own, e.i + 2, F.size(own)), lambda f: edges_cross(e, f, F.size(own))))
    return F.exists(F.array(numbered_edges(ring)), crosses)  # the edges as a variable, made once


def contains(polygons: Column, x: Column, y: Column) -> Column:
    """True strictly inside one of the polygons: an odd number of crossings over its rings, and on no edge."""

    def inside(rings: Column) -> Column:
        counts = F.transform(rings, lambda r: crossings(edges(r), x, y))
        total = F.aggregate(counts, F.lit(0), lambda s, n: F.when((s < 0) | (n < 0), -1).otherwise(s + n))
        return (total > 0) & (total % 2 == 1)

    return F.exists(polygons, inside)


class Edges(NamedTuple):
    """Edges of a zone's polygons in arrays, with the number of each one's polygon."""

    ax: np.ndarray
    ay: np.ndarray
    bx: np.ndarray
    by: np.ndarray
    part: np.ndarray

    @classmethod
    def of(cls, polygons: list) -> "Edges":
        rings = [(k, np.array([(p["x"], p["y"]) for p in ring], float)) for k, rings in enumerate(polygons) for ring in rings if len(ring) > 1]
        if not rings:
            return cls(*np.zeros((4, 0)), np.zeros(0, np.int64))
        a, b = np.concatenate([r[:-1] for _, r in rings]), np.concatenate([r[1:] for _, r in rings])
        return cls(a[:, 0], a[:, 1], b[:, 0], b[:, 1], np.concatenate([np.full(len(r) - 1, k) for k, r in rings]))

    def near(self, own: np.ndarray, box: Box) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some edges: how many may meet a rectangle, those that tell its points apart, and those that count for all alike.

        Edges that meet it tell its points apart. Of those to its right one that passes all its heights counts for
        every point in it; one that ends within them tells. No other edge counts.
        """
        x0, y0, x1, y1 = box
        ax, ay, bx, by = (v[own] for v in self[:4])
        low, high, west, east = np.minimum(ay, by), np.maximum(ay, by), np.minimum(ax, bx), np.maximum(ax, bx)
        side = lambda x, y: (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        corners = np.stack([side(x0, y0), side(x1, y0), side(x0, y1), side(x1, y1)])
        level = (high >= y0) & (low <= y1)
        meets = level & (east >= x0) & (west <= x1) & (corners.min(axis=0) <= 0) & (corners.max(axis=0) >= 0)
        # of an edge that does not meet the rectangle all corners lie on one side
        right = (west > x1) | ((east >= x0) & ((corners[0] > 0) == (by > ay)))
        beyond, passes = level & ~meets & right, (low <= y0) & (high >= y1)
        return int(meets.sum()), own[meets | (beyond & ~passes)], own[beyond & passes]

    def odd_right_of(self, own: np.ndarray, x: float, y: float, odd: np.ndarray) -> bool:
        """Whether an odd number of some polygon's edges, with those that were counted before, lies to the point's right."""
        ax, ay, bx, by = (v[own] for v in self[:4])
        cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        hit = ((ay > y) != (by > y)) & np.where(by > ay, cross > 0, cross < 0)
        return bool(((odd + np.bincount(self.part[own][hit], minlength=len(odd))) % 2).any())


class Cell(NamedTuple):
    level: int
    ix: int
    iy: int
    met: int
    edges: np.ndarray
    odd: np.ndarray


def cover_cells(e: Edges, polygons: int, cell: float, levels: int, few_edges: int) -> Iterator[Cell]:
    """The cells that a zone touches, cut in quarters where edges meet them (see zone_cover)."""
    if not len(e.ax):
        return
    ix0, ix1, iy0, iy1 = (math.floor(v / cell) for v in (min(e.ax.min(), e.bx.min()), max(e.ax.max(), e.bx.max()), min(e.ay.min(), e.by.min()), max(e.ay.max(), e.by.max())))
    top = max(ix1 - ix0, iy1 - iy0, 1).bit_length() - 1
    every, none = np.arange(len(e.ax)), np.zeros(polygons, np.int64)
    todo = [(top, i, j, every, none) for i in range(ix0 >> top, (ix1 >> top) + 1) for j in range(iy0 >> top, (iy1 >> top) + 1)]
    while todo:
        level, ix, iy, own, odd = todo.pop()
        side = cell * 2.0**level
        # a hair wider than the cell, so that a pixel that rounding puts into the cell is never past its edge
        hair, x, y = side * 1e-6, ix * side, iy * side
        met, own, alike = e.near(own, Box(x - hair, y - hair, x + side + hair, y + side + hair))
        odd = (odd + np.bincount(e.part[alike], minlength=polygons)) % 2
        if met and level and (met > few_edges or top - level < levels):
            todo += [(level - 1, 2 * ix + i, 2 * iy + j, own, odd) for i in (0, 1) for j in (0, 1)]
        elif met or e.odd_right_of(own, x + side / 2, y + side / 2, odd):
            yield Cell(level, ix, iy, met, own, odd)


def _clip_ring(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """The parts of a closed ring inside a rectangle: cut at one side after the other.

    A cut of a bent ring can leave parts joined by bridges along the side; at each side the points on it are paired
    in order along it, which gives the parts apart.
    """
    parts = [ring[:-1]]
    for axis, limit, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        parts = [p for part in parts for p in _cut(part, axis, limit, sign)]
    return [[*p, p[0]] for p in parts if len(p) >= 3]


def _cut(points: list[tuple[float, float]], axis: int, limit: float, sign: int) -> list[list[tuple[float, float]]]:
    inside = [sign * (p[axis] - limit) >= 0 for p in points]
    if all(inside):
        return [points]
    if not any(inside):
        return []
    chains: list[list[tuple[float, float]]] = []
    start = inside.index(False)
    now: list[tuple[float, float]] | None = None
    for k in range(len(points)):
        a, b = points[(start + k) % len(points)], points[(start + k + 1) % len(points)]
        ia, ib = inside[(start + k) % len(points)], inside[(start + k + 1) % len(points)]
        if ia != ib:
            t = (limit - a[axis]) / (b[axis] - a[axis])
            other = a[1 - axis] + t * (b[1 - axis] - a[1 - axis])
            point = (limit, other) if axis == 0 else (other, limit)
            if ib:
                now = [point, b]
            else:
                now.append(point)
                chains.append(now)
                now = None
        elif ib:
            now.append(b)
    # along the side, entries and exits alternate: neighbours in pairs bound the same part
    order = sorted((c[end][1 - axis], i, end) for i, c in enumerate(chains) for end in (0, -1))
    partner = {}
    for (_, i, e), (_, j, f) in zip(order[::2], order[1::2]):
        partner[i, e], partner[j, f] = (j, f), (i, e)
    done, out = set(), []
    for i in range(len(chains)):
        if i in done:
            continue
        part, at = [], i
        while at not in done:
            done.add(at)
            part += chains[at]
            at = partner[at, -1][0]
        if len({*part}) >= 3:
            out.append(part)
    return out


def _area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def _inside(ring: list[tuple[float, float]], x: float, y: float) -> bool:
    odd = False
    for a, b in zip(ring, ring[1:]):
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
            odd = not odd
    return odd


def clip_polygon(rings: list, box: tuple[float, float, float, float]) -> list:
    """Parts of a polygon in a rectangle. Holes are clipped like outer rings and go to the part they lie in."""
    as_points = [[(p["x"], p["y"]) for p in r] for r in rings]
    outer = [p for p in _clip_ring(as_points[0], box) if _area(p) > 0] if as_points and len(as_points[0]) >= 4 else []
    parts = [[p] for p in outer]
    for hole in as_points[1:]:
        for piece in _clip_ring(hole, box) if len(hole) >= 4 else []:
            if _area(piece) > 0:
                x, y = sum(p[0] for p in piece[:-1]) / (len(piece) - 1), sum(p[1] for p in piece[:-1]) / (len(piece) - 1)
                home = next((part for part in parts if _inside(part[0], x, y)), None)
                if home is not None:
                    home.append(piece)
    return [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in parts]


def _clipped(batches: Iterator[pa.RecordBatch], box: tuple[float, float, float, float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("polygons")
        cut = [None if p is None else [part for rings in p for part in clip_polygon(rings, box)] for p in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(cut, batch.schema.field(at).type))


def clipped(df: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """df with `polygons` cut to the rectangle: the parts of all polygons inside it. Runs in Python on Arrow batches."""
    return df.mapInArrow(partial(_clipped, box=box), df.schema)
