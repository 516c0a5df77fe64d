"""The quadtree cover of zones: equal to testing every zone, and in proportion to a zone's edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from landheat.functions import geometry as g
from landheat.operators import spatial

ZONE = "zone_id long, zoning_category string, polygons array<array<array<struct<x: double, y: double>>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def blob(rng, n, x, y, size):
    """A ring of n vertices about a place, with radii that vary."""
    at = np.sort(rng.random(n)) * 2 * math.pi
    far = size * (0.4 + 0.6 * rng.random(n))
    return ring([(x + r * math.cos(a), y + r * math.sin(a)) for a, r in zip(at, far)])


def zones(seed):
    rng = np.random.default_rng(seed)
    out = [(k, f"c{k % 4}", [[blob(rng, int(rng.integers(3, 60)), *rng.random(2) * 0.3, 0.002 * 4 ** rng.integers(0, 4))]]) for k in range(25)]
    whole = ring([(-180, -90), (180, -90), (180, 90), (-180, 90)])
    out.append((90, "world", [[whole, ring([(0.1, 0.1), (0.2, 0.1), (0.2, 0.2), (0.1, 0.2)])]]))
    out.append((91, "parts", [[ring([(0, 0), (0.05, 0), (0.05, 0.05), (0, 0.05)])], [blob(rng, 40, 0.2, 0.2, 0.05)], [ring([(0.05, 0), (0.1, 0), (0.1, 0.05), (0.05, 0.05)])]]))
    out.append((92, "point", [[ring([(0.1, 0.1)])]]))
    out.append((93, None, [[ring([(0.01, 0.01), (0.3, 0.02), (0.3, 0.0200001)])]]))
    return out


@pytest.mark.parametrize("seed,cell,limit", [(1, spatial.CELL, 1 << 30), (2, 0.02, 1 << 30), (3, 0.003, 0)])
def test_join_equals_every_zone_tested(spark, seed, cell, limit):
    rng = np.random.default_rng(seed)
    z = spark.createDataFrame(zones(seed), ZONE)
    corners = [(x, y) for x in (0.0, 0.05, 0.1, 0.15, 0.2) for y in (0.0, 0.05, 0.1, 0.2)]
    places = [*(rng.random((600, 2)) * 0.34 - 0.02).tolist(), *corners, (0.1, 0.15), (0.05, 0.025), (-180.0, 0.0), (170.0, -89.9), (None, 1.0), (1.0, None)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(places)], "k long, lon double, lat double")
    got = spatial.join_zones(df, z, cell=cell, most_bytes=limit)
    want = df.join(z, g.contains(F.col("polygons"), F.col("lon"), F.col("lat")), "left").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    inner = spatial.join_zones(df, z, how="inner", cell=cell)
    assert inner.count() == want.filter("zone_id is not null").count()
    first = spatial.join_zones(df, z, multi="first", cell=cell).select("k", "zone_id")
    lowest = want.groupBy("k").agg(F.min("zone_id").alias("zone_id"))
    assert sorted(map(str, first.collect())) == sorted(map(str, lowest.collect()))


def test_cells_grow_with_edges_not_with_area(spark):
    box = lambda x, y, w: (1, "a", [[ring([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])]])
    counts = [spatial.zone_cover(spark.createDataFrame([box(-80.0, -80.0, w)], ZONE)).count() for w in (0.01, 1.0, 160.0)]
    assert max(counts) < 400 and max(counts) < 4 * min(counts)
    at = np.arange(20_000) / 20_000 * 2 * math.pi
    coast = ring([(80 + r * math.cos(a), 13 + r * math.sin(a)) for a, r in zip(at, 5 + np.sin(7 * at) + 0.001 * np.sin(3000 * at))])
    many = spatial.zone_cover(spark.createDataFrame([(1, "a", [[coast]])], ZONE))
    n, most, edges = many.select(F.coalesce(F.aggregate("parts", F.lit(0), lambda s, p: s + F.size(p.edges)), F.lit(0)).alias("e")).agg(F.count(F.lit(1)), F.max("e"), F.sum("e")).first()
    assert n < 2 * 20_000 and edges < 20 * 20_000
    assert spatial.zone_cover(spark.createDataFrame([], ZONE)).count() == 0
    assert spatial.join_zones(spark.createDataFrame([(1.0, 1.0)], "lon double, lat double"), spark.createDataFrame([], ZONE)).collect()[0].zone_id is None


def plain_crossing(points):
    """Every pair of edges of a closed ring, in exact whole numbers."""
    n = len(points) - 1
    edges = [(points[i], points[i + 1]) for i in range(n)]
    side = lambda p, q, r: (lambda v: (v > 0) - (v < 0))((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    within = lambda p, q, r: min(p[0], q[0]) <= r[0] <= max(p[0], q[0]) and min(p[1], q[1]) <= r[1] <= max(p[1], q[1])

    def hit(e, f):
        (a, b), (c, d) = e, f
        s = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
        return s[0] * s[1] < 0 and s[2] * s[3] < 0 or any(x == 0 and within(*y) for x, y in zip(s, ((a, b, c), (a, b, d), (c, d, a), (c, d, b))))

    return any(hit(edges[i], edges[j]) for i in range(n) for j in range(i + 2, n) if not (i == 0 and j == n - 1))


@pytest.mark.parametrize("few", [0, 64])
def test_crossing_rings_match_every_pair(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW_RING_EDGES", few)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for k in range(60):
        n = int(rng.integers(4, 90))
        at = np.arange(n) / n * 2 * math.pi
        points = [(int(1000 * r * math.cos(a)), int(1000 * r * math.sin(a))) for a, r in zip(at, 800 + 100 * rng.random(n))]
        if k % 3 == 0:
            i, j = sorted(rng.choice(n, 2, replace=False))
            points[i], points[j] = points[j], points[i]
        points.append(points[0])
        rows.append((k, f"c{k % 5}", [[[{"x": float(x), "y": float(y)} for x, y in points]]]))
        own = want.setdefault(f"c{k % 5}", [0, 0])
        own[0] += 1
        own[1] += plain_crossing(points)
    rows.append((7, "c0", rows[3][2]))  # another zone's shape, and a repeated id
    want["c0"][0] += 1
    want["c0"][1] += plain_crossing([(p["x"], p["y"]) for p in rows[3][2][0][0]])
    got = spatial.crossing_counts(spark.createDataFrame(rows, ZONE)).collect()
    assert {r.zoning_category: [r.polygons, r.crossing] for r in got} == want


def test_a_ring_of_100_000_edges(spark):
    at = np.arange(100_000) / 100_000 * 2 * math.pi
    points = [(80 + r * math.cos(a), 13 + r * math.sin(a)) for a, r in zip(at, 5 + np.sin(7 * at))]
    tied = [*points[:50_000], points[50_001], points[50_000], *points[50_002:]]
    rows = [(1, "smooth", [[ring(points)]]), (2, "tied", [[ring(tied)]])]
    got = spatial.crossing_counts(spark.createDataFrame(rows, ZONE)).collect()
    assert {r.zoning_category: (r.polygons, r.crossing) for r in got} == {"smooth": (1, 0), "tied": (1, 1)}
