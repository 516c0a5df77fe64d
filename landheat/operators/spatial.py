"""Pixels joined to the zone polygons that hold them: an equi-join on grid cells, then an exact test."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landheat.functions import geometry as g
from landheat.sources.shared import spread, written

#: Side of the smallest grid cells in degrees, and bytes of a zone cover that are sent to all executors.
CELL, MOST_BYTES = 0.0005, 64 << 20
#: A cell that edges meet is cut in four until it is this many levels below its zone's largest, and beyond that as long
#: as more edges meet it; the second keeps tests short, the first leaves most of a zone's area to cells without edges.
LEVELS, FEW_EDGES = 4, 8
#: What a cell and an edge take in memory, about.
CELL_BYTES, EDGE_BYTES = 96, 80


def _index(x: Column, cell: float) -> Column:
    return F.floor(x / cell)


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_EDGES = pa.list_(pa.struct([("a", _POINT), ("b", _POINT)]))
_PARTS = pa.list_(pa.struct([("edges", _EDGES), ("odd", pa.int32())]))
#: Cells that are handed on at once.
_CELLS_AT_ONCE = 2000


def _parts(e: g.Edges, cells: list[g.Cell], polygons: int) -> pa.Array:
    """Per cell and polygon the edges that tell its points apart; null for cells without."""
    own = [c.edges[np.argsort(e.part[c.edges], kind="stable")] for c in cells if c.met]
    flat = np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64)
    sizes = np.array([np.bincount(e.part[o], minlength=polygons) for o in own], np.int64).ravel()
    point = lambda x, y: pa.StructArray.from_arrays([pa.array(x[flat]), pa.array(y[flat])], fields=list(_POINT))
    edges = pa.StructArray.from_arrays([point(e.ax, e.ay), point(e.bx, e.by)], fields=list(_EDGES.value_type))
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), edges)
    odd = pa.array(np.concatenate([*(c.odd for c in cells if c.met), np.zeros(0, np.int64)]), pa.int32())
    held = np.array([c.met > 0 for c in cells])
    ends = np.append(0, np.cumsum(held * polygons))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([lists, odd], fields=list(_PARTS.value_type)), mask=pa.array(~held))


def _covered(batches: Iterator[pa.RecordBatch], cell: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            zone_id, category, polygons = (batch.column(i).slice(k, 1) for i in range(3))
            polygons = polygons[0].as_py()
            e = g.Edges.of(polygons)
            found = g.cover_cells(e, len(polygons), cell, LEVELS, FEW_EDGES)
            while cells := list(islice(found, _CELLS_AT_ONCE)):
                numbers = [pa.array([getattr(c, n) for c in cells], t) for n, t in (("level", pa.int32()), ("ix", pa.int64()), ("iy", pa.int64()))]
                same = [v.take(pa.array([0] * len(cells))) for v in (zone_id, category)]
                yield pa.RecordBatch.from_arrays([*same, *numbers, _parts(e, cells, len(polygons)), pa.array([not c.met for c in cells])], names=["zone_id", "zoning_category", "level", "ix", "iy", "parts", "full"])


def zone_cover(zones: DataFrame, cell: float = CELL) -> DataFrame:
    """(zone_id, zoning_category, level, ix, iy, parts, full): cells of mixed size that a zone touches.

    A cell of a level is as wide as two of the level below; those of level 0 are `cell` wide. A zone starts at the
    level where two or three cells span it and is cut in quarters only where its edges are, so it has cells in
    proportion to its edges, not to its area. A cell that no edge meets lies inside as a whole or outside; those
    outside are left out, and those inside are `full`, so their pixels need no further test. Other cells carry, polygon
    by polygon, just the edges that tell their points apart, and whether an odd number of others lies to their right.
    """
    kinds = dict(zones.dtypes)
    schema = f"zone_id {kinds['zone_id']}, zoning_category {kinds['zoning_category']}, level int, ix long, iy long, parts array<struct<edges: array<struct<a: struct<x: double, y: double>, b: struct<x: double, y: double>>>, odd: int>>, full boolean"
    return zones.filter(F.size("polygons") > 0).select("zone_id", "zoning_category", "polygons").mapInArrow(partial(_covered, cell=cell), schema)


def join_zones(pixels: DataFrame, zones: DataFrame, how: str = "left", multi: str = "all", cell: float = CELL, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds zone_id and zoning_category of each zone that holds the pixel strictly inside; edges and vertices are out.

    Where zones overlap multi="all" repeats the pixel, multi="first" keeps the lowest zone_id. A pixel is looked up
    once at each level of cells that the cover has, each time by an equi-join with one row a cell; what it finds is
    tested then, so with how="left" a pixel without a zone stays once, and neither way needs a row number or a
    shuffle of the pixels. The cover is broadcast if it takes most_bytes at most; else the joins shuffle by cell.
    """
    cover = written(zone_cover(zones, cell), "zone-cover")
    edges = F.coalesce(F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p.edges)), F.lit(0))
    sizes = cover.groupBy("level").agg(F.sum(CELL_BYTES + EDGE_BYTES * edges).alias("size")).collect()
    few = sum(r["size"] for r in sizes) <= most_bytes
    names, out = pixels.columns, pixels.withColumns({"__ix": _index(F.col("lon"), cell), "__iy": _index(F.col("lat"), cell)})
    levels = sorted(r.level for r in sizes)
    for level in levels:
        own = cover.filter(F.col("level") == level).groupBy(F.col("ix").alias("__zx"), F.col("iy").alias("__zy")).agg(F.collect_list(F.struct("zone_id", "zoning_category", "full", "parts")).alias(f"__at{level}"))
        on = (F.shiftright("__ix", level) == F.col("__zx")) & (F.shiftright("__iy", level) == F.col("__zy"))
        out = out.join(F.broadcast(own) if few else own, on, "left").drop("__zx", "__zy")
    lon, lat = F.col("lon"), F.col("lat")
    kind = "array<struct<zone_id: {}, zoning_category: {}>>".format(*(dict(zones.dtypes)[c] for c in ("zone_id", "zoning_category")))
    held = lambda cells: F.transform(F.filter(cells, lambda z: z.full | g.inside_near(z.parts, lon, lat)), lambda z: F.named_struct(F.lit("zone_id"), z.zone_id, F.lit("zoning_category"), z.zoning_category))
    found = [F.coalesce(held(F.col(f"__at{level}")), F.array().cast(kind)) for level in levels]
    found = F.concat(*found) if found else F.array().cast(kind)
    if multi == "first":
        out = out.withColumn("__zone", F.array_min(found))
        out = out if how == "left" else out.filter(F.col("__zone").isNotNull())
    else:
        out = out.withColumn("__zone", (F.explode_outer if how == "left" else F.explode)(found))
    return out.select(*names, F.col("__zone.zone_id").alias("zone_id"), F.col("__zone.zoning_category").alias("zoning_category"))


def check_points(points: DataFrame, zones: DataFrame, cell: float = CELL) -> DataFrame:
    """(name, lon, lat, expected, found, status) of control points: the first zone that holds each, and how it fits."""
    found = join_zones(points, zones, "left", "first", cell)
    expected, got = F.col("expected"), F.col("zoning_category")
    status = F.when(expected.isNull(), "info").when(got.isNull(), "coverage_gap").when(got == expected, "match").otherwise("mismatch")
    return found.select("name", "lon", "lat", "expected", got.alias("found"), status.alias("status"))


def area_stats(zones: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """(zoning_category, n, area_km2, percent_of_bbox), largest first."""
    area = F.aggregate("polygons", F.lit(0.0), lambda s, p: s + g.polygon_area(p)) * g.KM2_PER_DEGREE2
    sums = zones.select("zoning_category", area.alias("area")).groupBy("zoning_category").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area_km2"))
    return sums.withColumn("percent_of_bbox", F.col("area_km2") * 100 / g.bbox_km2(box)).orderBy(F.desc("area_km2"), "zoning_category")


def dedup_zones(zones: DataFrame) -> DataFrame:
    """Of zones with the same shape and category the one with the lowest id stays."""
    return zones.groupBy("polygons", "zoning_category").agg(F.min("zone_id").alias("zone_id")).select("zone_id", "zoning_category", "polygons")


def repaired(zones: DataFrame) -> DataFrame:
    """Rings closed, repeated vertices and spent rings gone; polygons without an outer ring go."""
    polygons = F.transform("polygons", lambda rings: F.filter(F.transform(rings, g.cleaned), lambda r, i: (i == 0) | (F.size(r) > 0)))
    return zones.withColumn("polygons", F.filter(polygons, lambda rings: (F.size(rings) > 0) & (F.size(F.get(rings, F.lit(0))) > 0)))


def split_polygons(zones: DataFrame) -> DataFrame:
    """One row per polygon; zone_id and part tell them apart."""
    rows = zones.select("zone_id", "zoning_category", F.posexplode("polygons").alias("part", "rings"))
    return rows.select("zone_id", "zoning_category", "part", F.array("rings").alias("polygons"))


def drop_reason(polygons: Column, most_km2: float = g.MOST_AREA_KM2) -> Column:
    """Why a single polygon is dropped: empty, degenerate, oversized or sliver; null if it stays."""
    rings = F.element_at(polygons, 1)
    area = g.polygon_area(rings)
    empty = (F.size(polygons) == 0) | (F.size(F.get(F.get(polygons, F.lit(0)), F.lit(0))) < 4)
    return (
        F.when(F.coalesce(empty, F.lit(True)), "empty")
        .when(area < g.LEAST_AREA, "degenerate")
        .when(area * g.KM2_PER_DEGREE2 > most_km2, "oversized")
        .when(g.is_sliver(F.element_at(rings, 1)), "sliver")
    )


def clipped_zones(zones: DataFrame, box: tuple[float, float, float, float], most_km2: float = g.MOST_AREA_KM2) -> DataFrame:
    """Zones cut to the box, one polygon a row, with `reason` for those to drop."""
    cut = g.clipped(repaired(spread(zones)), box).filter("polygons is not null")
    rows = cut.select("zone_id", "zoning_category", F.posexplode_outer("polygons").alias("part", "rings"), F.slice("polygons", 1, 0).alias("none"))
    polygons = F.when(F.col("rings").isNull(), F.col("none")).otherwise(F.array("rings"))
    rows = rows.select("zone_id", "zoning_category", F.coalesce("part", F.lit(0)).alias("part"), polygons.alias("polygons"))
    return rows.withColumn("reason", drop_reason(F.col("polygons"), most_km2))


def kept_zones(judged: DataFrame) -> DataFrame:
    """The polygons without a reason to drop, each under a number made from its zone and part by a hash."""
    rows = judged.filter("reason is null")
    number = F.shiftrightunsigned(F.xxhash64("zone_id", "part"), 1)
    return dedup_zones(rows.select(number.alias("zone_id"), "zoning_category", "polygons"))


def crossing_rings(rings: DataFrame) -> DataFrame:
    """The keys of rings (key, points) that cross or touch themselves.

    A ring's edges are dealt to a grid over its box, with about as many cells as edges; only edges of one cell are held
    against each other, in a join on ring and cell. So the work grows with the edges, not with their square, and a
    ring of any size is dealt over many tasks.
    """
    e = rings.select("key", F.explode(g.numbered_edges(F.col("points"))).alias("e"))
    low, high = (lambda v: F.least(f"e.a.{v}", f"e.b.{v}")), (lambda v: F.greatest(f"e.a.{v}", f"e.b.{v}"))
    boxes = e.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(low("x")).alias("x0"), F.min(low("y")).alias("y0"), F.greatest(F.max(high("x")) - F.min(low("x")), F.max(high("y")) - F.min(low("y"))).alias("span"))
    boxes = boxes.withColumn("side", F.greatest(F.col("span") / F.sqrt("n"), F.lit(1e-12)))
    e = e.join(boxes, "key")
    hair = F.col("side") * 1e-6
    column = lambda x: F.floor((x - F.col("x0")) / F.col("side"))
    e = e.withColumn("ix", F.explode(F.sequence(column(low("x") - hair), column(high("x") + hair))))
    # the heights of the edge within a column of cells
    slope = F.try_divide(F.col("e.b.y") - F.col("e.a.y"), F.col("e.b.x") - F.col("e.a.x"))
    left = F.greatest(low("x"), F.col("x0") + F.col("ix") * F.col("side") - hair)
    right = F.least(high("x"), F.col("x0") + (F.col("ix") + 1) * F.col("side") + hair)
    at = [F.coalesce(F.col("e.a.y") + (x - F.col("e.a.x")) * slope, y) for x, y in ((left, low("y")), (right, high("y")))]
    row = lambda y: F.floor((y - F.col("y0")) / F.col("side"))
    span = F.sequence(row(F.greatest(F.least(*at), low("y")) - hair), row(F.least(F.greatest(*at), high("y")) + hair))
    cells = written(e.select("key", "n", "e", "ix", F.explode(span).alias("iy")), "ring-edges")
    a, b = cells.alias("a"), cells.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "ix", "iy")]
    pairs = a.join(b, on[0] & on[1] & on[2] & (F.col("a.e.i") < F.col("b.e.i")) & g.edges_cross(F.col("a.e"), F.col("b.e"), F.col("a.n")))
    return pairs.select("a.key").distinct()


#: Edges up to which a ring is tested within its row.
FEW_RING_EDGES = 64


def crossing_counts(zones: DataFrame) -> DataFrame:
    """(zoning_category, polygons, crossing): polygons, and those of them with a ring that crosses itself.

    Such polygons are counted, not rebuilt; a point is inside them where an odd number of edges lies to its right.
    Rings of few edges are tested within their row, longer ones by crossing_rings.
    """
    few = lambda r: F.size(r) <= FEW_RING_EDGES
    rings = F.element_at("polygons", 1)
    tested = split_polygons(spread(zones)).select("zoning_category", F.exists(rings, lambda r: few(r) & g.crosses_itself(r)).alias("crosses"), F.filter(rings, lambda r: ~few(r)).alias("long"))
    rows = written(tested, "tested-rings")  # read three times
    long = rows.filter(~F.col("crosses") & (F.size("long") > 0)).select(F.explode("long").alias("points"))
    named = F.sha2(F.to_json("points"), 256)  # rings of the same shape cross alike
    found = crossing_rings(long.select(named.alias("key"), "points").dropDuplicates(["key"]))
    keys = F.transform("long", lambda r: F.sha2(F.to_json(r), 256))
    own = rows.withColumn("keys", keys).drop("long")
    plain = own.filter(F.size("keys") == 0).select("zoning_category", F.col("crosses").cast("int").alias("crosses"))
    joined = written(own.filter(F.size("keys") > 0).withColumn("id", F.monotonically_increasing_id()), "long-rings")
    tested = joined.select("id", "zoning_category", "crosses", F.explode("keys").alias("key")).join(found.withColumn("hit", F.lit(True)), "key", "left")
    tested = tested.groupBy("id", "zoning_category").agg(F.max(F.greatest(F.col("crosses").cast("int"), F.coalesce(F.col("hit"), F.lit(False)).cast("int"))).alias("crosses"))
    every = plain.unionByName(tested.select("zoning_category", "crosses"))
    return every.groupBy("zoning_category").agg(F.count(F.lit(1)).alias("polygons"), F.sum("crosses").cast("long").alias("crossing"))


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
