"""Readers and writers on small hand-made files."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, LessThanOrEqual

from landheat.config import Config
from landheat.operators import matrix, spatial
from landheat.sources import osm, pixels, raster, scenes, vector, zones


def tiff(values, order="<", deflate=False, origin=(410000.0, 1440000.0), step=30.0, citation=b"WGS 84 / UTM zone 44N|\0"):
    """One strip, one grey sample a pixel, little or big end first."""
    values = np.asarray(values)
    data = values.astype(values.dtype.newbyteorder(order)).tobytes()
    data = zlib.compress(data) if deflate else data
    h, w = values.shape
    scale, tie = struct.pack(order + "3d", step, step, 0), struct.pack(order + "6d", 0, 0, 0, *origin, 0)
    at = {}
    body = b""
    for name, part in (("data", data), ("scale", scale), ("tie", tie), ("citation", citation)):
        at[name] = 8 + len(body)
        body += part + b"\0" * (len(part) % 2)
    short = lambda v: struct.pack(order + "HH", v, 0)
    long = lambda v: struct.pack(order + "I", v)
    fields = [
        (256, 3, 1, short(w)), (257, 3, 1, short(h)), (258, 3, 1, short(values.itemsize * 8)), (259, 3, 1, short(8 if deflate else 1)), (273, 4, 1, long(at["data"])),
        (277, 3, 1, short(1)), (278, 3, 1, short(h)), (279, 4, 1, long(len(data))), (33550, 12, 3, long(at["scale"])), (33922, 12, 6, long(at["tie"])), (34737, 2, len(citation), long(at["citation"])),
    ]
    ifd = struct.pack(order + "H", len(fields)) + b"".join(struct.pack(order + "HHI", *f[:3]) + f[3] for f in fields) + bytes(4)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body)) + body + ifd


@pytest.fixture(scope="module")
def scene_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("scenes")
    for scene, qa in (("S1", [[0, 32], [8, 32]]), ("S2", [[8, 8], [8, 8]])):
        (root / scene).mkdir()
        (root / scene / "B4.tif").write_bytes(tiff(np.array([[10000, 0, 12000, 1], [9000, 8000, 7000, 6000], [1, 2, 3, 4]], np.uint16)))
        (root / scene / "ST_B10.tif").write_bytes(tiff(np.full((2, 2), 200, np.uint8), ">", True))
        (root / scene / "B5.tif").write_bytes(b"broken")
        (root / scene / "QA_PIXEL.tif").write_bytes(tiff(np.array(qa, np.uint16)))
        (root / scene / "scene_metadata.json").write_text(json.dumps({"scene_id": scene, "acquisition_datetime": "2024-03-01T10:30:00Z", "k1_constant_band_10": 700.5, "band_files": {"B4": "B4.tif"}}, indent=1))
    return str(root)


def test_raster(spark, scene_dir):
    rows = raster.scene_pixels(spark, scene_dir).filter("tile_id = 'S1'").collect()
    red = {(r.lat, r.lon): r.value for r in rows if r.band == "B4_Red"}
    # one of twelve is nodata; of the lower left quarter's two rows of two pixels the nearest cell is cloudy
    assert len(red) == 12 - 1 - 2
    assert max(red.values()) == pytest.approx(12000 * 0.0000275 - 0.1)
    assert all(str(r.timestamp) == "2024-03-01 10:30:00" and r.lulc_class == "" for r in rows)
    assert {round(r.value, 4) for r in rows if r.band == "ST_B10"} == {149.6836}
    assert all(13.0 < r.lat < 13.03 and 80.1 < r.lon < 80.2 for r in rows)
    gated = raster.scene_pixels(spark, scene_dir, box=(80.0, 12.9, 80.4, 13.2), most_cloud=50.0)
    assert {r.tile_id for r in gated.select("tile_id").distinct().collect()} == {"S1"}
    assert raster.scene_pixels(spark, scene_dir, scenes=["S2"]).count() == 0
    rejected = raster.rejected_files(spark, scene_dir).collect()
    assert sorted((r.scene, r.band) for r in rejected) == [("S1", "B5"), ("S2", "B5")] and all(r.reason for r in rejected)


def test_reprocess_replaces_named_scenes(spark, scene_dir, tmp_path):
    out = str(tmp_path / "px")
    pixels.write_pixels(raster.scene_pixels(spark, scene_dir).withColumn("value", F.lit(-1.0)), out)
    raster.reprocess(spark, scene_dir, out, ["S1"])
    got = pixels.read_pixels(spark, out)
    assert got.filter("tile_id = 'S1' and value = -1").count() == 0 and got.count() > 0
    assert pixels.file_inventory(spark, out).count() >= 1


def test_raster_source_reads_what_is_asked(spark, tmp_path):
    """Conditions reach the source: other scenes and bands are not listed, other strips not read, a file goes to many tasks."""
    rng = np.random.default_rng(1)
    big = rng.integers(1, 60000, (400, 300)).astype(np.uint16)
    for scene in ("S1", "S2"):
        for band in ("B4", "B5", "OTHER"):
            (tmp_path / scene).mkdir(exist_ok=True)
            (tmp_path / scene / f"{band}.tif").write_bytes(raster.encoded(big, (80.0, 13.0), strip_rows=16))
    rows = raster.read_rasters(spark, str(tmp_path), ("B4",), ["S2"], part_bytes=20_000)
    assert rows.rdd.getNumPartitions() == -(-len(raster.encoded(big, strip_rows=16)) // 20_000)
    got = {(r.row, r.col): r.dn for r in rows.select("row", "col", "dn").collect()}
    assert got == {(i, j): big[i, j] for i in range(400) for j in range(300)}

    reader = raster.RasterReader(str(tmp_path), 20_000)
    asked = [EqualTo(("band",), "B4"), In(("scene",), ("S2", "S3")), GreaterThan(("row",), 40), LessThanOrEqual(("row",), 47), IsNull(("error",)), IsNotNull(("dn",))]
    assert list(reader.pushFilters(asked)) == [asked[2], asked[3], asked[5]]
    parts = [p for p in reader.partitions()]
    assert {(s.scene, s.band) for p in parts for s in p.files} == {("S2", "B4")}
    found = [b for p in parts for b in reader.read(p)]
    assert sorted({r for b in found for r in b.column(9).to_pylist()}) == list(range(32, 48))  # the one strip of 16 rows
    plan = rows.filter("row between 41 and 47")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "scene IN" not in plan.split("BatchScan")[0]


def test_damaged_strips_are_told(spark, tmp_path):
    values = np.arange(64, dtype=np.uint16).reshape(8, 8) + 1
    whole = raster.encoded(values, strip_rows=2, deflate=True)
    (tmp_path / "S").mkdir()
    broken = bytearray(whole)
    broken[8:12] = b"\xff\xff\xff\xff"  # the head of the first strip
    (tmp_path / "S" / "B4.tif").write_bytes(bytes(broken))
    (tmp_path / "S" / "B5.tif").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "S" / "B6.tif").write_bytes(b"")
    (tmp_path / "S" / "B10.tif").write_bytes(raster.encoded(values, order=">"))
    (tmp_path / "S" / "B11.tif").write_bytes(raster.encoded(values.astype(np.float32), strip_rows=3))
    rows = raster.read_grid(spark, str(tmp_path), raster.PIXEL_BANDS).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("dn").alias("total"))
    assert {r.band: (r.n, r.total) for r in rows.collect()} == {"B4": (48, float(values[2:].sum())), "B10": (64, float(values.sum())), "B11": (64, float(values.sum()))}
    told = {r.band: r.reason for r in raster.rejected_files(spark, str(tmp_path)).collect()}
    assert set(told) == {"B4", "B5", "B6"} and told["B6"] == "ValueError: the file is empty" and "ends before" in told["B5"]
    assert raster.read_grid(spark, str(tmp_path), ("B4",), ["none"]).count() == 0
    assert raster.read_grid(spark, str(tmp_path / "absent"), ("B4",)).count() == 0
    scenes_wanted = spark.createDataFrame([("S",), ("T",), ("S",)], "scene string")
    assert raster.read_grid(spark, str(tmp_path), ("B10",), scenes_wanted).count() == 64


def test_window_bounds():
    w = raster.Window().cut("row", 5, None).cut("row", None, 9).cut("row", 7, 20)
    assert (w.first_row, w.last_row) == (7, 9)
    assert w.meets(0, 0, 8, 5) and not w.meets(0, 0, 7, 5) and w.meets(9, 0, 5, 5) and not w.meets(10, 0, 5, 5)
    assert raster.Window().cut("col", 3, 3).meets(0, 3, 1, 1) and not raster.Window().cut("col", 3, 3).meets(0, 4, 1, 1)


def test_scene_metadata(spark, scene_dir, tmp_path):
    meta = scenes.read_scene_metadata(spark, scene_dir)
    assert {r.scene_id: r.k1_constant_band_10 for r in meta.collect()} == {"S1": 700.5, "S2": 700.5}
    none = scenes.read_scene_metadata(spark, str(tmp_path))
    assert none.count() == 0 and none.columns == meta.columns
    scenes.write_scene_metadata(meta, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).select("band_files.B4").first()[0] == "B4.tif"


def test_scene_metadata_in_few_files(spark, tmp_path):
    """Files are as many as tasks, not scenes; beside them sidecars and folders of earlier writes are read."""
    rows = spark.range(300, numPartitions=3).select(F.concat(F.lit("S"), "id").alias("scene_id"), F.create_map(F.lit("B4"), F.lit("x")).alias("band_files"), F.lit(1.5).alias("k1_constant_band_10"))
    scenes.write_scene_metadata(rows, str(tmp_path))
    assert len(list(tmp_path.rglob("*.json"))) <= 3
    for name, file in (("T", "scene_metadata.json"), ("scene=U", "part-0.json")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text(json.dumps({"scene_id": name}, indent=1 if name == "T" else None))
    meta = scenes.read_scene_metadata(spark, str(tmp_path)).collect()
    assert sorted(r.scene_id for r in meta) == sorted([*(f"S{k}" for k in range(300)), "T", "scene=U"])
    assert {r.band_files["B4"] for r in meta if r.band_files} == {"B4.tif"}


GEOJSON = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"zoning_category": "water", "class": "", "name": "w"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"zoning_category": "green"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[4, 0], [8, 0], [8, 4], [4, 4], [4, 0]]], [[[9, 9], [10, 9], [10, 10], [9, 9]]]]}},
        {"type": "Feature", "properties": {"zoning_category": "x"}, "geometry": {"type": "Point", "coordinates": [3, 3]}},
        {"type": "Feature", "properties": {"lulc": "l"}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}},
    ],
}


def test_zones_and_join(spark, tmp_path):
    (tmp_path / "z.geojson").write_text(json.dumps(GEOJSON, indent=1))
    z = zones.read_zones(spark, str(tmp_path / "z.geojson"))
    assert sorted(r.zoning_category for r in z.collect()) == ["green", "water"]
    points = [("in", 0.5, 0.5, "water"), ("hole", 1.5, 1.5, None), ("edge", 4.0, 2.0, None), ("vertex", 0.0, 0.0, None), ("part", 9.9, 9.6, "green"), ("out", 50.0, 50.0, None), ("right", 6.0, 2.0, "green"), ("hole edge", 1.0, 1.5, None)]
    df = spark.createDataFrame(points, "name string, lon double, lat double, want string")
    for cell in (0.3, 1.0, 7.0):
        got = {r.name: r.zoning_category for r in spatial.join_zones(df, z, cell=cell).collect()}
        assert got == {n: w for n, _, _, w in points}
    over = z.unionByName(z.withColumn("zone_id", F.col("zone_id") + 5).withColumn("zoning_category", F.lit("second")))
    assert spatial.join_zones(df, over, cell=1.0).count() == 8 + 3
    first = spatial.join_zones(df, over, multi="first", cell=1.0)
    assert {r.name: r.zoning_category for r in first.collect()} == {n: w for n, _, _, w in points}
    zones.write_zones(z, str(tmp_path / "lines"))
    assert spark.read.text(str(tmp_path / "lines")).count() == 2


def test_vectors(spark, tmp_path):
    (tmp_path / "v.geojson").write_text(json.dumps(GEOJSON))
    got = {r.tile_id: (r.lon, r.lat, r.lulc_class) for r in vector.geojson_records(zones.read_features(spark, str(tmp_path / "v.geojson")), "v").collect()}
    assert got == {"v_0": (1.6, 1.6, "w"), "v_1": (pytest.approx((28 + 38) / 9), pytest.approx((8 + 37) / 9), "unknown"), "v_2": (3.0, 3.0, "unknown")}

    def record(number, body):
        return struct.pack(">ii", number, len(body) // 2) + body

    point = struct.pack("<i2d", 1, 80.5, 13.5)
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    second = [(9.0, 9.0), (9.5, 9.0), (9.0, 9.0)]
    poly = struct.pack("<i4d2i2i", 5, 0, 0, 9, 9, 2, 7, 0, 4) + b"".join(struct.pack("<2d", *p) for p in ring + second)
    shp = bytes(100) + record(1, point) + record(2, struct.pack("<i", 0)) + record(3, poly)
    field = lambda name, kind, size: name.ljust(11, b"\0") + kind + bytes(4) + bytes([size]) + bytes(15)
    head = struct.pack("<4BiHH", 3, 0, 0, 0, 3, 32 + 2 * 32 + 1, 1 + 4 + 8) + bytes(20) + field(b"D", b"D", 4) + field(b"KIND", b"C", 8) + b"\r"
    dbf = head + b"".join(b" 2024" + t.ljust(8) for t in (b"farm", b"lost", b""))
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.shp").write_bytes(shp)
    (tmp_path / "s" / "a.dbf").write_bytes(dbf)
    got = {r.tile_id: (r.lon, r.lat, r.lulc_class) for r in vector.read_shapefiles(spark, str(tmp_path / "s"), "s").collect()}
    assert got == {"s_1": (80.5, 13.5, "farm"), "s_3": (2.0, 1.0, "unknown")}


def test_elements(spark, tmp_path):
    node = lambda i, x, y: {"type": "node", "id": i, "lon": x, "lat": y}
    way = lambda i, nodes, **tags: {"type": "way", "id": i, "nodes": nodes, "tags": tags}
    elements = [node(1, 0.0, 0.0), node(2, 1.0, 0.0), node(3, 1.0, 1.0), node(4, 0.0, 1.0), node(5, 0.4, 0.4), node(6, 0.6, 0.4), node(7, 0.6, 0.6), node(8, 0.4, 0.6)]
    elements += [
        way(10, [1, 2, 3, 4, 1], waterway="river"), way(11, [1, 2, 3, 4], natural="water", landuse="residential"), way(12, [1, 2, 3, 4], natural="wood", landuse="forest"),
        way(13, [1, 2, 3, 4], leisure="park"), way(14, [1, 2, 3, 4], landuse="retail"), way(15, [1, 2, 3, 4], landuse="military"), way(16, [1, 2, 3, 4], landuse="railway"),
        way(17, [1, 2, 3, 4], landuse="unknown"), way(18, [1, 2, 3, 99], landuse="retail"), way(19, [1, 2, 3, 4], waterway="canal"), way(20, [5, 6, 7, 8, 5]), way(21, [1, 2], landuse="grass"),
        {"type": "relation", "id": 30, "tags": {"landuse": "forest"}, "members": [{"type": "way", "ref": 11, "role": "outer"}, {"type": "way", "ref": 20, "role": "inner"}, {"type": "way", "ref": 77, "role": "outer"}]},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    found = osm.element_zones(osm.read_elements(spark, str(tmp_path / "o.json")))
    got = {r.id: (r.status, r.category or r.reason) for r in found.collect()}
    assert got == {
        10: ("kept", "water"), 11: ("kept", "water"), 12: ("kept", "green"), 13: ("kept", "green"), 14: ("kept", "commercial"), 15: ("kept", "industrial"), 16: ("excluded", "railway"),
        17: ("excluded", "unknown"), 18: ("missing_nodes", "commercial"), 19: ("open_waterway", "water"), 21: ("missing_nodes", "green"), 30: ("kept", "green"),
    }
    relation = found.filter("id = 30").first()
    assert [len(rings) for rings in relation.polygons] == [2] and len(relation.polygons[0][0]) == 5


def test_ways_are_closed_by_their_nodes(spark):
    """Two nodes at one place are not the same node: such a way is open."""
    node = lambda i, x, y: ("node", i, x, y, None, None, None)
    way = lambda i, nodes, tags: ("way", i, None, None, tags, nodes, None)
    rows = [node(1, 0.0, 0.0), node(2, 1.0, 0.0), node(3, 1.0, 1.0), node(4, 0.0, 0.0), way(10, [1, 2, 3, 4], {"waterway": "river"}), way(11, [1, 2, 3, 1], {"waterway": "river"})]
    kind = "type string, id long, lon double, lat double, tags map<string,string>, nodes array<long>, members array<struct<type: string, ref: long, role: string>>"
    found = osm.element_zones(spark.createDataFrame(rows, kind))
    assert {r.id: r.status for r in found.collect()} == {10: "open_waterway", 11: "kept"}


def test_rings_are_closed_by_their_nodes(spark):
    """Three nodes, the last at the first one's place, and the first again make a ring of four points."""
    rows = [("node", i, x, 0.0, None, None, None) for i, x in ((1, 0.0), (2, 1.0), (3, 0.0))]
    rows += [("way", 10, None, None, {}, [1, 2, 3], None), ("way", 11, None, None, {}, [1, 2, 1], None)]
    rows += [("relation", i, None, None, {"landuse": "forest"}, None, [("way", i - 10, "outer")]) for i in (20, 21)]
    kind = "type string, id long, lon double, lat double, tags map<string,string>, nodes array<long>, members array<struct<type: string, ref: long, role: string>>"
    found = osm.element_zones(spark.createDataFrame(rows, kind))
    assert {r.id: r.status for r in found.collect()} == {20: "kept", 21: "missing_nodes"}


def test_catalog_pages(spark, tmp_path):
    def feature(i, path, row, day, cloud, **extra):
        p = {"datetime": f"2020-03-{day:02d}T10:00:00Z", "platform": "landsat-8", "eo:cloud_cover": cloud, "landsat:wrs_path": path, "landsat:wrs_row": row}
        return {"id": i, "collection": "c", "bbox": [80.0, 12.9, 80.1, 13.0], "properties": p, "assets": {k: {"href": f"/{i}/{k}"} for k in ("red", "nir08", "swir16", "lwir11", "qa_pixel", "B10", "B11")}} | extra

    for k in range(2):
        page = {"features": [feature(f"a{k}", 142, "51", k + 1, 5.0), feature(f"b{k}", "142", 51, k + 1, 50.0)]}
        (tmp_path / f"{k}.json").write_text(json.dumps(page, indent=1))
    rows = scenes.read_catalog(spark, str(tmp_path))
    assert rows.count() == 4 and {(r.wrs_path, r.wrs_row) for r in rows.collect()} == {(142, 51)}
    cfg = Config(years=(2020, 2020))
    assert {r.scene_id for r in scenes.catalog_filter(rows, cfg, "c").collect()} == {"a0", "a1"}
    assert {r.scene_id for r in scenes.catalog_filter(rows, cfg, scene_ids=["b1"]).collect()} == {"b1"}
    keyed = rows.withColumn("assets", scenes.keyed_assets(F.col("assets")))
    assert scenes.with_required_assets(keyed).count() == 4
    link = scenes.resolve_url(F.col("assets")["B4"], "https://h/x/")
    assert keyed.filter("scene_id = 'a0'").select(link).first()[0] == "https://h/x/a0/red"
    assert scenes.with_constants(rows).first().k1_constant_band_11 == 480.8883


def test_matrix_files(spark, tmp_path):
    rows = [("t", 13.0 + i, 80.0, 2024 + i % 2, i, 1.0, 2.0, 0.1, 0.2, 300.0, "train") for i in range(25)]
    df = spark.createDataFrame(rows, "tile_id string, lat double, lon double, year int, doy int, lulc_class_encoded double, zoning_category_encoded double, ndvi double, ndbi double, lst double, split string")
    assert matrix.write_matrix(df, str(tmp_path / "m")) == {"rows": 25, "columns": 11}
    back = matrix.read_matrix(spark, str(tmp_path / "m"))
    assert back.count() == 25 and set(back.columns) == set(df.columns)
    plan = back.filter("year = 2024 and split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    with pytest.raises(FileNotFoundError):
        matrix.read_matrix(spark, str(tmp_path / "none"))


def test_tiny_rasters_are_many_tasks_and_few_batches(tmp_path):
    for k in range(600):
        (tmp_path / f"S{k}").mkdir()
        (tmp_path / f"S{k}" / "B4.tif").write_bytes(raster.encoded(np.full((8, 8), k, np.uint16), strip_rows=1))
    reader = raster.RasterReader(str(tmp_path), raster.PART_BYTES)
    parts = reader.partitions()
    assert len(parts) > 2 and sum(len(p.files) for p in parts) == 600
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) < 10
    dn = np.concatenate([b.column("dn").to_numpy() for b in batches])
    assert len(dn) == 600 * 64 and all(np.bincount(dn.astype(int), minlength=600) == 64)
