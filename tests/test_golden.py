"""Golden rows of the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from landheat.config import Config, YearOverlapError, parse_bbox
from landheat.functions import geometry, indices, reproject, thermal
from landheat.operators import filters, quality, report, sample, split
from landheat.operators.pivot import pivot_bands, with_indices
from landheat.operators.thermal import with_scene_constants, with_temperature

CFG = Config(eps_soil10=0.971, eps_veg10=0.987, eps_soil11=0.977, eps_veg11=0.989)
ROWS = [
    (0.12, 0.16, 10.0, 8.5, 0.142857, 0.0, 0.971, 0.977, 302.794702, 296.352703, 308.877900),
    (0.08, 0.25, 9.0, 7.65, 0.515152, 1.0, 0.987, 0.989, 295.739338, 288.964964, 302.128112),
    (0.03, 0.02, 8.0, 6.8, -0.200000, 0.0, 0.971, 0.977, 288.222107, 281.117106, 294.968309),
    (0.10, 0.20, 9.5, 8.0, 0.333333, 0.197531, 0.974160, 0.979370, 299.319453, 292.057867, 306.216945),
]


def pixels(spark, rows=ROWS, extra=()):
    df = spark.createDataFrame([("S", *r[:4]) for r in rows], "tile_id string, B4_Red double, B5_NIR double, B10_TIR double, B11_TIR double")
    return df.withColumn("ndvi", indices.ndvi())


def meta(spark):
    return spark.createDataFrame([("S", 774.8853, 1321.0789, 480.8883, 1201.1442)] * 2, "scene_id string, k1_constant_band_10 double, k2_constant_band_10 double, k1_constant_band_11 double, k2_constant_band_11 double")


def test_split_window(spark):
    out = with_temperature(with_scene_constants(pixels(spark), meta(spark)), CFG).orderBy(F.desc("B10_TIR")).collect()
    want = sorted(ROWS, key=lambda r: -r[2])
    assert len(out) == 4
    for got, row in zip(out, want):
        for name, value in zip(("ndvi", "pv", "eps10", "eps11", "bt10", "bt11", "lst"), row[4:]):
            assert got[name] == pytest.approx(value, abs=2e-6)
        assert got.has_thermal_split and got.bt10_minus_bt11 == pytest.approx(row[8] - row[9], abs=2e-6)


def test_fallbacks(spark):
    joined = with_scene_constants(pixels(spark), meta(spark))
    no11 = with_temperature(joined.drop("B11_TIR"), CFG).collect()
    assert all(r.lst == r.bt10 and not r.has_thermal_split and r.bt10_minus_bt11 is None for r in no11)
    both = with_temperature(joined.withColumn("ST_B10", F.lit(302.0)), CFG).collect()
    assert max(r.lst for r in both) == pytest.approx(308.8779, abs=1e-4) and all(abs(r.lst - 302) < 10 for r in both)
    surface = with_temperature(joined.drop("B10_TIR", "B11_TIR").withColumn("ST_B10", F.lit(302.0)), CFG).collect()
    assert all(r.bt10 is None and r.lst == 302.0 for r in surface)
    gaps = joined.withColumn("B11_TIR", F.when(F.col("B4_Red") > 0.09, F.col("B11_TIR")))
    assert sum(r.lst is None for r in with_temperature(gaps, CFG).collect()) == 2
    assert all(r.lst is not None and r.has_thermal_split == (r.B11_TIR is not None) for r in with_temperature(gaps, CFG, "row").collect())


def test_unknown_scene_and_zero_radiance(spark):
    df = pixels(spark, [(0.1, 0.2, 0.0, 8.0)])
    row = with_temperature(with_scene_constants(df, meta(spark)), CFG).first()
    assert row.bt10 is None and row.lst is None
    other = with_scene_constants(pixels(spark).withColumn("tile_id", F.lit("X")), meta(spark))
    assert with_temperature(other, CFG).filter("lst is not null").count() == 0
    nan = spark.createDataFrame([(float("nan"),), (None,)], "ndvi double").select(thermal.vegetation_share(F.col("ndvi"), CFG).alias("pv"))
    assert [r.pv for r in nan.collect()] == [0.0, 0.0]


@pytest.mark.parametrize("easting, northing, lat, lon", [(500000, 0, 0.0, 81.0), (500000, 1437000, 12.998772702496, 81.0), (410000, 1440000, 13.024572268169, 80.170002899082)])
def test_reprojection(spark, easting, northing, lat, lon):
    df = spark.createDataFrame([(float(easting), float(northing), "WGS 84 / UTM zone 44N")], "x double, y double, c string")
    row = reproject.located(df.withColumn("utm_zone", reproject.utm_zone(F.col("c")))).first()
    assert row.lat == pytest.approx(lat, abs=1e-9) and row.lon == pytest.approx(lon, abs=1e-9)


def grid(spark, n, years):
    return spark.createDataFrame([(float(i), float(j), 300.0 + i, y, "train") for y in range(years) for i in range(n) for j in range(n)], "lon double, lat double, lst double, year int, split string")


@pytest.mark.parametrize("n, years, rate, want", [(9, 1, 0.1, 9), (8, 1, 0.25, 16), (10, 2, 0.1, 18), (6, 1, 0.5, 36), (6, 1, 0.0, 36), (6, 1, 1.0, 36)])
def test_grid_sample(spark, n, years, rate, want):
    df = grid(spark, n, years)
    assert sample.systematic_grid(df, rate).count() == want
    with_null = df.unionByName(spark.createDataFrame([(None, 0.0, 1.0, 0, "train")], df.schema))
    kept = sample.systematic_grid(with_null.repartition(5), rate)
    assert kept.filter("lon is not null").count() == want and (rate not in (0.1, 0.25) or kept.filter("lon is null").count() == 0)


@pytest.mark.parametrize("n, years, rate, want", [(100, 1, 0.2, 80), (30, 2, 0.25, 56)])
def test_stratified_sample(spark, n, years, rate, want):
    rows = [(float(i), 13.0, 300.0, y, z) for y in range(years) for z in "abcd" for i in range(n)]
    df = spark.createDataFrame(rows, "lon double, lat double, lst double, year int, zoning_category string")
    got = sample.stratified(df, rate)
    assert got.count() == want and set(got.groupBy("year", "zoning_category").count().toPandas()["count"]) == {want // years // 4}
    assert sorted(got.collect()) == sorted(sample.stratified(df.repartition(7), rate).collect())
    plain = df.drop("zoning_category")
    assert sample.stratified(plain, 0.1).count() == sample.systematic_grid(plain, 0.1).count()
    with pytest.raises(ValueError):
        sample.sample(df, "other")


def test_quality(spark):
    qa = spark.createDataFrame([(v,) for v in (0, 32, 1, 2, 4, 8, 15, 31)], "qa int")
    assert [r.ok for r in qa.select(filters.qa_clear("qa").alias("ok")).collect()] == [True, True] + [False] * 6
    rows = [("a", 80.0, 13.0, v) for v in (0, 32, 32, 8, 1)] + [("a", 0.0, 0.0, 8), ("b", 0.0, 0.0, 32)]
    clouds = quality.aoi_cloud(spark.createDataFrame(rows, "scene string, lon double, lat double, qa int"), Config.bbox)
    assert {r.scene: r.cloud_percent for r in clouds.collect()} == {"a": 50.0, "b": -1.0}
    gate = quality.gated(clouds.select("scene"), clouds, 10.0)
    assert {r.scene: r.accepted for r in gate.collect()} == {"a": False, "b": True}


def test_scaling_and_rounding(spark):
    rows = [("B4", 10000.0, 0.175), ("B10", 10000.0, 0.175), ("ST_B10", 40000.0, 285.7208), ("X", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k string, dn double, want double").withColumn("got", indices.scaled(F.col("dn"), F.col("k")))
    assert all(r.got == pytest.approx(r.want) for r in df.collect())
    numbers = spark.createDataFrame([(123.456789, -0.00005)], "a double, b double")
    got = numbers.select(indices.rounded(F.col("a"), 2), indices.rounded(F.col("a"), 4), indices.rounded(F.lit(0.9999), 0), indices.rounded(F.col("b"), 4)).first()
    assert tuple(got) == (123.46, 123.4568, 1.0, -0.0001)
    names = spark.createDataFrame([("B4",), ("ST_B10",), ("zz",)], "k string").select(indices.band_name(F.col("k")))
    assert [r[0] for r in names.collect()] == ["B4_Red", "ST_B10", "zz"]
    t = spark.sql("select timestamp'2024-03-01 10:30:00' as t, 'LC08_L2SP_142051_20240301_02' as id")
    row = t.select(F.unix_millis("t"), F.dayofyear("t"), indices.doy_from_scene_id("id"), indices.or_epoch(F.lit(None).cast("timestamp")).cast("string")).first()
    assert tuple(row) == (1709289000000, 61, 61, "2000-01-01 00:00:00")
    ints = spark.createDataFrame([('"142"',), ("51",), ("x",), (None,)], "v string").select(indices.flexible_int(F.col("v")))
    assert [r[0] for r in ints.collect()] == [142, 51, None, None]


def test_geometry(spark):
    assert geometry.KM2_PER_DEGREE2 == pytest.approx(11918.845406) and geometry.bbox_km2(Config.bbox) == pytest.approx(2066.829713)
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    unit = ring([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)])
    thread = ring([(0, 0), (0.01, 0.0001), (0.02, 0), (0.03, 0.0001), (0.04, 0), (0, 0)])
    df = spark.createDataFrame([(unit,), (thread,)], "r array<struct<x: double, y: double>>")
    assert [r[0] for r in df.select(geometry.is_sliver(F.col("r"))).collect()][0] is False
    assert df.select(geometry.ring_area(F.col("r"))).first()[0] == 1.0
    assert df.select(geometry.compactness(F.col("r"))).first()[0] == pytest.approx(math.pi / 4)
    bent = [[(0, 0), (4, 0), (4, 3), (3, 3), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0)]]
    parts = geometry.clip_polygon([ring(bent[0])], (-1, 2, 5, 5))
    assert sorted(geometry._area([(p["x"], p["y"]) for p in part[0]]) for part in parts) == [1.0, 1.0]
    holed = geometry.clip_polygon([unit, ring([(0.2, 0.2), (0.4, 0.2), (0.4, 0.4), (0.2, 0.4), (0.2, 0.2)])], (0.3, 0, 2, 1))
    assert len(holed) == 1 and len(holed[0]) == 2


def test_year_guard():
    assert Config().checked() == Config()
    with pytest.raises(YearOverlapError, match="overlap.*year 2023") as e:
        Config(train_start=2023, train_end=2023, test_start=2023, test_end=2023).checked()
    assert all(x in str(e.value) for x in ("--allow-degenerate-split", "train range", "test  range"))
    for a, b in (((2020, 2030), (2025, 2028)), ((2025, 2028), (2020, 2030))):
        with pytest.raises(YearOverlapError, match="years 2025–2028"):
            Config(train_start=a[0], train_end=a[1], test_start=b[0], test_end=b[1]).checked()
    Config(train_start=2023, train_end=2023, test_start=2023, test_end=2023, allow_degenerate_split=True).checked()
    Config(train_start=2020, train_end=2021, test_start=2022, test_end=2023).checked()
    assert Config.from_args(["--smoothing", "5", "--bbox", "1,2,3,4"]).bbox == (1.0, 2.0, 3.0, 4.0)
    for bad in ("1,2,3", "3,2,1,4"):
        with pytest.raises(ValueError):
            parse_bbox(bad)


def test_metrics(spark):
    df = spark.createDataFrame([(300.0, 302.0), (310.0, 309.0), (0.0, 1.0), (None, 1.0)], "y double, pred double")
    row = report.regression_metrics(df).first()
    mean = 610 / 3
    assert row.mae == pytest.approx(4 / 3) and row.rmse == pytest.approx(math.sqrt(2)) and row.mape == pytest.approx(0.494624, abs=1e-6)
    assert row.r2 == pytest.approx(1 - 6 / sum((y - mean) ** 2 for y in (300, 310, 0)))
    assert all(math.isnan(v) for v in report.regression_metrics(df.limit(0)).first())


def test_pivot_and_splits(spark):
    rows = [("a", 13.0, 80.0, "B4_Red", 0.2, "x"), ("a", 13.0, 80.0, "B4_Red", 0.1, "x"), ("a", 13.0, 80.0, "B5_NIR", 0.3, "x")]
    df = spark.createDataFrame(rows, "tile_id string, lat double, lon double, band string, value double, lulc_class string").withColumn("timestamp", F.to_timestamp(F.lit("2024-03-01 00:00:00")))
    row = with_indices(pivot_bands(df)).first()
    assert row.B4_Red == 0.1 and row.ndvi == pytest.approx(0.5) and row.ndbi is None and row.year == 2024
    marks = spark.createDataFrame([(y, "z") for y in range(2020, 2035)], "year int, k string")
    with pytest.warns(UserWarning):
        got = split.temporal_split(marks)
    assert {r.year for r in got.filter("split = 'train'").collect()} == set(range(2024, 2032)) and got.count() == 10
