"""What must hold whatever the data: equal results of two ways, of any partitioning, and the plans that scale."""

import math
import pathlib
import random

import pytest

import __spark_entry__ as entry
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.ml import boosting, train as ml
from landheat.operators import analysis, encode, filters, sample, spatial, split
from landheat.functions import geometry
from landheat.plans import queries, tables
from landheat.schemas import ZONE
from landheat.sources import shared
from tests.conftest import SF


@pytest.fixture(scope="module")
def wide(spark):
    return tables.wide(spark, SF).cache()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_folds_in_one_pass_equal_one_pass_each(spark):
    rows = [(i, "abc"[i % 3] if i % 11 else None, float(i * i % 97) if i % 7 else None) for i in range(200)] + [(900, "rare", 5.0)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    fold = (F.col("id") % 4).cast("int")
    got = {r.id: r.c_encoded for r in encode.encode_folded(df, "y", ["c"], ["id"], 4, 10.0, fold).collect()}
    for f in range(4):
        known = [(c, y) for i, c, y in rows if i % 4 != f and y is not None]
        overall = sum(y for _, y in known) / len(known)
        for i, c, _ in rows:
            if i % 4 == f:
                own = [y for d, y in known if d == c and c is not None]
                assert got[i] == pytest.approx((sum(own) + 10 * overall) / (len(own) + 10))


def test_encoding_golden(spark):
    rows = [("a", 300.0)] * 4 + [("b", 320.0)] + [(None, 310.0), ("none", None)]
    df = spark.createDataFrame(rows, "c string, y double").withColumn("d", F.col("c"))
    mean = (4 * 300 + 320 + 310) / 6
    got = {r.c: r for r in encode.encode(df, "y", ["c", "d"]).collect()}
    assert got["a"].c_encoded == pytest.approx((1200 + 10 * mean) / 14) == got["a"].d_encoded
    assert got[None].c_encoded is None
    assert {r.c: r.c_encoded for r in encode.encode(df, "y", ["c"], on_missing="mean").collect()}[None] == pytest.approx(mean)
    fit = encode.encode(df, "y", ["c"], fit_filter=F.col("c") == "b").filter("c = 'b'").first()
    assert fit.c_encoded == pytest.approx(320.0)


def test_cell_join_equals_nested_loop(spark, wide):
    zones = tables.zones(spark, SF)
    fast = spatial.join_zones(wide, zones).select("tile_id", "lat", "lon", "timestamp", "zone_id")
    slow = wide.join(zones, geometry.contains(F.col("polygons"), F.col("lon"), F.col("lat")), "left").select(fast.columns)
    assert sorted(map(str, fast.collect())) == sorted(map(str, slow.collect()))


def test_join_plan_has_no_nested_loop_and_no_python(spark, wide):
    text = plan(spatial.join_zones(tables.wide(spark, SF), tables.zones(spark, SF)))
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text and "Arrow" not in text


def test_bbox_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    tables.pixels(spark, SF).write.parquet(path)
    text = plan(spark.read.parquet(path).filter(filters.in_bbox()).select("lat"))
    assert "GreaterThanOrEqual(lon" in text and "LessThanOrEqual(lat" in text and "ReadSchema: struct<lat:double,lon:double>" in text


def test_any_partitioning_gives_the_same(spark, wide):
    small = wide.select("tile_id", "lat", "lon", "year", F.col("ndvi").alias("lst"), F.col("lulc_class").alias("zoning_category"))
    for make in (
        lambda d: sample.stratified(d, 0.2),
        lambda d: sample.systematic_grid(d, 0.1),
        lambda d: filters.sampled(d, 0.3, ["lat", "lon", "year"]),
        lambda d: split.shuffled_split(d, ["lat", "lon", "year"]),
        lambda d: encode.encode_folded(d, "lst", ["zoning_category"], ["lat", "lon", "year"]).withColumn("zoning_category_encoded", F.round("zoning_category_encoded", 9)),
    ):
        assert sorted(map(str, make(small.coalesce(1)).collect())) == sorted(map(str, make(small.repartition(8)).collect()))


def test_training(spark, tmp_path):
    rows = [(float(i % 10), float(i % 7), 300.0 + i % 10 + 0.1 * (i % 7), "train" if i % 4 else "test", i, 300.0 + i % 10) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, lst double, split string, doy int, ST_B10 double").withColumn("b", F.when(F.col("doy") % 50 == 0, float("nan")).otherwise(F.col("b")))
    df = ml.with_season(df)
    features = ml.feature_names(df)
    assert set(features) == {"a", "b", "season_sin", "season_cos"}
    model = ml.fit(split.with_validation(df, ["doy"]), features, ml.TrainConfig(depth=3, rounds=5, rate=0.5))
    assert ml.evaluation(model, df).first().rmse < 1.0 and ml.baseline(df).first().rmse < 1.0
    assert ml.importances(model).first().feature == "a"
    assert ml.permutation_importance(model, df, ["a", "b"], ["doy"]).first().feature == "a"
    ml.save(model, str(tmp_path / "m"))
    assert ml.evaluation(ml.saved(str(tmp_path / "m")), df).first().rmse == ml.evaluation(model, df).first().rmse


def test_training_goes_on_while_validation_gains(spark):
    errors = [5.0, 4.0, 4.5, 3.0, 3.1, 3.2, 3.3]
    assert [boosting.stopped(errors[:k], 3) for k in range(8)] == [False] * 7 + [True] and not boosting.stopped([3.0, 2.0, 2.1], 2)
    rows = [(float(i % 20), float(i % 7), 300.0 + i % 20 + 0.1 * (i % 7), "train", i % 6 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, lst double, split string, is_val boolean")
    model = ml.fit(df, ["a", "b"], ml.TrainConfig(depth=3, rounds=24, rate=0.05, patience=8))
    assert len(model.trees) == 24


def test_training_query_is_whole(spark, monkeypatch):
    asked, fit = [], ml.fit

    def small(df, features, cfg):
        asked.append((set(features), cfg))
        assert set(features) == set(ml.feature_names(df))
        return fit(df, features, ml.TrainConfig(depth=2, rounds=2))

    monkeypatch.setattr(ml, "fit", small)
    found = queries.QUERIES["train_and_evaluate"](spark, SF).first()
    assert found.rmse > 0 and asked[0][1] == ml.TrainConfig() and set(tables.LINE_BANDS[:3]) <= asked[0][0]


def ring_of(*points):
    return [[[{"x": float(x), "y": float(y)} for x, y in points]]]


@pytest.mark.parametrize(
    "points, crossing",
    [
        ([(0, 0), (4, 0), (4, 4), (0, 4)], False),
        ([(0, 0), (4, 4), (4, 0), (0, 4)], True),
        ([(0, 0), (4, 0), (2, 0), (2, 4)], True),  # an edge turns back
        ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], True),  # a vertex on another edge
        ([(0, 0), (2, 1), (4, 0), (4, 4), (0, 4)], False),
        ([(0, 0), (4, 0), (2, 3)], False),
    ],
)
def test_rings_that_cross_themselves(spark, points, crossing):
    zones = spark.createDataFrame([(1, "c", ring_of(*points))], ZONE)
    assert tuple(spatial.crossing_counts(zones).first()) == ("c", 1, int(crossing))


def test_large_zone_ids_are_kept(spark):
    square = ring_of((80.0, 12.9), (80.01, 12.9), (80.01, 12.91), (80.0, 12.91))
    zones = spark.createDataFrame([(2 * 10**18, "a", square), (2 * 10**18 + 1, "b", square), (5, None, square), (5, None, [])], ZONE)
    kept = spatial.kept_zones(spatial.clipped_zones(zones, Config.bbox)).collect()
    assert len(kept) == 3 and len({r.zone_id for r in kept}) == 3 and all(r.zone_id >= 0 for r in kept)


def test_pixels_without_a_year_are_no_year(spark):
    rows = spark.createDataFrame([(2020, 0.5, 0.5, 3.0), (None, 0.5, 0.5, 5.0), (None, 2.5, 2.5, 7.0)], "year int, lon double, lat double, v double")
    grid = analysis.gridded_mean(rows, "v", (0.0, 0.0, 3.0, 3.0), 3)
    assert {(r.year, r.ix, r.iy): (r.mean, r.n) for r in grid.collect()} == {(2020, 0, 0): (3.0, 1), (None, 0, 0): (4.0, 2), (None, 2, 2): (7.0, 1)}
    assert {(r.year, r.ix): r.mean for r in analysis.smoothed_grid(grid).collect()} == {(2020, 0): 3.0, (None, 0): 4.0, (None, 2): 7.0}


def test_null_and_empty_zones_are_two_strata(spark):
    rows = spark.createDataFrame([(2020, c, float(i), 0.0, "t", 1.0) for c in (None, "") for i in range(3)], "year int, zoning_category string, lon double, lat double, tile_id string, lst double")
    assert {(r.zoning_category, r.lon) for r in sample.stratified(rows, 0.5).collect()} == {(None, 1.0), ("", 1.0)}


def test_cover_beyond_the_broadcast_limit_joins_alike(spark):
    zones = tables.zones(spark, SF)
    pixels = tables.wide(spark, SF).select("lon", "lat")
    few, none = (spatial.join_zones(pixels, zones, most_bytes=n) for n in (1 << 30, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, none.collect()))


def test_written_tables_can_be_cleared(spark):
    import os

    rows = shared.written(spark.range(3), "some")
    assert rows.count() == 3 and os.path.isdir(shared.written_folder(spark))


def test_composite_in_any_order(spark):
    """Means per pixel are sums without rounding, divided once."""
    rng = random.Random(7)
    rows = [(i % 40 * 1.0, 80.0, 2000, round(rng.uniform(280, 300), 4), round(rng.uniform(280, 300), 4)) for i in range(560)]
    df = spark.createDataFrame(rows, "lat double, lon double, year int, bt10 double, bt11 double")
    got = {r.lat: (r.bt10, r.bt11, r.difference) for r in analysis.composite(df, (2000, 2000)).collect()}
    for lat, found in got.items():
        own = [r for r in rows if r[0] == lat]
        assert found == tuple(math.fsum(v) / len(own) for v in ([r[3] for r in own], [r[4] for r in own], [r[3] - r[4] for r in own]))
    out = df.limit(2).withColumn("bt10", F.lit(1e9)).withColumn("bt11", F.lit(None).cast("double"))
    assert {(r.bt10, r.bt11) for r in analysis.composite(out, (2000, 2000)).collect()} == {(1e9, None)}


@pytest.mark.parametrize("name, heavy", [("vector_records", "from_json"), ("clip_reasons", "MapInArrow")])
def test_heavy_work_is_dealt_over_tasks(spark, name, heavy):
    """Rows of one small file are shuffled once, before what costs most; cut zones are cut once."""
    lines = plan(entry.queries()[name](spark, SF)).splitlines()
    spread = [k for k, line in enumerate(lines) if "REPARTITION_BY_NUM" in line]
    work = [k for k, line in enumerate(lines) if heavy in line]
    assert len(spread) == 1 and work and min(work) < spread[0]
    assert heavy != "MapInArrow" or len(work) == 1


def test_rings_are_tested_once_over_tasks(spark):
    """What tells rings that cross themselves is written once, by several tasks, though the parts come as one."""
    folder = pathlib.Path(shared.written_folder(spark).removeprefix("file:"))
    before = set(folder.glob("tested-rings-*"))
    entry.queries()["crossing_rings"](spark, SF).collect()
    (made,) = set(folder.glob("tested-rings-*")) - before
    assert len(list(made.glob("*.parquet"))) > 1
