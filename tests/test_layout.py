"""Files laid out for boxes of coordinates, and samples whose strata are dealt evenly."""

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from landheat.config import Config
from landheat.functions import indices
from landheat.operators import encode, matrix, pivot, sample
from landheat.operators.filters import in_bbox
from landheat.plans import tables
from landheat.schemas import PIXEL_LONG
from landheat.sources import pixels
from tests.conftest import SF

BOX = Config.bbox


def rows_read(df):
    """Rows that the scan of a plan hands on."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def grid(spark, n=1_000_000):
    share = lambda seed, a, b: F.rand(seed) * (b - a) + a
    return spark.range(0, n, 1, 8).select(F.col("id"), share(1, BOX[0], BOX[2]).alias("lon"), share(2, BOX[1], BOX[3]).alias("lat"))


def small_box(side=0.1):
    w, h = (BOX[2] - BOX[0]) * side, (BOX[3] - BOX[1]) * side
    x, y = BOX[0] + (BOX[2] - BOX[0]) * 0.37, BOX[1] + (BOX[3] - BOX[1]) * 0.52
    return (x, y, x + w, y + h)


def test_a_box_reads_few_rows_of_the_matrix(spark, tmp_path):
    rows = grid(spark).select("lon", "lat", F.lit(2020).alias("year"), F.lit("train").alias("split"), F.col("id").cast("double").alias("lst"))
    assert matrix.write_matrix(rows, str(tmp_path))["rows"] == 1_000_000
    found = matrix.read_matrix(spark, str(tmp_path)).filter(in_bbox(small_box()))
    read = rows_read(found)
    assert 8000 < found.count() < 12_000 and read < 0.05 * 1_000_000


def test_a_box_reads_few_rows_of_the_pixels(spark, tmp_path):
    rows = grid(spark).select(F.lit("T").alias("tile_id"), "lat", "lon", F.lit("B4_Red").alias("band"), F.lit(0.5).alias("value"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("").alias("lulc_class"))
    pixels.write_pixels(rows.to(spark.createDataFrame([], PIXEL_LONG).schema), str(tmp_path))
    assert rows_read(pixels.read_pixels(spark, str(tmp_path)).filter(in_bbox(small_box()))) < 0.05 * 1_000_000


def nodes(plan, kind):
    """The nodes of a kind in a plan that Spark has not yet made adaptive."""
    own = [plan] if plan.nodeName() == kind else []
    return own + [n for k in range(plan.children().size()) for n in nodes(plan.children().apply(k), kind)]


def test_writers_sort_by_columns(spark, tmp_path, monkeypatch):
    """A sort works out an expression among its keys at every comparison, so codes are a column before it."""
    plans, write = [], DataFrameWriter.parquet

    def seen(self, *args, **kwargs):
        plans.append(self._df._jdf.queryExecution().sparkPlan())
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", seen)
    named = lambda n: F.concat(F.lit(n), F.col("id") % 3)
    rows = grid(spark, 5000).select("lon", "lat", (2020 + F.col("id") % 2).cast("int").alias("year"), *(named(n).alias(n) for n in ("split", "tile_id", "band")), F.col("id").alias("__code"))
    matrix.write_matrix(rows, str(tmp_path / "matrix"))
    pixels.write_pixels(rows, str(tmp_path / "pixels"))
    for plan in plans:
        (sort,) = nodes(plan, "Sort")
        keys = [sort.sortOrder().apply(k).child().nodeName() for k in range(sort.sortOrder().size())]
        assert len(keys) >= 3 and set(keys) == {"AttributeReference"}
    for path in ("matrix", "pixels"):
        got = spark.read.parquet(str(tmp_path / path))
        assert sorted(got.columns) == sorted(rows.columns)
        assert got.select(rows.columns).exceptAll(rows).isEmpty() and got.count() == 5000


def test_pivot_shuffles_pixels_once(spark):
    """One aggregation by pixel gives what `pivot` gives, on odd rows too."""
    rows = [(p, b, v) for p in ("p", "q", None) for b, v in (("B4", 0.5), ("B4", 0.25), ("B5", None), ("B5", float("nan")), ("B6", float("nan")), ("B6", 2.0), (None, 1.0), ("other", 1.0))]
    df = spark.createDataFrame([*rows, ("r", "other", 1.0), ("s", None, None)], "pixel string, band string, value double")
    bands = ["B4", "B5", "B6", "B7"]
    got = pivot.pivot_bands(df, bands, ["pixel"])
    want = df.groupBy("pixel").pivot("band", bands).agg(F.min("value"))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 5
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert len(nodes(pivot.pivot_bands(df, bands, ["pixel"])._jdf.queryExecution().executedPlan(), "Exchange")) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_morton_codes_interleave_bits(spark):
    places = [(80.0, 13.0), (-180.0, -90.0), (180.0, 90.0), (0.0, 0.0), (80.345, 12.8), (-0.001, 51.5)]
    df = spark.createDataFrame([*places, (None, 1.0)], "lon double, lat double").withColumn("code", indices.morton(F.col("lon"), F.col("lat")))

    def brute(lon, lat):
        cell = lambda share: min(max(int(np.floor(share * 2**24)), 0), 2**24 - 1)
        x, y = cell((lon + 180) / 360), cell((lat + 90) / 180)
        return sum((x >> b & 1) << 2 * b | (y >> b & 1) << 2 * b + 1 for b in range(24))

    for r in df.collect():
        assert r.code == (None if r.lon is None else brute(r.lon, r.lat))


def ranked(rows, step):
    """Ids of every step-th row of each stratum by longitude, latitude and tile."""
    strata, kept = {}, set()
    for r in sorted((r for r in rows if r["lon"] is not None), key=lambda r: (r["lon"], r["lat"], r["tile_id"])):
        own = strata.setdefault((r["year"], r["zone"]), [])
        own.append(r)
        if len(own) % step == 0:
            kept.add(r["id"])
    return kept


@pytest.mark.parametrize("parts", [1, 9])
def test_strata_are_ranked_across_ranges(spark, parts):
    rng = np.random.default_rng(2)
    rows = [{"id": k, "year": int(rng.choice([2019, 2020])), "zone": rng.choice(["a", "b", None]), "lon": float(rng.choice([80.0, 80.1, 80.2])) if k % 50 else None, "lat": k * 0.001, "tile_id": f"T{k % 3}"} for k in range(3000)]
    for r in rows:
        r["zone"] = None if r["zone"] is None else str(r["zone"])
    df = spark.createDataFrame(rows, "id long, year int, zone string, lon double, lat double, tile_id string")
    got = sample.stratified(df.repartition(parts), 0.2, ("zone",))
    assert got.columns == df.columns and {r.id for r in got.collect()} == ranked(rows, 5)
    clash = df.withColumns({n: F.lit(n) for n in ("row", "o0", "part", "place", "y", "z", "shift", "n")})
    found = sample.stratified(clash, 0.2, ("zone",))
    assert found.columns == clash.columns and {(r.id, r.row, r.shift) for r in found.collect()} == {(k, "row", "shift") for k in ranked(rows, 5)}


def test_one_longitude_goes_to_many_tasks(spark, monkeypatch):
    """A stratum at a single longitude is dealt over ranges of nearly equal fill."""
    fills = []
    keep = sample.written

    def seen(df, name):
        out = keep(df, name)
        if name == "ranked-rows":
            fills.append(sorted(r["count"] for r in out.groupBy("part").count().collect()))
        return out

    monkeypatch.setattr(sample, "written", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit(2020).alias("year"), F.lit("a").alias("zone"), F.lit(80.0).alias("lon"), (F.col("id") * 1e-5).alias("lat"), F.lit("T").alias("tile_id"))
        assert sample.stratified(df, 0.1, ("zone",)).count() == 4000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(fills[0]) == 8 and fills[0][-1] < 2 * 40_000 / 8


def test_encoding_computes_its_rows_once(spark):
    """What gave the rows is not part of the plan that comes out: it ran when they were written."""
    found = encode.encode(tables.read(spark, SF, "orders").select("o_orderpriority", F.col("o_totalprice").alias("lst")), "lst", ["o_orderpriority"])
    assert {f.split("/")[-2].rpartition("-")[0] for f in found.inputFiles()} == {"rows-to-encode", "target-stats"}
